"""Change context: boundaries, signals, samples, snapshots and dispatch (2.6, 2.7, 2.8, 2.13, 2.14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(facts: DataFrame, *columns: str) -> DataFrame:
    """2.6.22, 2.6.21: (dimension, value, n) for each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return facts.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def session_snapshot(agents: DataFrame, intents: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """2.6.50: one row: agents, intents by lease, the latest run."""
    a = agents.agg(F.countDistinct("agent").alias("agents"))
    i = intents.agg(F.count("*").alias("intents"), F.count_if(F.col("lease") > now).alias("leased"))
    r = runs.agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("latest_run"))
    return a.join(i).join(r)


def graph_sample(edges: DataFrame, seeds: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """2.7.8: edges among the first nodes by (seed priority, degree, name), capped, with how
    many were left out."""
    both = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    s = seeds.select(F.col("node").alias("_s"), F.col("priority")).groupBy("_s").agg(F.min("priority").alias("priority"))
    ranked = both.join(s, F.col("node") == F.col("_s"), "left").select("node", "degree", F.coalesce("priority", F.lit(9)).alias("priority"))
    chosen = ranked.orderBy("priority", F.desc("degree"), "node").limit(max_nodes).select("node")
    inside = edges.join(chosen.select(F.col("node").alias("src")), "src", "left_semi").join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi")
    total = edges.agg(F.count("*").alias("all_edges"))
    return inside.select("src", "dst").orderBy("src", "dst").limit(max_edges).join(F.broadcast(total))


def zoom_depth(prefixes: Column, few: int = 12, many: int = 60) -> Column:
    """2.7.11: one level down for few prefixes, one up for many, else as it is."""
    return F.when(prefixes < few, F.lit(3)).when(prefixes > many, F.lit(1)).otherwise(F.lit(2))


def cycle_membership(cycles: DataFrame, origins: DataFrame) -> DataFrame:
    """2.7.16: (origin, component) for the origins inside a cycle."""
    m = cycles.select("component", F.explode("members").alias("m"))
    return m.join(origins, F.col("m") == F.col("origin")).select("origin", "component")


def risk_signals(zone: DataFrame, **lists: DataFrame) -> DataFrame:
    """2.7.18: (path, signal) for the paths of a zone that are in a named list (path)."""
    out = None
    for name, rows in lists.items():
        part = zone.select("path").distinct().join(rows.select("path").distinct(), "path", "left_semi").select("path", F.lit(name).alias("signal"))
        out = part if out is None else out.unionByName(part)
    return out


def change_boundaries(rules: DataFrame, review: DataFrame) -> DataFrame:
    """2.7.19: the first rule (path, reason, priority) of each path, and the review paths
    that no rule has."""
    w = Window.partitionBy("path").orderBy("priority", "reason")
    keep = rules.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("path", "reason", F.lit("do_not_touch").alias("list"))
    rest = review.select("path", "reason").distinct().join(keep.select("path"), "path", "left_anti")
    rest = rest.groupBy("path").agg(F.min("reason").alias("reason")).select("path", "reason", F.lit("review").alias("list"))
    return keep.unionByName(rest)


def metrics_diff(before: DataFrame, after: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """2.8.9 over one-row tables: new members of each set and the change of each number."""
    a, b = before.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *numbers)]), after
    j = b.join(a)
    return j.select(*[F.array_sort(F.array_except(c, f"_{c}")).alias(f"new_{c}") for c in keys], *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in numbers])


def records_of(records: DataFrame, subjects: DataFrame, wanted: str, prefix: bool, offset: int, limit: int) -> DataFrame:
    """2.8.15, 2.13.20: records (id, updated) with a subject (record_id, key) that is, or
    begins with, ``wanted``; newest first, one page."""
    hit = F.col("key").startswith(wanted) if prefix else F.col("key") == wanted
    ids = subjects.where(hit).select(F.col("record_id").alias("id"))
    return records.join(ids, "id", "left_semi").orderBy(F.desc("updated"), "id").offset(offset).limit(limit)


def with_subjects(trajectories: DataFrame, subjects: DataFrame, wanted: DataFrame) -> DataFrame:
    """2.8.17: trajectories (id) that have one of the wanted subjects (kind, key)."""
    ids = subjects.join(wanted.distinct(), ["kind", "key"], "left_semi").select("id")
    return trajectories.join(ids, "id", "left_semi")


def ranked_records(primary: DataFrame, conflicts: DataFrame, limit: int, penalty: float = 0.2) -> DataFrame:
    """2.9.22: records (id, score, updated) less a penalty for those in conflict (id)."""
    c = conflicts.select(F.col("id").alias("_c")).distinct()
    r = primary.join(c, F.col("id") == F.col("_c"), "left").withColumn("score", F.round(F.col("score") - F.when(F.col("_c").isNotNull(), penalty).otherwise(0.0), 6)).drop("_c")
    return r.orderBy(F.desc("score"), F.desc("updated"), "id").limit(limit)


def hybrid_candidates(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """The lexical rows first, then vector rows they lack: (id, origin, rank)."""
    a = lexical.select("id", F.lit("lexical").alias("origin"), "rank")
    return a.unionByName(vector.join(lexical.select("id"), "id", "left_anti").select("id", F.lit("vector").alias("origin"), "rank"))


def revise(records: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """2.13.18: drafts with a decision (id, decision) change status; each change is a
    revision row beside the current one."""
    d = decisions.select(F.col("id").alias("_d"), "decision")
    j = records.join(d, (F.col("id") == F.col("_d")) & (F.col("status") == "draft"), "left")
    changed = F.col("decision").isNotNull()
    new = j.select("id", F.when(F.col("decision") == "approve", "active").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status")).alias("status"), F.when(changed, now).otherwise(F.col("updated")).alias("updated"), F.lit(True).alias("current"))
    return new.unionByName(j.where(changed).select("id", "status", "updated", F.lit(False).alias("current")))


def dispatch(sections: dict[str, Callable[[], DataFrame]], name: str, limit: int = 20) -> DataFrame:
    """2.14.9, 2.14.12, 2.14.13: a named section, with the limit held between 1 and 50."""
    if name not in sections:
        raise ValueError(f"no section {name!r}; there are {', '.join(sorted(sections))}")
    return sections[name]().limit(max(1, min(50, limit)))
