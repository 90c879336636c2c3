"""Metric families, health and event-log aggregates (2.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators.windows import floor_place, nearest_place, ranked, with_midrank


def complexity_summary(units: DataFrame) -> DataFrame:
    """2.6.2: average and maximum of max(1, cc), and the sorted names at high risk."""
    cc = F.greatest(F.lit(1), F.col("cc"))
    return units.agg(
        F.bround(F.avg(cc), 4).alias("average"), F.max(cc).alias("maximum"),
        F.array_sort(F.collect_set(F.when(S.complexity_risk(cc) == "high", F.col("qualname")))).alias("high_risk"),
    )


def class_summary(classes: DataFrame) -> DataFrame:
    """2.6.3: the same for coupling and cohesion."""
    return classes.agg(
        F.bround(F.avg("cbo"), 4).alias("cbo_average"), F.max("cbo").alias("cbo_maximum"), F.count_if(S.coupling_risk(F.col("cbo")) == "high").alias("cbo_high"),
        F.bround(F.avg("lcom4"), 4).alias("lcom4_average"), F.max("lcom4").alias("lcom4_maximum"), F.count_if(S.cohesion_risk(F.col("lcom4")) == "high").alias("lcom4_high"),
    )


#: 2.6.7: weights of the seven dimensions; fixed values.
HEALTH_WEIGHTS = {
    "clones": 0.25, "complexity": 0.20, "coupling": 0.10, "cohesion": 0.15, "dead_code": 0.10, "dependencies": 0.10, "coverage": 0.10,
}


def health(dimensions: DataFrame) -> DataFrame:
    """2.6.7, 2.6.10: weighted score of the seven dimension columns, half-even, 0 to 100."""
    total = sum((F.col(c) * F.lit(w) for c, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int")))
    return dimensions.withColumn("score", score).withColumn("grade", S.grade(F.col("score")))


def overloaded(rows: DataFrame, key: str, size: list[str], links: list[str]) -> DataFrame:
    """2.6.12 to 2.6.15: size and link scores as means of midranks, their mean as the
    total, and candidates above max(p90, q3 + 1.5 * iqr), at most 1."""
    # ten-thousandths as whole numbers, so that halves are exact and round half-even
    r = rows
    for c in [*size, *links]:
        r = with_midrank(r, c, f"_{c}").withColumn(f"_{c}", F.bround(F.col(f"_{c}") * 10000, 0))

    def mean(cols: list[str]) -> Column:
        return F.bround(sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols), 0)

    r = r.withColumn("_s", mean([f"_{c}" for c in size])).withColumn("_l", mean([f"_{c}" for c in links])).withColumn("_t", mean(["_s", "_l"]))
    r = r.withColumns({n: F.col(c) / 10000 for n, c in (("size_score", "_s"), ("link_score", "_l"), ("score", "_t"))})
    cut = r.agg(F.percentile("score", F.lit(0.9)).alias("p90"), F.percentile("score", F.lit(0.25)).alias("q1"), F.percentile("score", F.lit(0.75)).alias("q3"))
    cut = cut.select(F.least(F.lit(1.0), F.greatest("p90", F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5)).alias("cutoff"))
    return r.join(F.broadcast(cut)).select(key, "size_score", "link_score", "score", (F.col("score") >= F.col("cutoff")).alias("candidate"))


def directory_hotspots(items: DataFrame, k: int = 5) -> DataFrame:
    """2.6.16: items (finding_id, family, directory, path) by bucket (all, family) and
    directory: findings, items, files, share of the bucket in per cent; the first k."""
    rows = items.withColumn("bucket", F.explode(F.array(F.lit("all"), F.col("family"))))
    g = rows.groupBy("bucket", "directory").agg(F.countDistinct("finding_id").alias("findings"), F.count("*").alias("items"), F.countDistinct("path").alias("files"))
    g = g.withColumn("share", F.bround(F.col("items") * F.lit(100.0) / F.sum("items").over(Window.partitionBy("bucket")), 2))
    w = Window.partitionBy("bucket").orderBy(F.desc("items"), F.desc("findings"), "directory")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def source_scope(items: DataFrame, key: str, kind: str) -> DataFrame:
    """2.6.18: counts by source kind, the dominant kind (mixed if there are several) and
    the impact scope."""
    g = items.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in ("production", "tests", "fixtures", "other")])
    present = F.array_compact(F.array(*[F.when(F.col(k) > 0, k) for k in ("production", "tests", "fixtures", "other")]))
    scope = F.when((F.col("production") > 0) & (F.size(present) == 1), "runtime").when(F.col("production") == 0, "non_runtime").otherwise("mixed")
    return g.withColumn("dominant", F.when(F.size(present) > 1, "mixed").otherwise(F.element_at(present, 1))).withColumn("impact_scope", scope)


def group_locations(items: DataFrame, key: str, k: int = 3) -> DataFrame:
    """2.6.19, 2.6.20: spread and the first k distinct locations (path, line)."""
    return items.groupBy(key).agg(
        F.countDistinct("path").alias("files"), F.countDistinct("qualname").alias("functions"),
        F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "path", F.lpad(F.col("line").cast("string"), 6, "0")))), 1, k).alias("locations"),
    )


def audit_summary(events: DataFrame) -> DataFrame:
    """2.6.26 over (event_type, severity, ts, id)."""
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type").like("intent.%")).alias("intents"),
        F.count_if(F.col("event_type").isin("patch.accepted", "patch.violated")).alias("patches"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "error")],
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("id", F.struct("ts", "id")).alias("last_id"),
    )


def payload_footprint(events: DataFrame, group: str, size: str) -> DataFrame:
    """2.6.27 by group: count, sum, max, whole average, and the value at position n * 5 // 100
    of the falling order."""
    g = events.groupBy(group).agg(F.count(size).alias("n"), F.sum(size).alias("total"), F.max(size).alias("largest"))
    p = ranked(events, [group], size, {"p95": lambda n: n - F.floor(n * 5 / 100)}).withColumnRenamed(group, "_g")
    return g.join(p, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", "total", "largest", F.floor(F.col("total") / F.col("n")).alias("average"), "p95")


def top_workflows(events: DataFrame, k: int = 5) -> DataFrame:
    """2.6.28: (kind, id) derived by precedence intent, run, event; counted, first k."""
    kind = F.when(F.col("intent_id").isNotNull(), "intent").when(F.col("run_id").isNotNull(), "run").otherwise("event")
    ident = F.coalesce("intent_id", "run_id", F.col("event_id").cast("string"))
    g = events.groupBy(kind.alias("kind"), ident.alias("id")).agg(F.count("*").alias("total"))
    return g.orderBy(F.desc("total"), "kind", "id").limit(k)


def core_gaps(events: DataFrame) -> DataFrame:
    """2.6.29."""
    gap = F.col("core_json").isNull() | F.col("core_sha").isNull() | F.col("workflow_id").isNull()
    return events.agg(F.count("*").alias("total"), F.count_if(gap).alias("gaps"))


def tool_aggregates(ops: DataFrame, tool: str, value: str) -> DataFrame:
    """2.6.30: count and nearest-rank p50 and p95 of each tool."""
    g = ops.groupBy(tool).agg(F.count("*").alias("n"))
    p = ranked(ops, [tool], value, {"p50": nearest_place(0.5), "p95": nearest_place(0.95)}).withColumnRenamed(tool, "_g")
    return g.join(p, F.col(tool).eqNullSafe(F.col("_g")), "left").drop("_g")


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """2.6.31, 2.6.32, 2.6.35: sum by key and its permille of all, heavy from 250 on."""
    g = rows.groupBy(key).agg(F.sum(value).alias("total"))
    g = g.withColumn("share", S.permille(F.col("total"), F.sum("total").over(Window.partitionBy())))
    return g.withColumn("heavy", F.col("share") >= 250)


def counter_costs(spans: DataFrame, name: str, counters: str) -> DataFrame:
    """2.6.33, 2.6.34: sum and maximum of every counter (a map) by span name."""
    rows = spans.select(name, F.explode(counters).alias("counter", "value"))
    return rows.groupBy(name, "counter").agg(F.sum("value").alias("total"), F.max("value").alias("largest"))


def extremes(ops: DataFrame, k: int = 5) -> DataFrame:
    """2.6.36: the k slowest and the k largest operations (id, duration, bytes)."""
    slow = ops.orderBy(F.desc("duration"), "id").limit(k).select(F.lit("slowest").alias("list"), "id", F.col("duration").cast("double").alias("value"))
    return slow.unionByName(ops.orderBy(F.desc("bytes"), "id").limit(k).select(F.lit("largest").alias("list"), "id", F.col("bytes").cast("double").alias("value")))


def waste(spans: DataFrame, tools: DataFrame, least_ms: float = 50) -> DataFrame:
    """2.6.37: no-op spans that took time, and tools with heavy payloads."""
    a = spans.where((F.col("reason") == "noop") & (F.col("duration") >= least_ms)).select(F.lit("noop_span").alias("kind"), F.col("name").alias("subject"), F.col("duration").alias("cost"))
    return a.unionByName(tools.where("heavy").select(F.lit("heavy_payload").alias("kind"), F.col("name").alias("subject"), F.col("cost").cast("double").alias("cost")))


def information_value(agents: Column, structural: Column) -> Column:
    """2.6.39."""
    return F.least(F.lit(100), F.when(agents >= 2, 60).otherwise(0) + F.when(structural, 25).otherwise(0))


def experiences(trajectories: DataFrame, least_support: int = 5, least_value: int = 50) -> DataFrame:
    """2.6.38 to 2.6.40: trajectories (id, family, signals, outcome, agent, finished) exploded
    to (family, signal, outcome), kept with enough support and information, with the first
    20 as evidence."""
    key = ["family", "signal", "outcome"]
    rows = trajectories.select("id", "outcome", "agent", "finished", F.explode("families").alias("family"), "signals").withColumn("signal", F.explode("signals"))
    each = rows.groupBy(*key, "id", "agent").agg(F.count("*").alias("_n"))
    counts = each.groupBy(*key).agg(F.countDistinct("id").alias("support"), F.countDistinct("agent").alias("agents"))
    # the first ones of each group are picked where the rows are read, before they meet
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("finished").asc_nulls_first(), F.col("id").asc_nulls_first()))
    first = rows.select(*key, "finished", "id").withColumn("_place", place).where(F.col("_place") <= 20).select(*key, "_place", "id").distinct()
    first = first.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "id"))), lambda x: x["id"]).alias("evidence"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    g = counts.join(first, same[0] & same[1] & same[2]).select(*key, "support", "agents", "evidence")
    g = g.withColumn("information", information_value(F.col("agents"), F.col("signal").startswith("s")))
    return g.where((F.col("support") >= least_support) & (F.col("information") >= least_value))


def agent_rows(trajectories: DataFrame) -> DataFrame:
    """2.6.41."""
    return trajectories.groupBy("agent").agg(
        F.count("*").alias("trajectories"), F.countDistinct("intent").alias("intents"), F.count_if(F.col("outcome") == "violated").alias("failed"),
        F.sum("incidents").alias("incidents"), F.sum(F.size("anomalies")).alias("anomalies"),
    )


def anomaly_summary(trajectories: DataFrame) -> DataFrame:
    """2.6.42: counts by kind and severity of an array of (kind, severity)."""
    return trajectories.select(F.explode("anomalies").alias("a")).groupBy(F.col("a.kind").alias("kind"), F.col("a.severity").alias("severity")).agg(F.count("*").alias("n"))


def partition_metrics(assignments: DataFrame, label: str) -> DataFrame:
    """2.6.43: clusters, noise ratio (label < 0), dominant ratio and largest size."""
    sizes = assignments.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count_if(F.col(label) >= 0).alias("clusters"), F.bround(F.sum(F.when(F.col(label) < 0, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("noise_ratio"),
        F.bround(F.max(F.when(F.col(label) >= 0, F.col("n"))) / F.sum("n"), 4).alias("dominant_ratio"), F.max("n").alias("largest"),
    )


def metadata_distribution(items: DataFrame, payload: str, field: str, least: int = 10) -> DataFrame:
    """2.6.44: values of a JSON field with their rate, none under ``least`` samples."""
    v = items.select(F.get_json_object(payload, f"$.{field}").alias("value"))
    n = F.sum("n").over(Window.partitionBy())
    g = v.groupBy("value").agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.when(n >= least, F.bround(F.col("n") / n, 4)))


def numeric_summary(rows: DataFrame, value: str) -> DataFrame:
    """2.6.45, linear quantiles (2.6.14)."""
    return rows.agg(
        F.min(value).alias("low"), *[F.round(F.percentile(value, F.lit(q)), 6).alias(n) for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))],
        F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), F.count_if(F.col(value) == 0).alias("zeros"),
    )


def length_distribution(rows: DataFrame, value: str, by: str, limit: int) -> DataFrame:
    """2.6.46 to 2.6.48, floor-index percentiles, and the rows over a limit."""
    g = rows.groupBy(by).agg(F.count_if(F.col(value) > limit).alias("overflow"), F.max(F.greatest(F.lit(0), F.col(value) - limit)).alias("most_over"))
    qs = {"shortest": 0.0, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "longest": 1.0}
    p = ranked(rows, [by], value, {n: floor_place(q) for n, q in qs.items()}).withColumnRenamed(by, "_g")
    return g.join(p, F.col(by).eqNullSafe(F.col("_g")), "left").select(by, *qs, "overflow", "most_over")


def status_counts(records: DataFrame) -> DataFrame:
    """2.6.49: counts by type, by status and of all."""
    sets = records.groupingSets([["type"], ["status"], []], "type", "status")
    return sets.agg(F.count("*").alias("n"))
