"""Joins of the engine (2.8): range, anti, diff and prefix joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions.scalars import permille
from veinstone.session import written


#: Lines that meet in one join key of :func:`coverage_join`.
SPAN = 64


def coverage_join(units: DataFrame, lines: DataFrame) -> DataFrame:
    """2.8.1: unit rows (path, qualname, start, end, risk) with executable and covered
    lines (path, line, hits), permille and status. Rows of one line are counted before they
    meet the distinct ranges of a path, in an equi-join on stretches of ``SPAN`` lines; the
    sums of a range are then joined to its units. Repeated units count their lines as often."""
    r = lines.select(F.col("path").alias("_p"), "line", "hits")
    files = lines.select(F.col("path").alias("_f")).distinct()
    each = r.where("_p IS NOT NULL AND line IS NOT NULL").groupBy("_p", "line").agg(F.count("*").alias("_n"), F.count_if(F.col("hits") > 0).alias("_hit"))
    each = each.withColumn("_part", F.floor(F.col("line") / SPAN))
    own = units.groupBy("path", "qualname", "start", "end", "risk").agg(F.count("*").alias("_units"))
    parts = F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor(F.col("end") / SPAN))).alias("_part2")
    ranges = own.where("start <= end").select("path", "start", "end").distinct().select("path", "start", "end", parts)
    inside = (F.col("path") == F.col("_p")) & (F.col("_part2") == F.col("_part")) & F.col("line").between(F.col("start"), F.col("end"))
    sums = ranges.join(each, inside).groupBy(F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("end").alias("_end")).agg(F.sum("_n").alias("_n"), F.sum("_hit").alias("_hit"))
    g = own.join(sums, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")), "left")
    times = lambda c: (F.coalesce(F.col(c), F.lit(0)) * F.col("_units")).cast("int")
    g = g.select("path", "qualname", "start", "end", "risk", times("_n").alias("executable"), times("_hit").alias("covered"))
    g = g.join(files, F.col("path") == F.col("_f"), "left")
    status = F.when(F.col("_f").isNull(), "missing_from_report").when(F.col("executable") == 0, "no_executable_lines").otherwise("measured")
    return g.withColumn("status", status).withColumn("permille", permille(F.col("covered"), F.col("executable"))).drop("_f")


def is_coverage_hotspot(threshold: float = 60) -> Column:
    """2.8.2."""
    return F.col("risk").isin("medium", "high") & (F.col("status") == "measured") & (F.col("permille") / 10 < threshold)


def is_scope_gap() -> Column:
    """2.8.3."""
    return F.col("risk").isin("medium", "high") & (F.col("status") == "missing_from_report")


def unreferenced(candidates: DataFrame, names: DataFrame, qualnames: DataFrame, reachable: DataFrame) -> DataFrame:
    """2.8.4 to 2.8.6: candidates (qualname, local_name, suppressed) that nothing refers to,
    by qualified name, bare name or reachability. Null keys never match. Confidence is
    medium if the last part of a dotted local name is referred to."""
    out = candidates
    for other, column in ((qualnames, "qualname"), (reachable, "qualname"), (names, "local_name")):
        keys = other.select(F.col(other.columns[0]).alias("_k")).where("_k IS NOT NULL").distinct()
        out = out.join(keys, F.col(column) == F.col("_k"), "left_anti")
    last = names.select(F.col(names.columns[0]).alias("_n")).where("_n IS NOT NULL").distinct()
    out = out.withColumn("_last", F.element_at(F.split("local_name", r"\."), -1)).join(last, F.col("_last") == F.col("_n"), "left")
    return out.withColumn("confidence", F.when(F.col("_n").isNotNull(), "medium").otherwise("high")).drop("_last", "_n")


def entrypoints(refs: DataFrame, qualnames: DataFrame) -> DataFrame:
    """2.8.7: refs (module, local) to qualnames: the exact one, else the only one that ends
    in it. The suffix is an equi-join on the text after the first dot of each qualname."""
    r = refs.select("module", "local", F.concat_ws(":", "module", "local").alias("want"))
    q = qualnames.select("qualname").distinct()
    exact = r.join(q, r["want"] == q["qualname"]).select("want", "qualname")
    parts = F.split("qualname", r"\.")
    tails = q.where(F.size(parts) > 1).select(
        "qualname", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("tail")
    )
    only = r.join(exact, "want", "left_anti").join(tails, F.col("want") == F.col("tail")).groupBy("want").agg(F.count("*").alias("n"), F.min("qualname").alias("qualname")).where("n = 1")
    return exact.unionByName(only.select("want", "qualname"))


def set_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """2.8.8, 2.8.12: keys with the change added, removed or unchanged."""
    a = before.select(F.col(key).alias("_a")).distinct()
    b = after.select(F.col(key).alias("_b")).distinct()
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer").select(F.coalesce("_a", "_b").alias(key), kind.alias("change"))


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """2.8.10, 2.8.11: symbols (qualname, params) added, removed or with a changed
    signature; the position of the first parameter that differs (0 for the others)."""
    a, b = before.select(F.col("qualname").alias("qa"), F.col("params").alias("pa")), after.select(F.col("qualname").alias("qb"), F.col("params").alias("pb"))
    j = a.join(b, F.col("qa") == F.col("qb"), "full_outer")
    unequal = F.filter(F.sequence(F.lit(1), F.greatest(F.size("pa"), F.size("pb"), F.lit(1))), lambda i: ~F.try_element_at("pa", i).eqNullSafe(F.try_element_at("pb", i)))
    kind = F.when(F.col("qa").isNull(), "added").when(F.col("qb").isNull(), "removed").when(F.col("pa") != F.col("pb"), "signature_break")
    return j.select(F.coalesce("qa", "qb").alias("qualname"), kind.alias("change"), F.when(kind == "signature_break", F.element_at(unequal, 1)).otherwise(0).alias("position")).where("change IS NOT NULL")


def worsened(before: DataFrame, after: DataFrame, family: str, value: str) -> DataFrame:
    """2.8.13: (path, symbol) whose value grew, with the growth."""
    b = before.select("path", "symbol", F.col(value).alias("before"))
    a = after.select("path", "symbol", F.col(value).alias("after"))
    return a.join(b, ["path", "symbol"]).where("after > before").select(F.lit(family).alias("family"), "path", "symbol", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def under_paths(rows: DataFrame, path: str, changed: DataFrame, changed_path: str) -> DataFrame:
    """2.8.14, 2.13.12: rows whose path is, or lies below, a changed path.

    A path is expanded to itself and its parents, so the prefix test is an equi-join.
    """
    c = changed.select(F.col(changed_path).alias("_c")).distinct()
    parts = F.split("_p", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    hit = rows.select(F.col(path).alias("_p")).distinct().select("_p", F.explode(parents).alias("_up"))
    return rows.join(hit.join(c, F.col("_up") == F.col("_c"), "left_semi").select("_p").distinct(), F.col(path) == F.col("_p"), "left_semi")


def relations(links: DataFrame) -> DataFrame:
    """2.8.18: per record what it supersedes, is superseded by and is contradicted by."""
    out = links.where("kind = 'supersedes'").select(F.col("src").alias("id"), F.lit("supersedes").alias("role"), F.col("dst").alias("other"))
    by = links.where("kind = 'supersedes'").select(F.col("dst").alias("id"), F.lit("superseded_by").alias("role"), F.col("src").alias("other"))
    both = links.where("kind = 'contradicts'")
    con = both.select(F.col("src").alias("id"), F.lit("contradicted_by").alias("role"), F.col("dst").alias("other")).union(both.select("dst", F.lit("contradicted_by"), "src"))
    return out.unionByName(by).unionByName(con).groupBy("id", "role").agg(F.array_sort(F.collect_set("other")).alias("others"))


def precedents(current: DataFrame, past: DataFrame, k: int) -> DataFrame:
    """2.8.19: for each current row (id, workflow, started, subjects) the k latest past rows
    (pid, pworkflow, finished, psubjects) of another workflow that finished before it and
    share a subject.

    No pairs are made: a subject's past rows are numbered in order, and a current row looks up
    a fixed number of places. These are the k places before it, and of the earlier runs of one
    workflow the k last rows of each, k * (k + 1) in all: between two runs of its own workflow
    lies a row of another one, so k of these rows are of others, if there are so many."""
    from pyspark.sql import Window

    c = current.where("workflow IS NOT NULL AND started IS NOT NULL").select("id", "workflow", "started", F.explode(F.array_distinct("subjects")).alias("s")).where("s IS NOT NULL")
    p = past.where("pworkflow IS NOT NULL AND finished IS NOT NULL").select("pid", "pworkflow", "finished", F.explode(F.array_distinct("psubjects")).alias("s")).where("s IS NOT NULL")
    # a row that stands there with several workflows is of another one for every current row
    p = p.repartition("s").groupBy("s", "finished", "pid").agg(F.min("pworkflow").alias("lo"), F.max("pworkflow").alias("hi"))
    order = Window.partitionBy("s").orderBy("finished", "pid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    same = (F.col("lo") == F.col("hi")) & (F.lag("lo").over(order) == F.col("lo")) & (F.lag("hi").over(order) == F.col("lo"))
    p = p.withColumn("at", F.row_number().over(order)).withColumn("fresh", ~F.coalesce(same, F.lit(False))).withColumn("run", F.sum(F.col("fresh").cast("long")).over(upto))
    p = p.withColumn("kept", (~F.coalesce(F.lead("run", k).over(order) == F.col("run"), F.lit(False))).cast("long")).withColumn("nth", F.sum("kept").over(upto))
    p = p.withColumn("before", F.max(F.when(F.col("fresh"), F.col("nth") - F.col("kept"))).over(upto))
    p = written(p.select("s", "finished", "pid", "lo", "hi", F.col("at").cast("long").alias("at"), "kept", "nth", "before"))

    none = F.lit(None)
    rows = p.select("s", F.col("finished").alias("t"), F.lit(1).alias("kind"), F.struct("at", "before").alias("x"), none.cast(c.schema["id"].dataType).alias("id"), none.cast(c.schema["workflow"].dataType).alias("workflow"))
    rows = rows.unionByName(c.select("s", F.col("started").alias("t"), F.lit(0).alias("kind"), none.cast(rows.schema["x"].dataType).alias("x"), "id", "workflow"))
    latest = F.last("x", ignorenulls=True).over(Window.partitionBy("s").orderBy("t", "kind", "x").rowsBetween(Window.unboundedPreceding, 0))
    asked = written(rows.withColumn("x", latest).where("kind = 0 AND x IS NOT NULL").select("id", "workflow", "s", "x.at", "x.before"))

    def found(rows: DataFrame, top: str, n: int, of: DataFrame) -> DataFrame:
        steps = rows.select("id", "workflow", F.col("s").alias("_s"), F.explode(F.sequence(F.greatest(F.col(top) - (n - 1), F.lit(1)), F.col(top))).alias("_at"))
        j = steps.join(of.select("s", "at", "pid", "finished", "lo", "hi"), (F.col("_s") == F.col("s")) & (F.col("_at") == F.col("at")))
        return j.where("lo <> workflow OR hi <> workflow").select("id", "pid", "finished")

    j = found(asked, "at", k, p).unionByName(found(asked.where("before > 0"), "before", k * (k + 1), p.where("kept = 1").withColumn("at", F.col("nth")))).distinct()
    w = Window.partitionBy("id").orderBy(F.desc("finished"), F.desc("pid"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scope_overlap(intents: DataFrame) -> DataFrame:
    """2.8.20: pairs of intents (id, hard, soft) that share a hard scope path, or a hard one
    with a soft one; hard overlap wins. Paths are exploded into equi-joins."""
    paths = intents.select("id", F.explode("hard").alias("p"), F.lit(True).alias("h")).union(intents.select("id", F.explode("soft"), F.lit(False))).distinct()
    other = paths.select(F.col("id").alias("id2"), F.col("p").alias("p2"), F.col("h").alias("h2"))
    j = paths.join(other, (F.col("p") == F.col("p2")) & (F.col("id") < F.col("id2")) & (F.col("h") | F.col("h2")))
    return j.groupBy("id", "id2").agg(F.when(F.bool_or(F.col("h") & F.col("h2")), "hard").otherwise("soft").alias("overlap"), F.countDistinct("p").alias("paths"))


def review_queue(findings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """2.8.21: findings with their first suggestion, and the suggestions without a finding."""
    first = suggestions.groupBy("finding_id").agg(F.min(F.struct("rank", "action")).alias("x")).select("finding_id", F.col("x.action").alias("action"))
    known = findings.select("finding_id", "severity")
    rest = first.join(known, "finding_id", "left_anti").select("finding_id", F.lit(None).cast("string").alias("severity"), "action")
    return known.join(first, "finding_id", "left").select("finding_id", "severity", "action").unionByName(rest)


def importers(edges: DataFrame, is_test: Column) -> DataFrame:
    """2.8.23: (target, kind, importers): distinct modules that import each target, tests and
    production apart. ``edges`` (src, dst) and what ``is_test`` reads."""
    kind = F.when(F.coalesce(is_test, F.lit(False)), "tests").otherwise("production")
    return edges.groupBy(F.col("dst").alias("target"), kind.alias("kind")).agg(F.countDistinct("src").alias("importers"))


def signature_breaks(before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """2.8.11: (qualname, detail) of symbols (qualname, kind, params of name, kind, has_default
    and annotation, returns) that callers of the old one may not survive: the first of
    another kind, another number of parameters, a parameter of another kind, renamed,
    now required, or (``strict``) of another type. The texts are fixed values."""
    a = before.select(F.col("qualname").alias("_q"), *[F.col(c).alias(f"_{c}") for c in ("kind", "params", "returns")])
    j = after.join(a, F.col("qualname") == F.col("_q"))

    def worse(x: Column) -> Column:
        o, n = x["o"], x["n"]
        out = F.when(o["kind"] != n["kind"], F.concat(F.lit("Changed parameter kind for "), o["name"], F.lit(" from "), o["kind"], F.lit(" to "), n["kind"], F.lit(".")))
        out = out.when((o["kind"] != "pos_only") & (o["name"] != n["name"]), F.concat(F.lit("Renamed public parameter "), o["name"], F.lit(" to "), n["name"], F.lit(".")))
        out = out.when(o["has_default"] & ~n["has_default"], F.concat(F.lit("Parameter "), o["name"], F.lit(" became required.")))
        return out.when(F.lit(strict) & ~o["annotation"].eqNullSafe(n["annotation"]), F.concat(F.lit("Changed type annotation for parameter "), o["name"], F.lit(".")))

    first = F.get(F.filter(F.transform(F.arrays_zip(F.col("_params").alias("o"), F.col("params").alias("n")), worse), lambda d: d.isNotNull()), F.lit(0))
    detail = (
        F.when(F.col("_kind") != F.col("kind"), F.concat(F.lit("Changed public symbol kind from "), F.col("_kind"), F.lit(" to "), F.col("kind"), F.lit(".")))
        .when(~F.col("kind").isin("function", "method"), F.lit(None))
        .when(F.size("params") != F.size("_params"), "Changed callable parameter count.")
        .otherwise(F.coalesce(first, F.when(F.lit(strict) & ~F.col("returns").eqNullSafe(F.col("_returns")), "Changed return annotation.")))
    )
    return j.select("qualname", detail.alias("detail")).where("detail IS NOT NULL")


def around(symbol: str, calls: DataFrame, deps: DataFrame, api: DataFrame, budget: int = 40) -> DataFrame:
    """2.7.22: (role, symbol, path, line): the callers, callees, importers and public neighbours
    of a symbol (module:name), the roles taking turns until the budget is used up."""
    from pyspark.sql import Window

    module = symbol.partition(":")[0]
    parts = [
        calls.where(F.col("callee") == symbol).select(F.lit("caller").alias("role"), F.col("caller").alias("symbol"), "path", "line"),
        calls.where(F.col("caller") == symbol).select(F.lit("callee"), "callee", "path", "line"),
        deps.where(F.col("target") == module).select(F.lit("importer"), "source", "path", "line"),
        api.where(F.substring_index("qualname", ":", 1) == module).where(F.col("qualname") != symbol).select(F.lit("contract"), "qualname", "path", F.lit(None).cast("int")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    turn = F.row_number().over(Window.partitionBy("role").orderBy("path", "line", "symbol"))
    return rows.distinct().withColumn("_turn", turn).where(F.col("_turn") <= budget).orderBy("_turn", "role").limit(budget).drop("_turn")
