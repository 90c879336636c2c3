"""Clone grouping: hash groups over units, statement windows and segments (2.3, 2.4).

Units are rows of (path, qualname, text); a statement is a line that is not blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators.windows import greedy_starts, merge_intervals


def units(docs: DataFrame, path: Column, qualname: Column, text: Column) -> DataFrame:
    """2.3.8 to 2.3.10 over text: one unit a row, with fingerprint, bucket and raw hash."""
    s = S.statements(text)
    return docs.select(path.alias("path"), qualname.alias("qualname"), text.alias("text"), s.alias("stmts")).select(
        "path", "qualname", "stmts",
        F.size("stmts").alias("stmt_count"),
        F.when(F.size("stmts") > 0, F.element_at("stmts", -1)["line"]).otherwise(0).alias("loc"),
        F.sha1(F.array_join(F.transform("stmts", lambda x: x["norm"]), "|")).alias("fingerprint"),
        S.raw_hash(F.col("text")).alias("raw_hash"),
    ).withColumn("loc_bucket", S.loc_bucket(F.col("loc")))


def eligible(u: DataFrame, min_loc: int = 10, min_stmt: int = 6) -> DataFrame:
    """2.3.3."""
    return u.where((F.col("loc") >= min_loc) & (F.col("stmt_count") >= min_stmt))


def function_groups(u: DataFrame) -> DataFrame:
    """2.4.1, 2.4.12, 2.4.13: groups of units with one fingerprint and bucket.

    Only hashes and names are shuffled; members are counted before the shuffle.
    """
    rows = u.select("path", "qualname", "raw_hash", "fingerprint", F.concat_ws("|", "fingerprint", "loc_bucket").alias("group_key"))
    return (
        rows.groupBy("group_key")
        .agg(
            F.count("*").alias("items"), F.countDistinct("raw_hash").alias("raw_hashes"),
            F.countDistinct("path").alias("files"), F.countDistinct("qualname").alias("functions"),
            F.min("qualname").alias("first_qualname"),
        )
        .where("items > 1")
        .withColumn("group_id", F.concat_ws(":", F.lit("clone"), F.lit("function"), "group_key"))
        .withColumn("clone_type", F.when(F.col("raw_hashes") == 1, "Type-1").otherwise("Type-2"))
    )


def severity(items: Column, clone_type: Column) -> Column:
    """2.4.15: critical from four members on, warning for the exact types, else info."""
    return F.when(items >= 4, "critical").when(clone_type.isin("Type-1", "Type-2"), "warning").otherwise("info")


def group_rows(groups: DataFrame, known: DataFrame | None, effort: float = 2.0) -> DataFrame:
    """2.4.14, 2.4.16: severity, priority and novelty; without a trusted baseline all is new."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    rows = groups.withColumn("severity", severity(F.col("items"), F.col("clone_type"))).withColumn("priority", F.bround(rank / F.lit(effort), 4))
    if known is None:
        return rows.withColumn("novelty", F.lit("new"))
    seen = known.select(F.col("group_key").alias("_known")).distinct()
    rows = rows.join(seen, F.col("group_key") == F.col("_known"), "left")
    return rows.withColumn("novelty", F.when(F.col("_known").isNull(), "new").otherwise("known")).drop("_known")


def windows(u: DataFrame, size: int) -> DataFrame:
    """All windows of ``size`` statements: first and last line and the statement hashes."""
    at = F.sequence(F.lit(0), F.size("stmts") - size)
    w = u.where(F.size("stmts") >= size).select("path", "qualname", "stmts", F.explode(at).alias("at"))
    part = F.slice("stmts", F.col("at") + 1, F.lit(size))
    return w.select(
        "path", "qualname", "at",
        F.element_at(part, 1)["line"].alias("start"), F.element_at(part, -1)["line"].alias("end"),
        F.transform(part, lambda s: F.sha1(s["norm"])).alias("hashes"),
    )


def blocks(u: DataFrame, size: int = 4, most: int = 15) -> DataFrame:
    """2.3.11: windows whose first line is max(size // 2, 3) lines after the last kept one."""
    first = F.transform(F.slice("stmts", F.lit(1), F.greatest(F.lit(0), F.size("stmts") - size + 1)), lambda s: s["line"].cast("int"))
    kept = u.withColumn("_kept", greedy_starts(first, max(size // 2, 3), most))
    at = F.sequence(F.lit(1), F.size("stmts") - size + 1)
    w = kept.where(F.size("stmts") >= size).select("path", "qualname", "stmts", "_kept", F.explode(at).alias("at"))
    w = w.where(F.array_contains("_kept", F.element_at("stmts", F.col("at"))["line"].cast("int")))
    part = F.slice("stmts", F.col("at"), F.lit(size))
    return w.select(
        F.array_join(F.transform(part, lambda s: F.sha1(s["norm"])), "|").alias("block_hash"), "path", "qualname",
        F.element_at(part, 1)["line"].alias("start"), F.element_at(part, -1)["line"].alias("end"), F.lit(size).alias("size"),
    )


def block_groups(b: DataFrame) -> DataFrame:
    """2.4.2: hashes that two qualnames at least have."""
    return b.groupBy("block_hash").agg(F.count("*").alias("items"), F.countDistinct("qualname").alias("functions")).where("functions >= 2")


def segments(u: DataFrame, size: int = 6, most: int = 60) -> DataFrame:
    """2.3.12: ordered and order-free hashes of windows."""
    return windows(u, size).where(F.col("at") < most).select(
        F.sha1(F.array_join("hashes", "|")).alias("segment_hash"), F.sha1(F.array_join(F.array_sort("hashes"), "|")).alias("segment_sig"),
        "path", "qualname", "start", "end",
    )


def segment_groups(s: DataFrame) -> DataFrame:
    """2.4.3: repeats inside one function: sig twice, hash twice, (hash, qualname) twice.

    A pair (hash, qualname) that occurs twice implies the other two counts, so one
    aggregation with a filter suffices.
    """
    key = ["segment_hash", "qualname"]
    return s.groupBy(*key).agg(F.count("*").alias("items"), F.min("segment_sig").alias("segment_sig")).where("items >= 2").withColumn("group_key", F.concat_ws("|", *key))


def merged_segments(s: DataFrame) -> DataFrame:
    """2.4.6: ranges of repeated segments, merged inside each (path, qualname)."""
    again = segment_groups(s).select("segment_hash", "qualname", "group_key")
    rows = s.join(again, ["segment_hash", "qualname"]).select("group_key", "path", "qualname", "start", "end")
    return merge_intervals(rows, ["group_key", "path", "qualname"], "start", "end").withColumn("size", F.col("end") - F.col("start") + 1)


def block_facts(groups: DataFrame) -> DataFrame:
    """2.4.10: shape of a block group's hash pattern."""
    parts = F.split("block_hash", r"\|")
    return groups.select(
        "block_hash", "items", F.size(parts).alias("window"), F.size(F.array_distinct(parts)).alias("distinct_statements"),
        (F.size(F.array_distinct(parts)) == 1).alias("repeated"), (F.col("items") - 1).alias("peers"),
    )


def split_fixtures(members: DataFrame, group: str, path: str, patterns: list[str]) -> DataFrame:
    """2.4.8, 2.4.9: groups with the flag ``suppressed``: every member matches a pattern."""
    match = F.lit(False)
    for p in patterns:
        match = match | F.col(path).rlike(p)
    return members.groupBy(group).agg(F.count("*").alias("items"), F.bool_and(match).alias("suppressed"), F.count_if(match).alias("matched"))


def assert_runs(stmts: DataFrame, ranges: DataFrame) -> DataFrame:
    """2.4.11: statements inside each range (path, start, end): all, assert-like ones and
    the longest run of those. Equi-join on path with a residual range condition."""
    from pyspark.sql import Window

    r = ranges.select(F.col("path").alias("rp"), F.col("start").alias("rs"), F.col("end").alias("re"))
    j = r.join(stmts, (F.col("rp") == F.col("path")) & F.col("line").between(F.col("rs"), F.col("re")), "left")
    w = Window.partitionBy("rp", "rs", "re").orderBy("line")
    j = j.withColumn("seq", F.row_number().over(w)).withColumn("hits", F.sum(F.when(F.col("is_assert"), 1).otherwise(0)).over(w))
    runs = j.withColumn("run", F.when(F.col("is_assert"), F.col("seq") - F.col("hits")))
    each = runs.groupBy("rp", "rs", "re", "run").agg(F.count("line").alias("n"))
    return each.groupBy(F.col("rp").alias("path"), F.col("rs").alias("start"), F.col("re").alias("end")).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("run").isNotNull(), F.col("n"))), F.lit(0)).alias("asserts"),
        F.coalesce(F.max(F.when(F.col("run").isNotNull(), F.col("n"))), F.lit(0)).alias("longest"),
    )
