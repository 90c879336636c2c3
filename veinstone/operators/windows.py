"""Ordered operators shared by the families: intervals, greedy folds, percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut_lineage


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """2.4.4: ranges that overlap or touch (start <= end + 1) become one row with the
    other columns of its first row. Gaps and islands over a running maximum."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    past = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = [c for c in df.columns if c not in (*keys, start, end)]
    marked = df.withColumn("_island", F.sum(F.when(F.col(start) <= past + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by(c, F.struct(start, end)).alias(c) for c in rest]
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"), *first).drop("_island")


def greedy_starts(starts: Column, gap: int, most: int) -> Column:
    """2.3.11: starts at least ``gap`` after the last kept one, the first ``most``."""
    kept = F.aggregate(
        starts,
        F.array().cast("array<int>"),
        lambda acc, s: F.when((F.size(acc) == 0) | (s - F.element_at(acc, F.greatest(F.lit(1), F.size(acc))) >= gap), F.array_append(acc, s)).otherwise(acc),
    )
    return F.slice(kept, 1, most)


def outermost(spans: Column) -> Column:
    """2.5.2: of spans sorted by (start, -end), those that begin after the last kept end."""
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,neg_end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) == 0) | (s["start"] > -F.element_at(acc, F.greatest(F.lit(1), F.size(acc)))["neg_end"]), F.array_append(acc, s)
        ).otherwise(acc),
    )


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _n, _upto, _all): rows with each value, rows up to it, rows of the group.
    The window runs over the distinct values of a group, not over its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(group))


def ranked(df: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at some places (from 1, by a function of the count) of each group's sorted
    values, without gathering them. Nulls are left out."""
    c = value_counts(df, by, value)
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= place(F.col("_all")), F.col(value))).alias(name) for name, place in places.items()])


def nearest_place(q: float) -> Callable[[Column], Column]:
    """2.6.30: element round-half-even(q * (n - 1))."""
    return lambda n: F.bround(F.lit(q) * (n - 1), 0) + 1


def floor_place(q: float) -> Callable[[Column], Column]:
    """2.6.46: element floor(q * (n - 1))."""
    return lambda n: F.floor(F.lit(q) * (n - 1)) + 1


def with_midrank(df: DataFrame, value: str, name: str, digits: int = 4) -> DataFrame:
    """2.6.13: ((rank - 1) + (rank - 1 + ties) - 1) / 2 / (n - 1); 1 for a single row. Ranks
    come from the counts of the distinct values, which are joined back; nulls rank first."""
    key, flag = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNull()
    rows = df.withColumn("_null", flag).withColumn("_key", key)
    c = rows.groupBy("_null", "_key").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(F.desc("_null"), "_key").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_below", upto - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    rank = F.when(F.col("_all") == 1, F.lit(1.0)).otherwise(F.bround((F.col("_below") * 2 + F.col("_n") - 1) / 2 / (F.col("_all") - 1), digits))
    c = c.select(F.col("_null").alias("_null2"), F.col("_key").alias("_key2"), rank.alias(name))
    return rows.join(c, (F.col("_null") == F.col("_null2")) & (F.col("_key") == F.col("_key2"))).drop("_null", "_key", "_null2", "_key2")


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Sums over all rows before each one in a total order, without a window over all rows: a
    sort by ranges, sums inside each partition, and the sums of the partitions before it."""
    rows = cut_lineage(df.withColumns({f"_of_{n}": c for n, c in totals.items()}).orderBy(*order))
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sums = rows.groupBy("_part").agg(*[F.sum(f"_of_{n}").alias(n) for n in totals])  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sums.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals]))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(inside), F.lit(0)) for n in totals}).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    out = out.withColumns({n: F.col(f"_before_{n}") + F.col(n) for n in totals})
    return out.drop("_part", "_at", "_p", *[f"_of_{n}" for n in totals], *[f"_before_{n}" for n in totals])


def numbered(df: DataFrame, order: list[Column], name: str = "rank", kind: str = "int") -> DataFrame:
    """Place of every row in a total order, from 1, by :func:`running_totals`."""
    return running_totals(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast(kind))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
