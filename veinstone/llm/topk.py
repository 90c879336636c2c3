"""Exact top-k by tiled matrix products.

Queries are cut into blocks and all vectors into shards; each pair of a block and
a shard is one matrix product. A tile keeps the k best of each query (partial
selection), and the tiles' lists are merged level by level, ``fan`` shards at a
time, so no task sees more than ``fan`` lists of a query.

What is shuffled: with n vectors, m queries and b bytes a vector (components travel
in the narrowest integer type that holds them all), n * b * ceil(m / block) + m * b *
ceil(n / shard) bytes. All pairs of a query set that grows with the table are products
of n * m, so this grows with n * m too, divided by the tile's sides: with 64 components
of one byte, a billion vectors and every 20th as a query, 16 384 by 65 536 tiles
send about 0.25 PB for 6.4e18 multiplications. A tile holds about 200 MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOP = "query_id long, key long, shard long, vec_id long, score long"


def quantize(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, q): floor(scale * x) of every component as long.

    Null ids, null vectors and vectors that hold a null or non-finite component
    are left out; an empty vector stays (all its products are 0); repeated rows stay
    each; an empty table gives no rows; other columns are ignored.
    """
    x = F.col(vector_col).cast("array<double>")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("_x"))
        .where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull())
        .where(F.coalesce(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)))
        .select("vec_id", F.transform("_x", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("q"))
    )


#: Integer types by the bytes they take; the narrowest one that holds all components travels.
_INTEGERS = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("long", 2**63))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs; shorter vectors are filled with zeros."""
    arr = column.combine_chunks()
    lengths = np.diff(arr.offsets.to_numpy())
    flat = arr.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(arr), width), dtype=np.int64)
    if len(flat):
        if (lengths == width).all():
            return flat.reshape(-1, width)
        rows = np.repeat(np.arange(len(arr)), lengths)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, cols] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray):
    """A function of a slice of ``a``'s rows that gives exact integer products with all of b:
    as doubles while they stay below 2**53, else as longs, else as Python integers held to
    the range of a long."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in (a, b)]
    bound = most[0] * most[1] * max(1, a.shape[1])
    if bound < 2**52:
        x, y = a.astype(np.float64), np.ascontiguousarray(b.astype(np.float64).T)
        return lambda rows: (x[rows] @ y).astype(np.int64)
    if bound < 2**62:
        return lambda rows: a[rows] @ b.T
    x, y = a.astype(object), b.astype(object).T
    return lambda rows: np.clip(x[rows] @ y, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(ids_q: np.ndarray, q: np.ndarray, ids_v: np.ndarray, v: np.ndarray, k: int, step: int = 64):
    """The k best of one shard for each query of one block, as (row of the query, vec_id,
    score); ties to the smaller id."""
    order = np.argsort(ids_v, kind="stable")
    ids_v, v = ids_v[order], v[order]
    n = len(ids_v)
    product = _products(q, v)
    for at in range(0, len(ids_q), step):
        ids = ids_q[at : at + step]
        s = product(slice(at, at + step))
        own = ids[:, None] == ids_v[None, :]
        if np.abs(s).max(initial=0) < 2**62 // max(1, n):
            key = s * n + (n - 1 - np.arange(n))  # no two are equal: score first, then smaller id
            key[own] = np.iinfo(np.int64).min
            if n > k:
                best = np.argpartition(key, n - k, axis=1)[:, n - k :]
            else:
                best = np.broadcast_to(np.arange(n), key.shape)
        else:
            most = k + int(own.sum(axis=1).max(initial=0))
            best = np.array([np.lexsort((ids_v, -row.astype(object)))[:most] for row in s])
        rows = np.repeat(np.arange(len(ids)), best.shape[1])
        cols = best.ravel()
        ok = ~own[rows, cols]
        yield at + rows[ok], ids_v[cols[ok]], s[rows[ok], cols[ok]]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 16_384, shard: int = 65_536, fan: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products.

    ``vectors`` and ``queries`` are (vec_id, q) as :func:`quantize` makes them. Rows
    with a query's own vec_id are no candidates. Shorter vectors count as filled with
    zeros. Rows of a repeated vec_id are candidates each. Query rows with the same
    vec_id and vector are one query; those with the same vec_id and another vector have
    a full list each. Empty tables give no rows. Shards get smaller than ``shard`` while
    there would be fewer than 16, so that small tables are dealt out too.
    """
    queries = queries.distinct()
    largest = F.max(F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0))), F.abs(F.coalesce(F.array_min("q"), F.lit(0)))))
    one = vectors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("w"), largest.alias("most")).collect()[0]
    other = queries.agg(F.count("*").alias("m"), F.max(F.size("q")).alias("w"), largest.alias("most")).collect()[0]
    width, most = max(one.w or 0, other.w or 0), max(one.most or 0, other.most or 0)
    kind = next(t for t, top in _INTEGERS if most < top)
    shards, blocks = max(1, -(-one.n // shard), min(16, one.n // 1024)), max(1, -(-other.m // block))
    q = F.col("q").cast(f"array<{kind}>")
    tile_q = queries.select(F.col("vec_id").alias("id_q"), q.alias("q_q"), F.xxhash64("q", F.lit(4)).alias("key"), F.pmod(F.xxhash64("vec_id", "q", F.lit(1)), F.lit(blocks)).alias("b")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s")
    )
    tile_v = vectors.select(F.col("vec_id").alias("id_v"), q.alias("q_v"), F.pmod(F.xxhash64("vec_id", "q", F.lit(2)), F.lit(shards)).alias("s")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b")
    )

    def product(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = ()
        ids, keys = left.column("id_q").to_numpy(), left.column("key").to_numpy()
        if left.num_rows and right.num_rows:
            parts = tuple(tile_top(ids, _matrix(left.column("q_q"), width), right.column("id_v").to_numpy(), _matrix(right.column("q_v"), width), k))
        cat = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": ids[cat[0]], "key": keys[cat[0]], "shard": np.full(len(cat[0]), key[1].as_py(), np.int64), "vec_id": cat[1], "score": cat[2]})

    top = tile_q.groupBy("b", "s").cogroup(tile_v.groupBy("b", "s")).applyInArrow(product, _TOP)
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > fan:
        shards = -(-shards // fan)
        top = top.withColumn("shard", F.floor(F.col("shard") / fan))
        w = Window.partitionBy("query_id", "key", "shard").orderBy(*best)
        top = top.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    w = Window.partitionBy("query_id", "key").orderBy(*best)
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
