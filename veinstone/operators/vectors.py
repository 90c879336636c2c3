"""Vector search, clusters and their diagnostics (2.12, 2.9.13 to 2.9.18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions.scalars import euclidean, l2_normal, membership_digest
from veinstone.operators.graph import components
from veinstone.operators.windows import numbered
from veinstone.session import cut_lineage, small


def centroids(items: DataFrame, label: str, vector: str) -> DataFrame:
    """2.12.7: mean vector of each cluster (label >= 0), averaged by position."""
    parts = items.where(F.col(label) >= 0).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def medoids(items: DataFrame, label: str, ident: str, vector: str) -> DataFrame:
    """2.9.14: the member nearest to its cluster's centroid in the mean, ties to the smaller id.

    The mean squared distance to all members is the squared distance to the centroid
    plus a constant, so no pairs are made."""
    c = cut_lineage(centroids(items, label, vector))
    d = items.join(small(c), label).select(label, ident, F.round(euclidean(F.col(vector).cast("array<double>"), F.col("centroid")), 9).alias("distance"))
    return d.groupBy(label).agg(F.min(F.struct("distance", ident)).alias("m"), F.count("*").alias("size"), F.collect_list(ident).alias("ids")).select(
        label, F.col(f"m.{ident}").alias("medoid"), F.round("m.distance", 6).alias("distance"), "size", membership_digest(F.col("ids").cast("array<string>")).alias("digest")
    )


def canonical_order(clusters: DataFrame, label: str) -> DataFrame:
    """2.9.15, 2.9.16: display ids from 1 by size, medoid and digest; none for noise."""
    rows = numbered(clusters, [(F.col(label) < 0).asc(), F.desc("size"), F.asc("medoid"), F.asc("digest")], "display_id")
    return rows.withColumn("display_id", F.when(F.col(label) >= 0, F.col("display_id")))


def nearest_clusters(c: DataFrame, label: str, k: int = 3) -> DataFrame:
    """2.9.17: the k closest other centroids; at most 10 000 clusters, else an error."""
    c = cut_lineage(c)
    if c.count() > 10_000:
        raise ValueError("too many clusters to compare each with all")
    other = c.select(F.col(label).alias("other"), F.col("centroid").alias("c2"))
    d = c.join(F.broadcast(other), F.col(label) != F.col("other")).select(label, "other", F.round(euclidean(F.col("centroid"), F.col("c2")), 6).alias("distance"))
    w = Window.partitionBy(label).orderBy("distance", "other")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representatives(items: DataFrame, label: str, ident: str, vector: str, k: int = 3) -> DataFrame:
    """2.9.18: the k members closest to the centroid and the k farthest ones."""
    d = items.join(small(cut_lineage(centroids(items, label, vector))), label).select(label, ident, F.round(euclidean(F.col(vector).cast("array<double>"), F.col("centroid")), 6).alias("distance"))
    near, far = (d.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(o, ident))).where(F.col("_r") <= k).drop("_r") for o in (F.asc("distance"), F.desc("distance")))
    far = far.join(near.select(F.col(label).alias("_l"), F.col(ident).alias("_i")), (F.col(label) == F.col("_l")) & F.col(ident).eqNullSafe(F.col("_i")), "left_anti")
    return near.withColumn("role", F.lit("representative")).unionByName(far.withColumn("role", F.lit("boundary")))


def knn(items: DataFrame, query: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """2.12.11: the k nearest items of each query (qid, qv) and the score 1 / (1 + distance),
    distances to six digits, ties to the smaller ident. Exact, through the cells of
    ``neighbours``: a query skips those that cannot hold a nearer item. Items and queries
    without a vector take no part; idents and qids are whole numbers."""
    from veinstone.operators import neighbours as N

    rows = items.where(F.col(vector).isNotNull()).select(F.lit(0).alias("space"), F.col(ident).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v"))
    asked = query.where("qv IS NOT NULL").select(F.lit(0).alias("space"), F.col("qid").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv"))
    cells = N.in_cells(rows)
    if not cells.pivots:
        return query.select("qid", F.col("qid").alias(ident), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    found, _ = N.nearest(asked, cells, k, with_self=True, digits=6)
    return found.select(F.col("q").alias("qid"), F.col("node").alias(ident), F.col("d").alias("distance"), "rank", F.round(F.lit(1.0) / (F.lit(1.0) + F.col("d")), 6).alias("score"))


def collapse_chunks(hits: DataFrame, parent: str, score: str, k: int) -> DataFrame:
    """2.9.13: the best score of each parent, the k best parents."""
    return hits.groupBy(parent).agg(F.max(score).alias(score)).orderBy(F.desc(score), parent).limit(k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """2.12.12, 2.1.9: rows of ``new`` replace those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def revision_diff(index: DataFrame, source: DataFrame) -> DataFrame:
    """2.12.14, 2.12.15: (id, action) by revision and model: add, update, keep or delete."""
    i = index.select(F.col("id").alias("a"), F.col("revision").alias("ra"), F.col("model").alias("ma"))
    s = source.select(F.col("id").alias("b"), F.col("revision").alias("rb"), F.col("model").alias("mb"))
    same = F.col("ra").eqNullSafe(F.col("rb")) & F.col("ma").eqNullSafe(F.col("mb")) & (F.coalesce("rb", F.lit("")) != "")
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "delete").when(same, "keep").otherwise("update")
    return i.join(s, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("id"), action.alias("action"))


def chunk_rows(rows: DataFrame, ident: str, text: str, size: int) -> DataFrame:
    """2.12.16: one row, or a row for each chunk, named id:chunk:NNN."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size)).cast("int"))
    r = rows.select(ident, text, n.alias("chunks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    name = F.when(F.col("chunks") == 1, F.concat(F.lit("trajectory:"), F.col(ident).cast("string"))).otherwise(F.concat(F.lit("trajectory:"), F.col(ident).cast("string"), F.lit(":chunk:"), F.lpad(F.col("i").cast("string"), 3, "0")))
    return r.select(name.alias("row_id"), ident, F.col("i").alias("chunk_index"), F.col("chunks").alias("chunk_count"), F.substring(F.col(text), F.col("i") * size + 1, F.lit(size)).alias("chunk"))


def sweep_grid(items: DataFrame, vector: str) -> DataFrame:
    """2.12.2, 2.12.3: candidate parameters (3 x 4 x 3 x 2) for these vectors, without those
    that become the same: no more dimensions than the vectors have or rows less one, no
    more samples than the least size. Fewer than two vectors have no candidates."""
    size = items.where(F.col(vector).isNotNull()).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"))
    g = size.where("n > 1")
    for name, values in (("dims", (8, 16, 32)), ("min_size", (5, 10, 15, 25)), ("min_samples", (1, 5, 10)), ("method", ("eom", "leaf"))):
        g = g.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    most = F.least(F.col("n") - 1, F.col("d"))
    g = g.select(F.least(F.col("dims").cast("long"), most).cast("int").alias("dims"), "min_size", F.least("min_samples", "min_size").alias("min_samples"), "method")
    return g.distinct()


def sweep_score(clusters: Column, noise: Column) -> Column:
    """2.12.4."""
    return F.least(clusters, F.lit(12)) / 12 - noise


def profile_rank(profiles: DataFrame, weights: dict[str, float]) -> DataFrame:
    """2.12.6: weighted sum of columns, each over its largest value."""
    tops = profiles.agg(*[F.max(c).alias(f"_top_{c}") for c in weights])
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.when(F.col(f"_top_{c}") > 0, F.col(c) / F.col(f"_top_{c}")).otherwise(0.0) * w
    r = profiles.join(F.broadcast(tops)).withColumn("score", F.round(total, 6)).select(*profiles.columns, "score")
    return numbered(r, [F.desc("score"), F.asc("profile")])


def partition_validity(assigned: DataFrame, summaries: DataFrame, least: int) -> DataFrame:
    """2.12.9: names of the checks that fail, and how many clusters or items fail each:
    every item once, every cluster summarised, member digests as stored, least size,
    finite strengths. A digest is one over the sorted ids of a cluster, so these (and
    nothing else of the rows) meet in one task a cluster."""
    ids = assigned.groupBy("item").agg(F.count("*").alias("n"), F.count_if(F.isnan("strength") | F.col("strength").isNull()).alias("odd"))
    ids = ids.agg(F.count_if(F.col("n") > 1).alias("coverage"), F.coalesce(F.sum("odd"), F.lit(0)).alias("finite"))
    own = assigned.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"), membership_digest(F.collect_list(F.col("item").cast("string"))).alias("d"))
    j = own.join(summaries, "label", "full_outer")
    c = j.agg(
        F.count_if(F.col("n").isNull() | F.col("digest").isNull()).alias("summary_links"), F.count_if(F.col("d") != F.col("digest")).alias("membership_digest"),
        F.count_if(F.col("n") < least).alias("least_size"),
    )
    names = ["coverage", "finite", "least_size", "membership_digest", "summary_links"]
    rows = ids.join(F.broadcast(c)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("failed"), F.col(n).cast("long").alias("n")) for n in names])).alias("x"))
    return rows.select("x.*").where("n > 0")


def principal_axes(items: DataFrame, vector: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first ``dims`` principal axes of all vectors of one length. Each task sums
    its products; the sums of pairs of coordinates (length squared, whatever the rows) are
    all that reaches the driver. An axis points where its largest coordinate is positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                x = rows.flatten().to_numpy().reshape(len(rows), -1)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "x"])

    parts = items.select(F.col(vector).cast("array<double>")).mapInArrow(run, "i int, j int, x double")
    sums = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    if not sums:
        return np.zeros(0), np.zeros((0, 0))
    size = max(r.i for r in sums) + 1
    total = np.zeros((size, size))
    for r in sums:
        total[r.i, r.j] = r.x
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    values, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values, kind="stable")[:dims]].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * np.where(signs == 0, 1, signs)[:, None]


def project(items: DataFrame, vector: str, dims: int, out: str = "projected") -> DataFrame:
    """2.12.1, the first step: vectors scaled to length 1 and then given by their first ``dims``
    principal coordinates. Null vectors stay null; an empty table stays empty."""
    scaled = items.withColumn("_unit", l2_normal(F.col(vector).cast("array<double>")))
    mean, axes = principal_axes(scaled, "_unit", dims)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in axes]) if len(axes) else F.array().cast("array<array<double>>")
    centre = F.array(*[F.lit(float(x)) for x in mean]) if len(mean) else F.array().cast("array<double>")
    moved = F.zip_with("_unit", centre, lambda a, b: a - b)
    coordinate = lambda axis: F.aggregate(F.zip_with("_moved", axis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return scaled.withColumn("_moved", moved).withColumn(out, F.when(F.col("_unit").isNotNull(), F.transform(rows, coordinate))).drop("_unit", "_moved")


def density_clusters(items: DataFrame, ident: str, vector: str, eps: float, least: int) -> DataFrame:
    """2.12.1 in place of HDBSCAN: exact DBSCAN, a point within ``eps`` of ``least`` points (itself
    included) being a core point. Points meet in pairs of parts (:func:`neighbours.close`), as
    products of matrices, but for parts that the triangle inequality keeps apart. No pair leaves
    its task for being near: the first time a task gives counts, and the neighbours of points
    that have fewer than ``least`` there; then, of core points alone, which of them it connects."""
    from veinstone.operators import neighbours as N

    kind = items.schema[ident].dataType.simpleString()
    rows = items.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("d"), F.col(vector).alias("v"))
    sound = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.where(F.col("d").isNotNull() & sound).withColumn("space", F.size("d"))
    known = known.select("space", F.xxhash64("id").alias("node"), "id", F.when(F.size("d") > 0, F.col("v")).otherwise(F.array(F.lit(0.0)).cast(items.schema[vector].dataType)).alias("v"))
    parts = N.in_parts(known)
    if parts is None:
        return rows.select("id", F.lit(None).cast(kind).alias("cluster"))

    def count(table: pa.Table) -> pa.Table:
        left, right = N.sides(table)
        x, y, one = N.matrix(left["v"]), N.matrix(right["v"]), left is right
        across, down, pairs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
        for at, near in N.close(x, y, eps):
            across[at] = near.sum(1)
            i, j = np.nonzero(near & (across[at] < least)[:, None])
            pairs.append((i + at.start, j, np.zeros(len(i), bool)))
            if not one:
                down += near.sum(0)
                i, j = np.nonzero(near & (down < least)[None, :])
                pairs.append((i + at.start, j, np.ones(len(i), bool)))
        i, j, back = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
        keep = ~back | (down[j] < least)
        i, j, back = i[keep], j[keep], back[keep]
        ids, others = left["id"].combine_chunks(), right["id"].combine_chunks()
        few = pa.concat_arrays([ids.take(pa.array(i[~back])), others.take(pa.array(j[back]))])
        near_few = pa.concat_arrays([others.take(pa.array(j[~back])), ids.take(pa.array(i[back]))])
        every = pa.concat_arrays([ids, others.slice(0, 0 if one else len(others))])
        n = np.concatenate([across, down[: 0 if one else len(down)]])
        return pa.table({"id": pa.concat_arrays([every, few]), "n": pa.array(np.concatenate([n, np.zeros(len(few), np.int64)])), "id2": pa.concat_arrays([pa.nulls(len(every), near_few.type), near_few])})

    def connect(table: pa.Table) -> pa.Table:
        left, right = N.sides(table)
        x, y = N.matrix(left["v"]), N.matrix(right["v"])
        first = 0 if left is right else len(x)
        low = np.arange(first + len(y))
        for at, near in N.close(x, y, eps):
            i, j = np.nonzero(near & (low[at][:, None] != low[first:][None, :]))
            N.unite(low, i + at.start, j + first)
        ids = left["id"].combine_chunks() if left is right else pa.concat_arrays([left["id"].combine_chunks(), right["id"].combine_chunks()])
        moved = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": ids.take(pa.array(moved)), "b": ids.take(pa.array(low[moved]))})

    found = cut_lineage(parts.meet(eps).groupBy("lo", "hi").applyInArrow(count, f"id {kind}, n long, id2 {kind}").where("n > 0 OR id2 IS NOT NULL"))
    core = cut_lineage(found.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id"))
    links = cut_lineage(parts.only(core).meet(eps).groupBy("lo", "hi").applyInArrow(connect, f"a {kind}, b {kind}"))
    roots = components(links)
    alone = cut_lineage(core.join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("root", "id").alias("root")))
    edge = found.where("id2 IS NOT NULL").select("id", "id2").join(core, "id", "left_anti").join(alone, F.col("id2") == F.col("node")).groupBy("id").agg(F.min("root").alias("cluster"))
    return rows.select("id").join(alone.select(F.col("node").alias("id"), F.col("root").alias("cluster")).unionByName(edge), "id", "left").select("id", "cluster")
