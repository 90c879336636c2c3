"""Hierarchical density clusters (2.12.1) and the sweep over their parameters (2.12.2 to 2.12.5).

The distance of two points is at least the distance of either to its k-th neighbour (mutual
reachability). Up to ``DENSE`` points a space, a spanning tree of least weight comes from pairs
of parts: the lists of neighbours give a first tree, and every pair the edges that can still
take a place in it. Larger spaces grow theirs in rounds (Boruvka): every component takes its lightest edge out. The edge
comes from stored neighbour lists where these reach far enough to be sure, and else from an
exact search of the cells that may hold a lighter one. Trees of one space differ in nothing but
edges of the same weight, which the next step does not tell apart.

The tree's edges, by rising weight, make the condensed tree: a component of at least
``min_size`` points is a cluster, smaller ones that join it are points that it loses at that
level, and where two clusters join, both end and their parent begins. All joins of one
weight happen at once. The edges come in ranges of at most about ``EDGES`` to a task; what a
component is by then (its cluster, or its few points) is handed from range to range.

Several spaces (projections, numbers of neighbours) and several least sizes go through the
same jobs, and one condensed tree serves both ways of selection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.operators import neighbours as N
from veinstone.operators.graph import components
from veinstone.operators.vectors import project, sweep_score
from veinstone.operators.windows import numbered
from veinstone.session import cut_lineage, drop_checkpoint

#: Edges of one tree that a task condenses at once.
EDGES = 1_000_000
#: Points of a space whose tree comes from pairs of parts: the driver hands its first tree to all tasks, and
#: one task merges what the pairs add, at most 4 million edges.
DENSE = 1 << 17
#: Points in a part, at least and at most, and parts that there are before these are filled.
PART, PARTS = (1024, 16384), 8
#: Rows that limit what may be among the nearest, and points that connect the components of the lists.
FIRST, MET = 1024, 4096
#: The least weight; equal points have infinite density otherwise.
TINY = 1e-9
#: More than the number of any space.
SPACES = 1_000_000


def _core(k, size):
    """The distance to the k-th other point of the sorted list ``near``, to the last one of fewer."""
    return F.coalesce(F.try_element_at("near", F.least(k, F.greatest(size, F.lit(1))))["d"], F.lit(0.0))


def _near(cells: N.Cells, most: int) -> DataFrame:
    """All points with their lists of ``most`` neighbours, nearest first, as ``near``."""
    lists, _ = N.nearest(cells.points.select("space", F.col("node").alias("q"), F.col("v").alias("qv")), cells, most)
    each = lists.groupBy("space", F.col("q").alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "d", "node"))).alias("near"))
    return cells.points.join(each, ["space", "node"], "left")


def reachable(cells: N.Cells, samples: dict[int, tuple[int, ...]], more: int = 6) -> tuple[DataFrame, DataFrame]:
    """Points and edges of the spaces in which clusters are looked for: one for every base space
    and number of samples k, numbered 1000 * base + k (both less than 1000).

    points (space, node, base, v, cell, core, reach): ``core`` is the distance to the k-th
    other point (the last one, if there are fewer); every point within ``reach`` is in the list
    of edges (space, a, b, w). Nodes are numbered anew, by node and space."""
    most = max(k for ks in samples.values() for k in ks) + more
    full = F.create_map(*[F.lit(x) for s in cells.pivots for x in (s, cells.total(s) - 1)])
    ks = F.create_map(*[x for s, k in samples.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in k]))])
    joined = _near(cells, most).withColumn("k", F.explode(ks[F.col("space")]))
    size = F.coalesce(F.size("near"), F.lit(0))
    reach = F.when(size >= full[F.col("space")], F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
    core = _core("k", size)
    number = (F.col("space") * 1000 + F.col("k")).cast("int")
    p = cut_lineage(joined.select(number.alias("space"), (F.col("node") * SPACES + number).alias("node"), F.col("space").alias("base"), "v", "cell", core.alias("core"), reach.alias("reach"), "near"))
    e = p.select("space", "node", "core", F.explode("near").alias("n")).select("space", F.col("node").alias("a"), (F.col("n.node") * SPACES + F.col("space")).alias("b"), "core", F.col("n.d").alias("d"))
    other = p.select(F.col("node").alias("b"), F.col("core").alias("core_b"))
    e = cut_lineage(e.join(other, "b").select("space", "a", "b", F.greatest("d", "core", "core_b").alias("w")))
    return p.drop("near"), e


def least_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of a least spanning tree of some points, one point after the other. The
    points that are not in it are kept together in front, so that a step looks at no others."""
    n = len(x)
    left, near, least = np.arange(1, n), np.zeros(max(n - 1, 0), int), np.full(max(n - 1, 0), np.inf)
    y, other = x[1:].copy(), core[1:].copy()
    a, b, w = np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0), int), np.zeros(max(n - 1, 0))
    at = 0
    for m in range(n - 1, 0, -1):
        d = np.maximum(np.maximum(N.exact(x[at], y[:m]), other[:m]), core[at])
        closer = d < least[:m]
        np.copyto(least[:m], d, where=closer)
        near[:m][closer] = at
        j = int(least[:m].argmin())
        a[m - 1], b[m - 1], w[m - 1] = near[j], left[j], least[j]
        at = left[j]
        for kept in (left, near, least, y, other):
            kept[j] = kept[m - 1]
    return a, b, w


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges, that come by rising weight, are in a least spanning forest of n nodes."""
    low, at, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, int)]
    while len(at := at[low[a[at]] != low[b[at]]]):
        best = np.full(n, len(a))
        for ends in (a, b):
            np.minimum.at(best, low[ends[at]], at)
        kept.append(np.unique(best[best < len(a)]))
        N.unite(low, a[kept[-1]], b[kept[-1]])
    return np.concatenate(kept)


def _in_pairs(points: DataFrame, parts: dict[int, int], *columns: str):
    """Points (space, part, node, v and more) grouped by each pair of parts, one of them theirs (:func:`neighbours.sides`)."""
    n = F.create_map(*[F.lit(x) for item in parts.items() for x in item])[F.col("space")]
    met = points.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    key = ["space", "lo", "hi"]
    met = met.select("space", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "v", *columns)
    return met.repartition(min(sum(p * (p + 1) for p in parts.values()), N.TASKS), *key).groupBy(*key)


def nearest_rows(x: np.ndarray, y: np.ndarray, node: np.ndarray, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x with their k nearest rows of y, by distance, ties to the smaller ``node``; ``same``: x is
    y, and no row is its own neighbour. A limit from the first rows of y leaves few to be sorted."""
    top = min(k, len(y) - same)
    if top < 1 or not len(x):
        return
    off, yy, turned = 2 * N.slack(x, y), (y * y).sum(1), np.ascontiguousarray(-2 * y.T)
    step = max(1, N.AT_ONCE // len(y))
    for start in range(0, len(x), step):
        rows = x[start : start + step]
        d2 = rows @ turned
        d2 += yy
        d2 += (rows * rows).sum(1)[:, None]
        if same:
            d2[np.arange(len(rows)), start + np.arange(len(rows))] = np.inf
        head = d2[:, : max(FIRST, top)]
        limit = np.minimum(np.partition(head, top - 1, axis=1)[:, top - 1] + off, np.finfo(float).max)
        i, j = np.divmod(np.flatnonzero(d2 <= limit[:, None]), len(y))
        found = d2[i, j]
        order = np.lexsort((found, i))
        starts = np.searchsorted(i, np.arange(len(rows)))  # i is sorted as it is
        last = np.minimum(starts + top, np.append(starts[1:], len(i))) - 1
        limit = (np.sqrt(np.maximum(found[order][last], 0.0) + off) + 2 * 10.0**-N.DIGITS) ** 2
        keep = found <= limit[i]  # what rounding may make equal is looked at
        i, j = i[keep], j[keep]
        d = N.exact(rows[i], y[j])
        order = np.lexsort((node[j], d, i))
        i, j, d = i[order], j[order], d[order]
        keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i] < k
        yield i[keep] + start, j[keep], d[keep]


def _near_in_pairs(points: DataFrame, parts: dict[int, int], most: int) -> DataFrame:
    """What :func:`_near` gives, from pairs of parts: every point has one list from each part."""

    def lists(table: pa.Table) -> pa.Table:
        left, right = N.sides(table)
        out = []
        for one, two in [(left, right)] if left is right else [(left, right), (right, left)]:
            node, number = two["node"].to_numpy(), np.zeros(len(one), np.int64)
            j, d = np.zeros(0, int), np.zeros(0)
            got = list(nearest_rows(N.matrix(one["v"]), N.matrix(two["v"]), node, most, left is right))
            if got:
                i, j, d = (np.concatenate(c) for c in zip(*got, strict=True))
                number = np.bincount(i, minlength=len(one))
            near = pa.StructArray.from_arrays([pa.array(d), pa.array(node[j])], ["d", "node"])
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), near)
            out.append(pa.table({"space": one["space"], "node": one["node"], "near": near}))
        return pa.concat_tables(out)

    found = _in_pairs(points, parts).applyInArrow(lists, "space int, node long, near array<struct<d: double, node: long>>")
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, most)
    return points.join(found.groupBy("space", "node").agg(near.alias("near")), ["space", "node"])


def leaves(n: int, a: list[int], b: list[int], w: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The n nodes of a tree, whose edges come by rising weight, in an order in which every component
    of any weight is a run, and the gap after each: the heaviest edge between two nodes is the
    highest gap between their places."""
    root, head, tail, size, after = list(range(n)), list(range(n)), list(range(n)), [1] * n, [-1] * n
    gap = [float("inf")] * n
    x = 0
    for x, y, weight in zip(a, b, w, strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if size[x] < size[y]:
            x, y = y, x
        after[tail[x]], gap[tail[x]] = head[y], weight
        tail[x], root[y] = tail[y], x
        size[x] += size[y]
    while root[x] != x:
        x = root[x]
    order, at = [], head[x]
    while at >= 0:
        order.append(at)
        at = after[at]
    return np.array(order), np.array(gap)[order]


class Highest:
    """The highest of the gaps between places, from maxima over runs of every power of two."""

    def __init__(self, gap: np.ndarray) -> None:
        levels = [gap]
        while (step := 1 << (len(levels) - 1)) < len(gap):
            levels.append(np.maximum(levels[-1], np.append(levels[-1][step:], np.full(step, np.inf))))
        self.levels = np.stack(levels)

    def __call__(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        low, high = np.minimum(p, q), np.maximum(p, q)
        level = np.frexp(np.maximum(high - low, 1).astype(float))[1] - 1
        return np.where(low == high, 0.0, np.maximum(self.levels[level, low], self.levels[level, np.maximum(high - (1 << level), 0)]))


def lighter(x: np.ndarray, y: np.ndarray, same: bool, cores: list[tuple[np.ndarray, np.ndarray]], places: list[tuple[np.ndarray, np.ndarray]], highest: list[Highest]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree, the edges (row of x, row of y, weight) that are lighter than the heaviest one on the
    tree's way between their ends, or a least forest of these.

    No way is heavier than the heavier of the two through a third point, so most pairs need no look at their own."""
    off, yy, turned, n = 2 * N.slack(x, y), (y * y).sum(1), np.ascontiguousarray(-2 * y.T), len(x)
    through = []
    for (cx, cy), (px, py), high in zip(cores, places, highest, strict=True):
        third = px[cx.argmin()] if cx.min() <= cy.min() else py[cy.argmin()]
        through.append([high(p, np.full(len(p), third)) ** 2 + off for p in (px, py)])
    kept = [[] for _ in cores]
    step = max(1, N.AT_ONCE // len(y))
    for start in range(0, n, step):
        from_ = start if same else 0
        rows = x[start : start + step]
        d2 = rows @ turned[:, from_:]
        d2 += yy[from_:]
        d2 += (rows * rows).sum(1)[:, None]
        for t, ((cx, cy), (px, py), high) in enumerate(zip(cores, places, highest, strict=True)):
            ax, ay = through[t]
            where = np.flatnonzero(d2 < np.maximum(ax[start : start + step, None], ay[None, from_:]))
            for at in range(0, len(where), N.AT_ONCE):
                i, j = np.divmod(where[at : at + N.AT_ONCE], d2.shape[1])
                near, i, j = d2[i, j], i + start, j + from_
                most, core = high(px[i], py[j]), np.maximum(cx[i], cy[j])
                keep = (core < most) & (near < most * most + off)
                keep &= (i < j) if same else True
                i, j, core, most = i[keep], j[keep], core[keep], most[keep]
                w = np.maximum(N.exact(x[i], y[j]), core)
                keep = w < most
                kept[t].append((i[keep], j[keep], w[keep]))
            if sum(len(e[0]) for e in kept[t]) > 8 * (n + len(y)):
                kept[t] = [_least(n, len(y), same, kept[t])]
    return [_least(n, len(y), same, e) for e in kept]


def _least(n: int, m: int, same: bool, edges: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, w = (np.concatenate(c) for c in zip((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *edges, strict=True))
    order = np.argsort(w, kind="stable")
    order = order[forest(n if same else n + m, i[order], j[order] if same else j[order] + n)]
    return i[order], j[order], w[order]


def tree_of_pairs(cells: N.Cells, samples: dict[int, tuple[int, ...]], more: int = 2) -> tuple[DataFrame, DataFrame]:
    """(space, node) and (space, lo, hi, w): the nodes and the edges of a least spanning tree of
    each space, numbered as in :func:`reachable`.

    A first tree comes from the lists of neighbours, and where these leave components, from a
    few points of each. Then all points meet in pairs of parts, which give the edges that are lighter than
    the first tree's way between their ends: no others can take an edge's place in it. One task a
    space merges these: points times parts, not pairs of points."""
    size = F.coalesce(F.size("near"), F.lit(0))
    ks = F.create_map(*[x for s, k in samples.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in k]))])
    cores = F.transform(ks[F.col("space")], lambda k: _core(k, size))
    total = {s: cells.total(s) for s in cells.pivots}
    side = {s: min(max(-(-n // PARTS), PART[0]), PART[1]) for s, n in total.items()}
    parts = {s: max(1, -(-n // side[s])) for s, n in total.items()}
    n = F.create_map(*[F.lit(x) for item in parts.items() for x in item])[F.col("space")]
    dealt = cells.points.select("space", F.pmod(F.xxhash64("node"), n).cast("int").alias("part"), "node", "v")
    points = cut_lineage(_near_in_pairs(dealt, parts, max(k for ks in samples.values() for k in ks) + more).select("space", "node", "v", "near", cores.alias("cores")))

    def listed(table: pa.Table) -> pa.Table:
        """The least forest of the lists, and some points of each of its components (no hi)."""
        table = table.sort_by("node")
        base, node, cores = table["space"][0].as_py(), table["node"].to_numpy(), N.matrix(table["cores"])
        near = table["near"].combine_chunks()
        a, flat = np.repeat(np.arange(len(node)), near.value_lengths().to_numpy()), near.flatten()
        b, d = np.searchsorted(node, flat.field("node").to_numpy()), flat.field("d").to_numpy()
        low, out = np.arange(len(node)), []
        for k, core in zip(samples[base], cores.T, strict=True):
            w = np.maximum(np.maximum(d, core[a]), core[b])
            order = np.argsort(w, kind="stable")
            order = order[forest(len(node), a[order], b[order])]
            N.unite(low, a[order], b[order])
            out.append(pa.table({"space": pa.array(np.full(len(order), 1000 * base + k, np.int32)), "lo": node[a[order]], "hi": node[b[order]], "w": w[order]}))
        order = np.lexsort((np.random.default_rng(0).random(len(low)), low))
        _, first, length = np.unique(low[order], return_index=True, return_counts=True)
        few = order[np.arange(len(low)) - np.repeat(first, length) < max(1, MET // len(first))]
        out.append(pa.table({"space": pa.array(np.full(len(few), base, np.int32)), "lo": node[few], "hi": pa.nulls(len(few), pa.int64()), "w": pa.nulls(len(few), pa.float64())}))
        return pa.concat_tables(out)

    def connect(edges: pa.Table, few: pa.Table) -> pa.Table:
        """A tree (lo, hi, w) of the forest and the points that connect it, and its leaves (node, gap)."""
        few = few.sort_by("node")
        number, some = few["space"][0].as_py(), few["node"].to_numpy()
        a, b, w = least_tree(N.matrix(few["v"]), few["core"].to_numpy())
        lo, hi, w = np.concatenate([edges["lo"].to_numpy(), some[a]]), np.concatenate([edges["hi"].to_numpy(), some[b]]), np.concatenate([edges["w"].to_numpy(), w])
        names, ends = np.unique(np.concatenate([lo, hi, some]), return_inverse=True)
        order = np.argsort(w, kind="stable")
        a, b = ends[: len(lo)][order], ends[len(lo) : 2 * len(lo)][order]
        tree = np.sort(forest(len(names), a, b))
        at, gap = leaves(len(names), a[tree].tolist(), b[tree].tolist(), w[order[tree]].tolist())
        pad = pa.nulls(1, pa.int64())
        return pa.table({
            "space": pa.array(np.full(len(names), number, np.int32)), "place": np.arange(len(names)), "node": names[at], "gap": gap,
            "lo": pa.chunked_array([names[a[tree]], pad]), "hi": pa.chunked_array([names[b[tree]], pad]), "w": pa.chunked_array([w[order[tree]], pad.cast(pa.float64())]),
        })

    schema = "space int, lo long, hi long, w double"
    first = cut_lineage(points.select("space", "node", "cores", "near").groupBy("space").applyInArrow(listed, schema))
    some = first.where("hi IS NULL").select("space", F.col("lo").alias("node")).join(points, ["space", "node"])
    some = some.select((F.col("space") * 1000).alias("base"), "node", "v", F.explode(F.arrays_zip(ks[F.col("space")].alias("k"), F.col("cores").alias("core"))).alias("z"))
    some = some.select((F.col("base") + F.col("z.k")).cast("int").alias("space"), "node", "v", "z.core")
    rough = first.where("hi IS NOT NULL").groupBy("space").cogroup(some.groupBy("space"))
    rough = cut_lineage(rough.applyInArrow(connect, "space int, place long, node long, gap double, lo long, hi long, w double"), first)
    table = rough.select("space", "place", "node", "gap").toArrow()  # at most DENSE rows a space
    numbers, nodes, orders = table["space"].to_numpy(), {}, {}
    for number in np.unique(numbers):
        rows = table.filter(pa.array(numbers == number)).sort_by("place")
        node = rows["node"].to_numpy()
        nodes[int(number) // 1000] = np.sort(node)
        orders[int(number)] = (np.argsort(node).astype(np.int32), rows["gap"].to_numpy())

    def pair(table: pa.Table) -> pa.Table:
        left, right = N.sides(table)
        base, same = table["space"][0].as_py(), left is right
        ends = [t["node"].to_numpy() for t in (left, right)]
        trees = [orders[1000 * base + k] for k in samples[base]]
        at = [np.searchsorted(nodes[base], e) for e in ends]
        core = [np.ascontiguousarray(N.matrix(t["cores"]).T) for t in (left, right)]
        out = [pa.table({"space": pa.array([], pa.int32()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})]
        if len(left) and len(right):
            found = lighter(N.matrix(left["v"]), N.matrix(right["v"]), same, list(zip(*core, strict=True)), [tuple(p[i] for i in at) for p, _ in trees], [Highest(gap) for _, gap in trees])
            for k, (i, j, w) in zip(samples[base], found, strict=True):
                out.append(pa.table({"space": pa.array(np.full(len(w), 1000 * base + k, np.int32)), "lo": ends[0][i], "hi": ends[1][j], "w": w}))
        return pa.concat_tables(out)

    def merge(table: pa.Table) -> pa.Table:
        number = table["space"][0].as_py()
        one, two, w = (table[c].to_numpy() for c in ("lo", "hi", "w"))
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        order = np.lexsort((hi, lo, w))
        names, ends = np.unique(np.concatenate([lo[order], hi[order]]), return_inverse=True)
        order = order[forest(len(names), ends[: len(lo)], ends[len(lo) :])]
        return pa.table({"space": table["space"].take(pa.array(order)), "lo": lo[order] * SPACES + number, "hi": hi[order] * SPACES + number, "w": w[order]})

    # parts along the first tree of a space, whose points have light ways to each other
    along = F.create_map(*[x for s, k in samples.items() for x in (F.lit(1000 * s + k[0]), F.lit(side[s]))])[F.col("space")]
    place = rough.select("space", "node", "place").withColumn("side", along).where("side IS NOT NULL").select(F.expr("space div 1000").cast("int").alias("space"), "node", F.expr("place div side").cast("int").alias("part"))
    found = _in_pairs(points.drop("near").join(place, ["space", "node"]), parts, "cores").applyInArrow(pair, schema)
    tree = found.unionByName(rough.where("lo IS NOT NULL").select("space", "lo", "hi", "w")).groupBy("space").applyInArrow(merge, schema)
    spaces = points.withColumn("k", F.explode(ks[F.col("space")])).withColumn("number", (F.col("space") * 1000 + F.col("k")).cast("int"))
    return spaces.select(F.col("number").alias("space"), (F.col("node") * SPACES + F.col("number")).alias("node")), cut_lineage(tree, rough)


def _edge(other: str = "cb"):
    """An edge by weight and both ends, and the component that it leads to."""
    return F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), other)


def spanning_tree(points: DataFrame, listed: DataFrame, cells: N.Cells) -> DataFrame:
    """(space, lo, hi, w): the edges of the least spanning tree of each space. Rounds double the
    points of a component at least, so there are at most log2 of their number."""
    comp = cut_lineage(points.select("space", "node", F.col("node").alias("comp")))
    e = cut_lineage(listed.select("space", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    tree = None
    while True:
        own = cut_lineage(points.select("space", "node", "base", "v", "cell", "core", "reach").join(comp.drop("space"), "node"))
        least = own.groupBy("space", "base", "comp").agg(F.min(F.greatest("reach", "core")).alias("sure"))
        least = least.withColumn("parts", F.count("*").over(Window.partitionBy("space")))
        best = e.groupBy(F.col("ca").alias("comp")).agg(F.min(_edge()).alias("best"))
        state = cut_lineage(least.where("parts > 1").join(best, "comp", "left").withColumn("ask", F.col("best").isNull() | (F.col("best.w") >= F.col("sure"))))
        if state.isEmpty():
            return tree if tree is not None else points.select("space", F.col("node").alias("lo"), F.col("node").alias("hi"), F.lit(0.0).alias("w")).limit(0)
        found = state.where("best IS NOT NULL").select("space", "comp", "best")
        if not state.where("ask").isEmpty():
            found = found.unionByName(_lightest(own, state.where("ask").select("comp", F.col("best.w").alias("u")), cells))
        chosen = cut_lineage(found.groupBy("space", "comp").agg(F.min("best").alias("best")), state)
        new = chosen.select("space", "best.lo", "best.hi", "best.w").distinct()
        tree = cut_lineage(new) if tree is None else cut_lineage(tree.unionByName(new), tree)
        to = cut_lineage(components(chosen.select(F.col("comp").alias("a"), F.col("best.cb").alias("b"))))
        comp = cut_lineage(comp.join(to.withColumnRenamed("node", "comp"), "comp").select("space", "node", F.col("root").alias("comp")), comp, own)
        ends = [to.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("ca", "cb")]
        e = cut_lineage(e.join(ends[0], "ca").join(ends[1], "cb").where("_ca <> _cb").select("space", "a", "b", "w", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")), e)


def _lightest(own: DataFrame, asked: DataFrame, cells: N.Cells) -> DataFrame:
    """(space, comp, best): the lightest edge out of each asked component (comp, u: the weight
    that it has already, or null), if one of at most u exists.

    A point takes part if neither its list nor its core distance forbids it. First every
    component gets a limit from the cells that are not all its own; then the points visit
    the cells that may hold an edge within it."""
    pure: dict[tuple[int, int], tuple[int, int, float, float]] = {}
    for r in own.groupBy("space", "cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("core").alias("low"), F.max("core").alias("high")).collect():
        pure[r.space, r.cell] = (r.a, r.b, r.low, r.high)
    pivots, radius = cells.pivots, cells.radius

    def limits(batch: pa.RecordBatch) -> Iterator[tuple]:
        space, base, comp, core, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("space", "base", "comp", "core", "u"))
        for s in np.unique(space):
            at = np.flatnonzero(space == s)
            b = int(base[at[0]])
            d, least = N.bounds(N.matrix(batch.column("v").take(pa.array(at))), pivots[b], radius[b])
            here = [pure.get((int(s), c), (-1, -1, np.inf, np.inf)) for c in range(d.shape[1])]
            low, high = np.array([x[2] for x in here]), np.array([x[3] for x in here])
            first, last = np.array([x[0] for x in here]), np.array([x[1] for x in here])
            foreign = (first >= 0) & ~((first == comp[at][:, None]) & (last == comp[at][:, None]))
            most = np.where(foreign & ((first != comp[at][:, None]) & (last != comp[at][:, None])), np.maximum(np.maximum(d + radius[b], high), core[at][:, None]), np.inf)
            yield at, np.where(foreign, np.maximum(least, low), np.inf), most.min(1) * (1 + 1e-9) + 1e-7, u[at]

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, most, _ in limits(batch):
                yield pa.RecordBatch.from_arrays([batch.column("comp").take(pa.array(at)), pa.array(most)], names=["comp", "most"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, least, _, u in limits(batch):
                i, c = np.nonzero(least <= u[:, None])
                rows = batch.take(pa.array(at[i]))
                yield pa.RecordBatch.from_arrays([*[rows.column(x) for x in ("space", "base")], pa.array(c.astype(np.int32)), *[rows.column(x) for x in ("q", "v", "core", "comp", "u")]], names=["space", "base", "cell", "q", "qv", "core", "comp", "u"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = N.matrix(left["qv"]), N.matrix(right["v"])
        q, qcore, qcomp, u, space = (left[c].to_numpy() for c in ("q", "core", "comp", "u", "space"))
        node, core, comp = (right[c].to_numpy() for c in ("node", "core", "comp"))
        i = j = np.zeros(0, int)
        if len(q) and len(node):
            off = 2 * N.slack(x, y)
            d2 = np.maximum(np.maximum(N.squares(x, y), (qcore**2)[:, None]), (core**2)[None, :])
            d2[qcomp[:, None] == comp[None, :]] = np.inf
            # of equally heavy edges the one with the smaller ends is wanted, so all near the least are looked at
            i, j = np.nonzero((d2 <= np.minimum(d2.min(1), u * u)[:, None] + off) & np.isfinite(d2))
        w = np.maximum(np.maximum(N.exact(x[i], y[j]) if len(i) else np.zeros(0), qcore[i]), core[j])
        lo, hi = np.minimum(q[i], node[j]), np.maximum(q[i], node[j])
        order = np.lexsort((hi, lo, w, qcomp[i]))
        order = order[np.concatenate([[True], np.diff(qcomp[i][order]) != 0])] if len(order) else order
        return pa.table({"space": pa.array(space[i][order], pa.int32()), "comp": qcomp[i][order], "w": w[order], "lo": lo[order], "hi": hi[order], "cb": comp[j][order]})

    ask = own.join(asked, "comp").where("u IS NULL OR greatest(reach, core) <= u").select("space", "base", F.col("node").alias("q"), "v", "core", "comp", F.coalesce("u", F.lit(float("inf"))).alias("u"))
    ask = cut_lineage(ask)
    most = ask.select("space", "base", "v", "core", "comp", "u").mapInArrow(limited, "comp long, most double").groupBy("comp").agg(F.min("most").alias("most"))
    ask = ask.join(most, "comp").withColumn("u", F.least("u", "most")).where("core <= u").select("space", "base", "q", "v", "core", "comp", "u")
    go = cut_lineage(ask.mapInArrow(visits, "space int, base int, cell int, q long, qv array<double>, core double, comp long, u double"))
    # cells are those of the base space, and every space of it has all its points
    sizes = N.Cells(cells.points, pivots, radius, cells.members)
    spaces = {s: s // 1000 for s, _ in pure}
    by_space = N.Cells(sizes.points, {s: pivots[b] for s, b in spaces.items()}, {s: radius[b] for s, b in spaces.items()}, {s: cells.members[b] for s, b in spaces.items()})
    edges, _ = N.tiles(go.drop("base"), own.select("space", "cell", "node", "v", "core", "comp"), by_space, compare, "space int, comp long, w double, lo long, hi long, cb long")
    return cut_lineage(edges.select("space", "comp", F.struct("w", "lo", "hi", "cb").alias("best")), ask)


class Condensing:
    """The components of one tree while its edges come by rising weight.

    A small component holds its points; a large one its cluster: [name, sum of lambda, points,
    highest lambda, children's best stability, whether it has children]."""

    def __init__(self, min_size: int, first_name: int) -> None:
        self.min_size, self.name = min_size, first_name
        self.parent: dict[int, int] = {}
        self.state: dict[int, tuple[int, list[int] | None, list | None]] = {}
        self.lost: list[tuple[int, int, float]] = []
        self.clusters: list[tuple] = []

    def find(self, x: int) -> int:
        up = x
        while self.parent.get(up, up) != up:
            up = self.parent[up]
        while self.parent.get(x, x) != up:
            self.parent[x], x = up, self.parent[x]
        return up

    def read(self, edges: list[tuple[float, int, int]]) -> None:
        for w, same in groupby(edges, key=lambda x: x[0]):
            met: dict[int, list[int]] = {}
            of: dict[int, int] = {}
            for _, a, b in same:  # groups of components that edges of this weight join
                a, b = self.find(a), self.find(b)
                x, y = of.setdefault(a, a), of.setdefault(b, b)
                met.setdefault(x, [x])
                met.setdefault(y, [y])
                if x != y:
                    if len(met[x]) < len(met[y]):
                        x, y = y, x
                    for r in met[y]:
                        of[r] = x
                    met[x] += met.pop(y)
            for roots in met.values():
                self.join(roots, 1.0 / max(w, TINY))

    def join(self, roots: list[int], lam: float) -> None:
        parts = [self.state.pop(r, (1, [r], None)) for r in roots]
        size = sum(p[0] for p in parts)
        large = [p for p in parts if p[2] is not None]
        to = min(roots)
        for r in roots:
            self.parent[r] = to
        points = [x for p in parts if p[2] is None for x in p[1]]
        if not large and size < self.min_size:
            self.state[to] = (size, points, None)
            return
        if len(large) == 1:
            cluster = large[0][2]
        else:
            cluster = [self.name, 0.0, 0, 0.0, 0.0, False]
            self.name += 1
            for n, _, child in large:
                cluster[4] += self.close(child, cluster[0], lam)
                cluster[1] += lam * n
                cluster[2] += n
                cluster[5] = True
        if points or len(large) > 1:
            cluster[3] = max(cluster[3], lam)
        cluster[1] += lam * len(points)
        cluster[2] += len(points)
        self.lost += [(x, cluster[0], lam) for x in points]
        self.state[to] = (size, None, cluster)

    def close(self, cluster: list, parent: int | None, birth: float) -> float:
        """Ends a cluster (upwards); the best stability of it and what is below it."""
        name, total, n, top, below, inner = cluster
        stability = total - birth * n
        self.clusters.append((name, parent, n, stability, top, not below > stability, not inner))
        return max(stability, below)


KINDS = "kind string, space int, min_size int, x long, cluster long, lam double, n long, stability double, top double, keep boolean, leaf boolean, below double, points array<long>"


def condense(tree: DataFrame, min_sizes: list[int], edges: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """lost (space, min_size, node, cluster, lam): where each point leaves the clusters, and
    clusters (space, min_size, cluster, parent, n, stability, top, keep, leaf). The largest
    cluster of a space has no parent and is never kept."""
    tree = cut_lineage(tree)
    most = max([r.n for r in tree.groupBy("space").agg(F.count("*").alias("n")).collect()], default=0)
    if not most:
        none = tree.sparkSession.createDataFrame([], KINDS)
        return _lost(none), _clusters(none)
    ranges = -(-most // edges)
    cuts = [c for c in tree.approxQuantile("w", [i / ranges for i in range(1, ranges)], 1e-3)] if ranges > 1 else []
    out, at, state = None, None, None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = tree
        if low is not None:
            part = part.where(F.col("w") > low)
        if high is not None:
            part = part.where(F.col("w") <= high)
        rows = part.select("space", F.explode(F.array(*[F.lit(m) for m in min_sizes])).alias("min_size"), "w", "lo", "hi")
        if at is not None:  # ends by the components that they belong to by now
            for c in ("lo", "hi"):
                now = at.select("space", "min_size", F.col("x").alias(c), F.col("to").alias(f"_{c}"))
                rows = rows.join(now, ["space", "min_size", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        last = k == len(cuts)
        empty = tree.sparkSession.createDataFrame([], KINDS)
        key = ["space", "min_size"]
        got = cut_lineage(rows.groupBy(*key).cogroup((state if state is not None else empty).groupBy(*key)).applyInArrow(_run(k, last), KINDS))
        done = got.where("kind IN ('lost', 'cluster')")
        out = done if out is None else out.unionByName(done)
        if not last:
            state = got.where("kind = 'state'")
            moved = got.where("kind = 'at'").select("space", "min_size", "x", F.col("cluster").alias("to"))
            if at is None:
                at = moved
            else:  # what was in a component that has joined another is in that one now
                more = moved.select("space", "min_size", F.col("x").alias("to"), F.col("to").alias("_to"))
                old = at.join(more, ["space", "min_size", "to"], "left").select("space", "min_size", "x", F.coalesce("_to", "to").alias("to"))
                at = cut_lineage(old.unionByName(moved.join(at.select("space", "min_size", "x"), ["space", "min_size", "x"], "left_anti")), at)
    return _lost(out), _clusters(out)


def _run(k: int, last: bool):
    def run(table: pa.Table, before: pa.Table) -> pa.Table:
        from_ = table if table.num_rows else before
        space, min_size = from_["space"][0].as_py(), from_["min_size"][0].as_py()
        c = Condensing(min_size, k << 40)
        for r in before.to_pylist():
            cluster = None if r["cluster"] is None else [r["cluster"], r["lam"], int(r["stability"]), r["top"], r["below"], not r["leaf"]]
            c.state[r["x"]] = (r["n"], r["points"], cluster)
        seen = set(c.state)
        c.read(sorted(zip(*(table[x].to_pylist() for x in ("w", "lo", "hi")), strict=True)))
        rows = [{"kind": "lost", "x": x, "cluster": name, "lam": lam} for x, name, lam in c.lost]
        if last:
            for _, _, cluster in c.state.values():
                if cluster is not None:
                    c.close(cluster, None, 0.0)
        else:
            ends = seen | set(table["lo"].to_pylist()) | set(table["hi"].to_pylist())
            rows += [{"kind": "at", "x": x, "cluster": c.find(x)} for x in ends]
            for x, (n, points, cluster) in c.state.items():
                row = {"kind": "state", "x": x, "n": n, "points": points}
                if cluster is not None:
                    row |= {"cluster": cluster[0], "lam": cluster[1], "stability": float(cluster[2]), "top": cluster[3], "below": cluster[4], "leaf": not cluster[5]}
                rows.append(row)
        rows += [{"kind": "cluster", "cluster": name, "x": parent, "n": n, "stability": s, "top": top, "keep": keep and parent is not None, "leaf": leaf and parent is not None} for name, parent, n, s, top, keep, leaf in c.clusters]
        return pa.Table.from_pylist([{"space": space, "min_size": min_size, **r} for r in rows], schema=SCHEMA)

    return run


SCHEMA = pa.schema(
    [("kind", pa.string()), ("space", pa.int32()), ("min_size", pa.int32()), ("x", pa.int64()), ("cluster", pa.int64()), ("lam", pa.float64()), ("n", pa.int64()), ("stability", pa.float64()), ("top", pa.float64()),
     ("keep", pa.bool_()), ("leaf", pa.bool_()), ("below", pa.float64()), ("points", pa.list_(pa.int64()))]
)


def _lost(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'lost'").select("space", "min_size", F.col("x").alias("node"), "cluster", "lam")


def _clusters(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'cluster'").select("space", "min_size", "cluster", F.col("x").alias("parent"), "n", "stability", "top", "keep", "leaf")


def selected(clusters: DataFrame) -> DataFrame:
    """(space, min_size, cluster, method, to, top): the selected cluster in which each cluster
    lies, by excess of mass (the topmost that is at least as stable as what is below it) and
    by leaves. Rounds double the steps taken upwards."""
    key = ["space", "min_size"]
    c = cut_lineage(clusters.select(*key, "cluster", F.col("parent").alias("up"), F.when(F.col("keep"), F.col("cluster")).alias("to")))
    while not c.where("up IS NOT NULL").isEmpty():
        above = c.select(*key, F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("to").alias("_to"))
        c = cut_lineage(c.join(above, [*key, "up"], "left").select(*key, "cluster", F.col("_up").alias("up"), F.coalesce("_to", "to").alias("to")), c)
    tops = clusters.select(*key, F.col("cluster").alias("to"), "top")
    eom = c.where("to IS NOT NULL").select(*key, "cluster", F.lit("eom").alias("method"), "to")
    leaf = clusters.where("leaf").select(*key, "cluster", F.lit("leaf").alias("method"), F.col("cluster").alias("to"))
    return eom.unionByName(leaf).join(tops, [*key, "to"])


def clusterings(spaces: DataFrame, samples: dict[int, tuple[int, ...]], min_sizes: list[int], per_cell: int = 1000, edges: int = EDGES) -> DataFrame:
    """(base, samples, min_size, method, node, cluster, strength) of every point of ``spaces``
    (space, node, v) in every clustering; cluster is the smallest node of the cluster, null for
    noise, whose strength is 0."""
    cells = N.in_cells(spaces, per_cell)
    if not cells.pivots:
        return spaces.select(F.col("space").alias("base"), F.lit(0).alias("samples"), F.lit(0).alias("min_size"), F.lit("").alias("method"), "node", F.col("node").alias("cluster"), F.lit(0.0).alias("strength")).limit(0)
    if max(cells.total(s) for s in cells.pivots) <= DENSE:
        points, tree = tree_of_pairs(cells, samples)
    else:
        points, listed = reachable(cells, samples)
        tree = spanning_tree(points, listed, cells)
        drop_checkpoint(listed)
    lost, clusters = condense(tree, min_sizes, edges)
    picked = selected(clusters)
    inside = cut_lineage(lost.join(picked, ["space", "min_size", "cluster"]).select("space", "min_size", "method", "node", "to", F.least(F.lit(1.0), F.col("lam") / F.col("top")).alias("strength")))
    named = inside.groupBy("space", "min_size", "method", "to").agg(F.min("node").alias("cluster"))
    inside = inside.join(named, ["space", "min_size", "method", "to"]).drop("to")
    every = points.select("space", "node").withColumn("min_size", F.explode(F.array(*[F.lit(m) for m in min_sizes]))).withColumn("method", F.explode(F.array(F.lit("eom"), F.lit("leaf"))))
    out = every.join(inside, ["space", "min_size", "method", "node"], "left")
    return out.select(
        F.expr("space div 1000").cast("int").alias("base"), (F.col("space") % 1000).alias("samples"), "min_size", "method", F.expr(f"node div {SPACES}").alias("node"),
        F.expr(f"cluster div {SPACES}").alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )


def _numbered(items: DataFrame, ident: str, vector: str) -> DataFrame:
    """ident, node, v of the rows with a vector: nodes go by ident."""
    rows = items.where(F.col(vector).isNotNull()).select(F.col(ident).alias("ident"), F.col(vector).cast("array<double>").alias("v"))
    return cut_lineage(numbered(rows, [F.asc("ident")], "node", "long"))


def hdbscan(items: DataFrame, ident: str, vector: str, min_size: int = 5, min_samples: int | None = None, method: str = "eom", per_cell: int = 1000) -> DataFrame:
    """2.12.1: ident, cluster, strength of every row with a vector. ``cluster`` is the smallest
    ident of the cluster, null for noise; the strength is the point's density at which it leaves
    over the cluster's highest. Rows need different idents; rows without a vector are left out,
    equal vectors are points of their own; fewer than ``min_size`` rows are noise."""
    rows = _numbered(items, ident, vector)
    k = min_samples or min_size
    out = clusterings(rows.select(F.lit(0).alias("space"), "node", "v"), {0: (k,)}, [min_size], per_cell).where(F.col("method") == method)
    names = rows.select(F.col("node").alias("cluster"), F.col("ident").alias("name"))
    return rows.join(out, "node").join(names, "cluster", "left").select(F.col("ident").alias(ident), F.col("name").alias("cluster"), "strength")


def sweep(items: DataFrame, ident: str, vector: str, grid: DataFrame, per_cell: int = 1000) -> tuple[DataFrame, DataFrame]:
    """2.12.3 to 2.12.5 over real clusterings. grid (dims, min_size, min_samples, method), some
    dozens of rows; results (the same, clusters, noise, score), and the clusterings themselves
    (dims, min_samples, min_size, method, node, cluster, strength) with the idents' nodes.

    The principal axes are computed once, for the most dimensions; fewer are their first ones."""
    wanted = grid.distinct().collect()
    dims = sorted({r.dims for r in wanted})
    rows = _numbered(items, ident, vector)
    full = cut_lineage(project(rows, "v", dims[-1]).select("node", "projected"), rows)
    spaces = full.select(F.explode(F.array(*[F.lit(d) for d in dims])).alias("space"), "node", "projected").select("space", "node", F.slice("projected", 1, F.col("space")).alias("v"))
    samples = {d: tuple(sorted({r.min_samples for r in wanted if r.dims == d})) for d in dims}
    every = clusterings(spaces, samples, sorted({r.min_size for r in wanted}), per_cell).select(F.col("base").alias("dims"), F.col("samples").alias("min_samples"), "min_size", "method", "node", "cluster", "strength")
    key = ["dims", "min_size", "min_samples", "method"]
    every = cut_lineage(every.join(F.broadcast(grid.select(*key).distinct()), key, "left_semi"))
    found = every.groupBy(*key).agg(F.countDistinct("cluster").alias("clusters"), F.avg(F.col("cluster").isNull().cast("double")).alias("noise"))
    return found.withColumn("score", sweep_score(F.col("clusters"), F.col("noise"))), every
