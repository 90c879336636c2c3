"""Exact neighbours, hierarchical density clusters and the parameter sweep against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone.operators import density as D
from veinstone.operators import neighbours as N
from veinstone.operators import vectors as V
from veinstone.operators.vectors import project


def cloud(n: int, dims: int = 6, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (n // 5, dims)) for c, s in zip(rng.normal(0, 6, (4, dims)), (0.5, 1.0, 1.5, 1.0), strict=True)] + [rng.uniform(-15, 15, (n - 4 * (n // 5), dims))])
    x[3] = x[4]
    x[10:24] = x[9]  # equal points
    return x


def frame(spark, x: np.ndarray):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)


def plain(x: np.ndarray, min_size: int, k: int, method: str) -> tuple[list, list]:
    """Labels and strengths from the full table of distances, from the top down."""
    n = len(x)
    d = np.stack([N.exact(np.repeat(x[i : i + 1], n, 0), x) for i in range(n)])
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    tree, dist, near, left = [], np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at = 0
    left[0] = False
    while left.any():  # the tree, one point after the other
        closer = left & (reach[at] < dist)
        dist[closer], near[closer] = reach[at][closer], at
        at = int(np.where(left, dist, np.inf).argmin())
        tree.append((dist[at], int(near[at]), at))
        left[at] = False
    clusters, lost = {}, {}

    def parts(nodes, edges):
        link = {v: [] for v in nodes}
        for _, a, b in edges:
            link[a].append(b)
            link[b].append(a)
        seen, out = set(), []
        for v in nodes:
            if v not in seen:
                group, todo = [], [v]
                seen.add(v)
                while todo:
                    u = todo.pop()
                    group.append(u)
                    for t in link[u]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                out.append(group)
        return out

    def grow(name, nodes, edges):
        own = clusters[name]
        while True:
            if not edges:
                return
            w = max(e[0] for e in edges)
            lam = 1 / max(w, D.TINY)
            kept = [e for e in edges if e[0] < w]
            groups = parts(nodes, kept)
            large = [g for g in groups if len(g) >= min_size]
            for g in groups:
                if len(g) < min_size:
                    for v in g:
                        lost[v] = (name, lam)
                        own["rows"].append((lam, 1))
            if len(large) == 1:
                nodes = large[0]
                inside = set(nodes)
                edges = [e for e in kept if e[1] in inside]
                continue
            for g in large:
                own["rows"].append((lam, len(g)))
                child = len(clusters)
                clusters[child] = {"parent": name, "birth": lam, "rows": [], "children": []}
                own["children"].append(child)
                inside = set(g)
                grow(child, g, [e for e in kept if e[1] in inside])
            return

    if n >= min_size:
        clusters[0] = {"parent": None, "birth": 0.0, "rows": [], "children": []}
        grow(0, list(range(n)), tree)
    best, keep = {}, {}
    for c in sorted(clusters, reverse=True):
        own = sum((lam - clusters[c]["birth"]) * m for lam, m in clusters[c]["rows"])
        below = sum(best[h] for h in clusters[c]["children"])
        keep[c], best[c] = not below > own, max(own, below)
    members: dict = {}
    for v in range(n):
        c, to = lost.get(v, (None, 0))[0], None
        if method == "leaf":
            to = c if c and not clusters[c]["children"] else None
        else:
            while c:
                to = c if keep[c] else to
                c = clusters[c]["parent"]
        members[v] = to
    first = {}
    for v, c in members.items():
        if c is not None:
            first.setdefault(c, v)
    top = {c: max(lam for lam, _ in clusters[c]["rows"]) for c in first}
    return [first.get(members[v]) for v in range(n)], [0.0 if members[v] is None else min(1.0, lost[v][1] / top[members[v]]) for v in range(n)]


def test_nearest(spark):
    x = cloud(1500)
    cells = N.in_cells(frame(spark, x).select(F.lit(0).alias("space"), F.col("id").alias("node"), "v"), per_cell=60)
    got, share = N.nearest(cells.points.where("node % 3 = 0").select("space", F.col("node").alias("q"), F.col("v").alias("qv")), cells, 7)
    rows: dict = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r["rank"], r.node, r.d))
    assert set(rows) == set(range(0, 1500, 3)) and share < 0.7
    for q, found in rows.items():
        d = N.exact(np.repeat(x[q : q + 1], len(x), 0), x)
        d[q] = np.inf
        assert sorted(found) == [(i + 1, int(j), float(d[j])) for i, j in enumerate(np.lexsort((np.arange(len(x)), d))[:7])]


@pytest.mark.parametrize(("n", "min_size", "k", "method"), [(2000, 10, 5, "eom"), (600, 5, 1, "leaf"), (600, 15, 10, "eom"), (3, 5, 2, "eom")])
def test_hdbscan(spark, n, min_size, k, method):
    x = cloud(n, seed=n) if n > 10 else np.eye(n)
    got = {r.id: r for r in D.hdbscan(frame(spark, x), "id", "v", min_size, k, method, per_cell=100).collect()}
    labels, strengths = plain(x, min_size, k, method)
    assert [got[i].cluster for i in range(n)] == labels
    assert np.allclose([got[i].strength for i in range(n)], strengths)
    if n > 10:
        assert len(set(labels) - {None}) > 2 and None in labels


def test_condensing_in_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(rng.integers(0, i)), i, float(rng.integers(1, 60)) / 8) for s in (0, 1) for i in range(1, 300)]
    tree = spark.createDataFrame(rows, "space int, lo long, hi long, w double")

    def shape(edges):
        lost, clusters = D.condense(tree, [4, 9], edges)
        who: dict = {}
        for r in lost.collect():
            who.setdefault((r.space, r.min_size, r.cluster), []).append((r.node, round(r.lam, 9)))
        facts = {(r.space, r.min_size, r.cluster): (r.n, round(r.stability, 6), round(r.top, 9), r.keep, r.leaf) for r in clusters.collect()}
        return sorted((k[:2], sorted(v), facts[k]) for k, v in who.items()), len(facts)

    assert shape(10**6) == shape(40) and shape(40)[1] > 6


def test_hdbscan_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "id long, v array<double>")
    assert D.hdbscan(none, "id", "v").count() == 0


def test_sweep(spark):
    x = cloud(400, 8, 5)
    grid = spark.createDataFrame([(d, m, k, how) for d in (2, 4) for m in (5, 12) for k in (1, 5) for how in ("eom", "leaf")], "dims int, min_size int, min_samples int, method string")
    results, every = D.sweep(frame(spark, x), "id", "v", grid, per_cell=100)
    assert results.count() == 16
    for dims, m, k, how in [(2, 12, 5, "eom"), (4, 5, 1, "leaf")]:
        mine = every.where(f"dims = {dims} AND min_size = {m} AND min_samples = {k} AND method = '{how}'").orderBy("node").collect()
        p = np.array([r.projected for r in project(frame(spark, x), "v", 4).orderBy("id").collect()])[:, :dims]
        labels, _ = plain(p, m, k, how)
        assert [None if r.cluster is None else r.cluster - 1 for r in mine] == labels
        row = results.where(f"dims = {dims} AND min_size = {m} AND min_samples = {k} AND method = '{how}'").first()
        assert row.clusters == len(set(labels) - {None}) and abs(row.noise - labels.count(None) / 400) < 1e-9


@pytest.mark.parametrize(("eps", "least"), [(1.0, 4), (2.5, 6), (0.0, 3)])
def test_density_clusters_make_no_pairs_of_rows(spark, monkeypatch, eps, least):
    """Dense groups, copies, borders, vectors without a distance; and parts of a few points."""
    monkeypatch.setattr(N, "PART", (90, 90))
    monkeypatch.setattr(N, "AT_ONCE", 3000)
    x = np.vstack([cloud(600, 3), np.array([[50.0, 0, 0], [50.0, 0.6, 0.8], [50.0, 0.6, -0.8], [50.0, -1.0, 0]])])
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(-1, None), (-2, [1.0, None, 2.0]), (-3, [float("nan")] * 3), (-4, [])]
    sizes = []
    monkeypatch.setattr(V, "cut_lineage", lambda df, *a, real=V.cut_lineage: sizes.append((out := real(df, *a)).count()) or out)
    found = V.density_clusters(spark.createDataFrame(rows, "id long, v array<double>").repartition(4), "id", "v", eps, least)
    got = {r.id: r.cluster for r in found.collect()}
    near = np.stack([np.sqrt(((x - r) ** 2).cumsum(1)[:, -1]) <= eps for r in x])
    core = near.sum(1) >= least
    low = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], low[None, :], len(x)).min(1), low)
        if (new == low).all():
            break
        low = new
    want = np.where(near & core[None, :], low[None, :], len(x)).min(1)
    assert got == {i: None if w == len(x) else int(w) for i, w in enumerate(want)} | {-1: None, -2: None, -3: None, -4: None}
    assert len(set(want)) > 1 and max(sizes) < 20 * len(x)  # near pairs: up to 20 000


@pytest.mark.parametrize("parts", [1, 4])
def test_trees_of_pairs_and_of_rounds(spark, monkeypatch, parts):
    """The same weights both ways, in a few jobs where pairs of parts give the tree."""
    monkeypatch.setattr(D, "PART", (-(-300 // parts),) * 2)
    x = cloud(300, 4, 8)
    rows = frame(spark, x).select(F.explode(F.array(F.lit(2), F.lit(4))).alias("space"), F.col("id").alias("node"), "v").select("space", "node", F.slice("v", 1, F.col("space")).alias("v"))
    cells, samples = N.in_cells(rows, 60), {2: (1, 5), 4: (5,)}
    jobs = []
    for module in (D, N):
        monkeypatch.setattr(module, "cut_lineage", lambda *a, real=module.cut_lineage: jobs.append(1) or real(*a))
    nodes, tree = D.tree_of_pairs(cells, samples)
    assert nodes.groupBy("space").count().collect() and len(jobs) <= 5
    points, listed = D.reachable(cells, samples)
    assert sorted(map(tuple, nodes.collect())) == sorted((r.space, r.node) for r in points.collect())

    def shape(df):
        got: dict = {}
        for r in df.collect():
            got.setdefault(r.space, []).append(r.w)
        return {s: sorted(w) for s, w in got.items()}

    found = shape(tree)
    assert found == shape(D.spanning_tree(points, listed, cells)) and {s: len(w) for s, w in found.items()} == {2001: 299, 2005: 299, 4005: 299}


def test_hdbscan_of_more_points_than_pairs_take(spark, monkeypatch):
    monkeypatch.setattr(D, "DENSE", 100)
    x = cloud(600, seed=600)
    got = {r.id: r for r in D.hdbscan(frame(spark, x), "id", "v", 5, 1, "leaf", per_cell=100).collect()}
    labels, strengths = plain(x, 5, 1, "leaf")
    assert [got[i].cluster for i in range(600)] == labels and np.allclose([got[i].strength for i in range(600)], strengths)


@pytest.mark.parametrize("same", [True, False])
def test_only_edges_lighter_than_the_way_are_kept(monkeypatch, same):
    """From any first tree, and in blocks of a few rows, what is kept completes a least tree."""
    monkeypatch.setattr(N, "AT_ONCE", 2000)
    x = cloud(400, 6, 3)
    d = np.stack([N.exact(np.repeat(x[i : i + 1], len(x), 0), x) for i in range(len(x))])
    core = np.sort(d, axis=1)[:, 5]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    first = np.array([(i, int(np.random.default_rng(i).integers(0, i))) for i in range(1, 400)])
    w = reach[first[:, 0], first[:, 1]]
    order = np.argsort(w, kind="stable")
    a, b, w = first[order, 0], first[order, 1], w[order]
    at, gap = D.leaves(400, a.tolist(), b.tolist(), w.tolist())
    place = np.argsort(at)
    high = D.Highest(gap)
    pieces = [np.arange(400)] if same else [np.arange(150), np.arange(150, 400)]
    edges = [(a, b, w)]
    for k, one in enumerate(pieces):
        for two in pieces[k:]:
            ((i, j, v),) = D.lighter(x[one], x[two], one is two, [(core[one], core[two])], [(place[one], place[two])], [high])
            assert len(v) < len(one) + len(two) and (v == reach[one[i], two[j]]).all()
            edges.append((one[i], two[j], v))
    a, b, w = (np.concatenate(c) for c in zip(*edges, strict=True))
    order = np.argsort(w, kind="stable")
    kept = order[D.forest(400, a[order], b[order])]
    assert sorted(w[kept]) == sorted(D.least_tree(x, core)[2])
    step = [(int(low), int(low) + 7) for low in range(0, 390, 13)]
    assert [high(np.array([p]), np.array([q]))[0] for p, q in step] == [gap[p:q].max() for p, q in step]


def test_trees_of_pairs_keep_no_row_for_a_cell(spark, monkeypatch):
    """Where no cell can be passed over, what is kept does not grow with the number of cells."""
    sizes = []
    x = np.random.default_rng(4).normal(size=(300, 12))
    cells = N.in_cells(frame(spark, x).select(F.lit(0).alias("space"), F.col("id").alias("node"), "v"), 10)
    for module in (D, N):
        monkeypatch.setattr(module, "cut_lineage", lambda df, *a, real=module.cut_lineage: sizes.append((out := real(df, *a)).count()) or out)
    assert D.tree_of_pairs(cells, {0: (1, 5)})[1].count() == 598
    assert max(sizes) < 1000
