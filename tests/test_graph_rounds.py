"""Strong components in few rounds."""

from __future__ import annotations

import random

import pytest

from veinstone.operators import graph


def plain(edges: set) -> dict:
    """Components by reachability."""
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: reach(x) for x in {n for e in edges for n in e}}
    out = {}
    for x, r in far.items():
        if x in r:
            same = sorted(y for y in r if x in far[y])
            out[same[0]] = same
    return out


@pytest.mark.parametrize("few", [60])
def test_strong_components(spark, few):
    for seed in range(1):
        rng = random.Random(seed)
        name = lambda k: f"n{k:03d}"
        edges = {(name(rng.randint(0, 45)), name(rng.randint(0, 45))) for _ in range(42)}
        edges |= {(name(100 + k), name(100 + (k + 1) % 17)) for k in range(17)}  # a ring
        edges |= {(name(k), name(k + 1)) for k in range(200, 230)} | {(name(3), name(200)), (name(230), name(5))}  # a long way
        edges |= {(name(k), name(k + 1)) for k in range(300, 320)} | {(name(320), name(300)), (name(310), name(305)), (name(1), name(300))}
        edges |= {(name(400), name(401)), (name(401), name(400)), (name(401), name(402)), (name(402), name(401)), (name(410), name(410))}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        got = {r.component: list(r.members) for r in graph.cycles(df, few).collect()}
        assert got == plain(edges)


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    rounds = []
    for name in ("cut_lineage", "rewritten"):
        monkeypatch.setattr(graph, name, lambda *a, real=getattr(graph, name): rounds.append(1) or real(*a))
    n = 30_000
    ring = spark.range(n).selectExpr("lpad(id, 6, '0') AS src", f"lpad((id + 1) % {n}, 6, '0') AS dst")
    tail = spark.range(2000).selectExpr("concat('t', lpad(id, 5, '0')) AS src", "concat('t', lpad(id + 1, 5, '0')) AS dst")
    got = graph.cycles(ring.union(tail).union(spark.sql("SELECT '000500', 't00000'"))).collect()
    assert [(r.component, r["size"]) for r in got] == [("000000", n)] and len(rounds) < 50


def moved(spark, run) -> int:
    """Rows that a call's stages write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    total = lambda: sum(s.shuffleWriteRecords() for s in (stages.apply(i) for stages in [store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)] for i in range(stages.size())))
    before = total()
    run()
    return total() - before


def ladder(spark, n: int):
    """Rungs of two nodes, each with edges to both of the next rung."""
    name = lambda c, i: f"concat('{c}', lpad({i}, 5, '0'))"
    return spark.range(n).selectExpr(f"explode(array(struct({name('a', 'id')} AS src, {name('a', 'id + 1')} AS dst), struct({name('a', 'id')} AS src, {name('b', 'id + 1')} AS dst), struct({name('b', 'id')} AS src, {name('a', 'id + 1')} AS dst))) AS x").select("x.*").distinct()


def test_reach_does_not_move_what_is_known(spark):
    n = 24
    e = ladder(spark, n)
    origins = e.selectExpr("src AS origin", "src AS node").distinct()
    found = {}
    rows = moved(spark, lambda: found.update({(r.origin, r.node): r.depth for r in graph.closure(e, origins).collect()}))
    want = {(f"{c}{i:05d}", f"{t}{j:05d}"): j - i for c in "ab" for i in range(n) for j in range(i + 1, n + 1) for t in "ab"}
    want = {k: v for k, v in want.items() if not (k[0][0] == "b" and k[1][0] == "b" and v == 1)}
    assert found == want
    assert rows < 12 * len(want)  # with all that is known in every round: 24 times half of it


def test_layers_move_an_edge_once(spark):
    n = 14
    e = ladder(spark, n).localCheckpoint()
    got = {}
    rows = moved(spark, lambda: got.update({r.node: r.depth for r in graph.depths(e, few=0).collect()}))
    assert got == {f"{c}{i:05d}": n + 1 - i for c in "ab" for i in range(n + 1)}
    assert rows < 25 * e.count()  # with all edges left in every round: 14 times half of them, four times
    assert [tuple(r.path) for r in graph.chains(e, 2, few=0).collect()] == [tuple(f"a{i:05d}" for i in range(n + 1)), ("b00000", *(f"a{i:05d}" for i in range(1, n + 1)))]
    assert graph._peel(e.unionByName(spark.sql("SELECT 'x' AS src, 'y' AS dst UNION ALL SELECT 'y', 'x' UNION ALL SELECT 'y', 'a00000' UNION ALL SELECT 'b00014', 'x'"))).count() > 3 * n - 3
