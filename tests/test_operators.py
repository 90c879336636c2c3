"""Operators on literal rows: expectations, edges and ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import clones, events, gates, graph, joins, metrics, ranking, vectors
from veinstone.operators import windows as W


def values(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(("loc", "bucket"), [(0, "0-19"), (19, "0-19"), (20, "20-49"), (49, "20-49"), (50, "50-99"), (99, "50-99"), (100, "100+")])
def test_buckets(spark, loc, bucket):
    assert values(spark, S.loc_bucket(F.lit(loc))) == bucket


def test_scores(spark):
    assert [values(spark, S.clone_density_score(F.lit(d))) for d in (0.0, 0.05, 0.2, 0.5, 0.9)] == pytest.approx([100, 90, 50, 0, 0])
    assert [values(spark, S.permille(F.lit(a), F.lit(b))) for a, b in ((1, 2), (0, 0), (1, 16), (3, 16))] == [500, 0, 62, 188]
    assert [values(spark, S.grade(F.lit(x))) for x in (90, 89, 74, 59, 39)] == ["A", "B", "C", "D", "F"]
    assert values(spark, S.cyclomatic(F.lit(1), F.lit(5))) == 1
    assert values(spark, S.source_kind(F.lit("a/tests/fixtures/x.py"))) == "fixtures"
    assert values(spark, S.scope_match(F.lit("a/b/c"), F.lit("a/b"))) == 0.8
    assert values(spark, S.identity_key(F.lit("k"), F.lit("a b"), F.lit(""))) is None


def test_corpus_text(spark):
    text = "fix  the 0123456789abcdef\r\n\r\n\r\n\r\nat 2024-01-02T03:04:05Z in /usr/lib/x  "
    assert values(spark, S.corpus_text(F.lit(text))) == "the <digest>\n\nat <timestamp> in <path>"


def test_vectors(spark):
    assert values(spark, S.l2_normal(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    v = values(spark, S.hash_embedding(F.lit("x"), 8))
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_interval_merge(spark):
    rows = [("f", 1, 4, "a"), ("f", 5, 8, "b"), ("f", 10, 12, "c"), ("f", 11, 11, "d"), ("g", 1, 1, "e"), ("f", 10, 12, "c")]
    got = W.merge_intervals(spark.createDataFrame(rows, "k string, start int, end int, tag string"), ["k"], "start", "end")
    assert sorted(tuple(r) for r in got.select("k", "start", "end", "merged", "tag").collect()) == [("f", 1, 8, 2, "a"), ("f", 10, 12, 3, "c"), ("g", 1, 1, 1, "e")]


def test_folds(spark):
    starts = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 9, 10, 12)])
    assert values(spark, W.greedy_starts(starts, 3, 15)) == [1, 4, 9, 12]
    assert values(spark, W.greedy_starts(starts, 3, 2)) == [1, 4]
    assert values(spark, W.greedy_starts(F.array().cast("array<int>"), 3, 2)) == []


def test_percentiles(spark):
    v = spark.createDataFrame([("g", x) for x in (5, 1, 4, 2, 3, 6, None)], "g string, x int")
    places = {f"n{q}": W.nearest_place(q) for q in (0.0, 0.5, 0.9, 1.0)} | {f"f{q}": W.floor_place(q) for q in (0.5, 0.95)}
    assert list(W.ranked(v, ["g"], "x", places).drop("g").collect()[0]) == [1, 3, 5, 6, 3, 5]
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sorted(r.m for r in W.with_midrank(df, "x", "m").collect()) == [0.25, 0.25, 1.0]
    assert W.with_midrank(spark.createDataFrame([(1,)], "x int"), "x", "m").collect()[0].m == 1.0


def test_numbered_over_many_partitions(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = W.numbered(spark.createDataFrame(rows, "a int, b int").repartition(13), [F.asc("a"), F.asc("b")]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows) and sorted(r.rank for r in got) == list(range(1, 1001))


def test_deep_graphs(spark):
    """Chains and circles beyond any fixed number of rounds."""
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(40)]
    circle = [(f"c{i:03}", f"c{(i + 1) % 30:03}") for i in range(30)]
    e = graph.edges(spark.createDataFrame(chain + circle, "s string, t string"), "s", "t").coalesce(1)
    for few in (0, 1000):
        assert max(r.depth for r in graph.depths(e.where("src LIKE 'n%'"), few=few).collect()) == 41
        assert [(r.component, r.size) for r in graph.cycles(e, few=few).collect()] == [("c000", 30)]
    assert {r.root for r in graph.components(e.selectExpr("src AS a", "dst AS b")).collect()} == {"n0000", "c000"}
    rows = [(i, i - 1 if i % 400 else None) for i in range(800)] + [(1000, 1001), (1001, 1000), (1002, 1000), (1003, 77777)]
    got = graph.forest(spark.createDataFrame([(a, b, a) for a, b in rows], "id int, parent int, at int").selectExpr("id", "parent", "timestamp_seconds(at) AS at")).collect()
    assert {(r.id, r.root, r.depth, r.offset_ms) for r in got} == {(i, i // 400 * 400, i % 400, i % 400 * 1000) for i in range(800)} | {(1003, 1003, 0, 0)}


def test_longest_paths_with_cycles(spark):
    """Against a plain recursive walk in the same order of visits."""
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = sorted({(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(16)})
        near: dict[str, list[str]] = {}
        for a, b in pairs:
            near.setdefault(a, []).append(b)
        memo: dict = {}

        def walk(n, open_, empty, base, better):
            if n in memo:
                return memo[n]
            if n in open_:
                return empty(n)
            value = base(n)
            for m in sorted(near.get(n, [])):
                value = better(n, value, walk(m, open_ | {n}, empty, base, better))
            memo[n] = value
            return value

        every = sorted({x for p in pairs for x in p})
        e = graph.edges(spark.createDataFrame(pairs, "s string, t string"), "s", "t")
        for n in every:
            walk(n, frozenset(), lambda n: 0, lambda n: 1, lambda n, old, tail: max(old, 1 + tail))
        for few in (0, 1000):
            assert {r.node: r.depth for r in graph.depths(e, few=few).collect()} == memo
        memo.clear()
        for n in every:
            walk(n, frozenset(), lambda n: (n,), lambda n: (n,), lambda n, old, tail: min(old, (n, *tail), key=lambda p: (-len(p), p)))
        for few in (0, 1000):
            assert [tuple(r.path) for r in graph.chains(e, 4, few=few).collect()] == sorted(set(memo.values()), key=lambda p: (-len(p), p))[:4]
        assert sorted(map(tuple, graph.cycles(e, few=0).collect())) == sorted(map(tuple, graph.cycles(e, few=1000).collect()))


def test_coverage_join(spark):
    units = spark.createDataFrame(
        [("pkg/missing.py", "lost", 1, 2, "high"), ("pkg/mod.py", "hot", 1, 3, "high"), ("pkg/mod.py", "covered", 5, 6, "medium"), ("pkg/mod.py", "no_lines", 8, 9, "high")],
        "path string, qualname string, start int, end int, risk string",
    )
    lines = spark.createDataFrame([("pkg/mod.py", 1, 1), ("pkg/mod.py", 2, 0), ("pkg/mod.py", 5, 1), ("pkg/mod.py", 6, 1)], "path string, line int, hits int")
    c = joins.coverage_join(units, lines)
    got = {r.qualname: (r.status, r.executable, r.covered, r.permille) for r in c.collect()}
    assert got == {
        "lost": ("missing_from_report", 0, 0, 0), "hot": ("measured", 2, 1, 500), "covered": ("measured", 2, 2, 1000), "no_lines": ("no_executable_lines", 0, 0, 0),
    }
    assert (c.where(joins.is_coverage_hotspot()).count(), c.where(joins.is_scope_gap()).count()) == (1, 1)


def test_anti_joins_ignore_nulls(spark):
    c = spark.createDataFrame([("m:a", "a", False), ("m:B.b", "B.b", False), ("m:c", "c", False)], "qualname string, local_name string, suppressed boolean")
    names = spark.createDataFrame([("b",), (None,), ("c",)], "name string")
    none = spark.createDataFrame([(None,)], "q string")
    assert sorted(tuple(r)[:1] + (r.confidence,) for r in joins.unreferenced(c, names, none, none).collect()) == [("m:B.b", "medium"), ("m:a", "high")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "x"), ("a", "b")], "s string, t string")
    edges = graph.edges(e, "s", "t")
    assert sorted((r.component, r.members) for r in graph.cycles(edges).collect()) == [("a", ["a", "b"]), ("x", ["x"])]
    dag = graph.edges(spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "s string, t string"), "s", "t")
    assert {r.node: r.depth for r in graph.depths(dag).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1}
    assert graph.chains(dag, 2).collect()[0].path == ["a", "b", "d"]
    origins = spark.createDataFrame([("d",)], "origin string")
    assert sorted((r.dependent, r.depth) for r in graph.transitive_dependents(dag, origins).collect()) == [("a", 2), ("b", 1), ("c", 1)]
    assert graph.cycles(dag).count() == 0


def test_segments_repeat_inside_one_function(spark):
    text = "\n".join("a b c a b c a b c x".split())
    d = spark.createDataFrame([("p", "f", text), ("p", "g", "a\nb\nc")], "path string, qualname string, text string")
    u = clones.units(d, F.col("path"), F.col("qualname"), F.col("text"))
    groups = clones.segment_groups(clones.segments(u, 3)).collect()
    assert {g.qualname for g in groups} == {"f"} and len(groups) == 3
    assert [(r.start, r.end) for r in clones.merged_segments(clones.segments(u, 3)).where("start = 1").collect()] == [(1, 9)]


def test_rrf_and_relevance(spark):
    a = spark.createDataFrame([("x", 2), ("y", 0)], "id string, rank int")
    b = spark.createDataFrame([("x", 2), ("z", 0)], "id string, rank int")
    got = {r.id: r.score for r in ranking.rrf(a, b, "id").collect()}
    assert got["x"] > got["y"] == got["z"] == 1 / 60


def test_gates(spark):
    state = spark.createDataFrame([(21, 0)], "complexity_max int, clone_total int")
    r = gates.evaluate(state, {"complexity_threshold": 20, "clone_threshold": 0, "health_threshold": 10}).collect()[0]
    assert (r.reasons, r.exit_code) == (["metric:complexity_threshold", "metric:health_threshold"], 3)
    assert gates.evaluate(state, {}).collect()[0].exit_code == 0


def test_majority_ties_go_to_the_smallest(spark):
    rows = [(1, i, p) for i, p in enumerate("bbaa")] + [(2, 9, "z")]
    got = gates.cohort_drift(spark.createDataFrame(rows, "c int, m int, p string"), "c", "m", ["p"])
    assert sorted(r.m for r in got.collect()) == [0, 1]


def test_trajectory_ladder(spark):
    def outcome(*types, status=None):
        rows = [("w", i, t, status, "info", "mcp", "x", "{}", "bad") for i, t in enumerate(types)]
        df = spark.createDataFrame(rows, "workflow_id string, seq int, event_type string, status string, severity string, surface string, tool string, core string, core_sha string")
        r = events.trajectories(df).collect()[0]
        return r.outcome, r.tier

    assert outcome("intent.declared", "patch_contract.verified", status="accepted") == ("accepted", "verified")
    assert outcome("patch_contract.verified", "patch_contract.violated", status="accepted") == ("violated", "incident")
    assert outcome("intent.expired") == ("abandoned", "routine")
    assert outcome("intent.queue_blocked") == ("blocked", "routine")
    assert outcome("intent.declared") == ("partial", "partial")


def test_batches_and_exports(spark):
    items = spark.createDataFrame([("g", i, t) for i, t in enumerate([1, 2, 3, 9, 10])], "g string, id int, tokens int")
    got = events.adaptive_batches(items, "g", "id", "tokens", 3, 12).orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 0, 1, 2]
    rows = spark.createDataFrame([("s", i, z) for i, z in enumerate([5, 9, 50, 4, 1])], "s string, id int, z int")
    assert tuple(events.export_lines(rows, "s", ["id"], "z", 10, 20).collect()[0])[1:] == (10, 3, 1, 1)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "path string, qualname string, text string")
    u = clones.units(none, F.col("path"), F.col("qualname"), F.col("text"))
    assert clones.function_groups(u).count() == clones.block_groups(clones.blocks(u)).count() == 0
    assert graph.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert metrics.partition_metrics(spark.createDataFrame([], "label int"), "label").collect()[0].clusters == 0
    assert vectors.centroids(spark.createDataFrame([], "label int, v array<double>"), "label", "v").count() == 0


def test_partition_count_does_not_matter(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(200)]
    results = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k string, start int, w int").repartition(n).selectExpr("k", "start", "start + w AS end")
        results.append(sorted(tuple(r) for r in W.merge_intervals(df, ["k"], "start", "end").collect()))
    assert results[0] == results[1]


def test_rebuild_stream(spark, tmp_path):
    from veinstone.streaming import events as ST

    def write(n, ids):
        rows = [(i, None, 1, t, 1.0, "{}") for i, t in ids]
        spark.createDataFrame(rows, ST.SCHEMA).write.parquet(str(tmp_path / f"in/{n}.parquet"))

    def project(df):
        return df.selectExpr("concat('intent:', user_id) AS workflow_id", "event_id AS seq", "event_type", "'accepted' AS status", "'info' AS severity", "'mcp' AS surface", "'x' AS tool", "props AS core", "sha2(props, 256) AS core_sha")

    out, args = str(tmp_path / "out"), [str(tmp_path / x) for x in ("history", "out", "check")]
    for n, ids in enumerate([[(2, "patch_contract.verified")], [(1, "intent.declared"), (3, "intent.violated")]]):
        write(n, ids)
        q = ST.rebuild_stream(ST.event_stream(spark, str(tmp_path / "in/*")), *args, project)
        q.processAllAvailable()
        q.stop()
        last = ST.latest_trajectories(spark, out).collect()
        assert all(p.name.startswith(("epoch=", "_", ".")) for p in (tmp_path / "history").iterdir())
        assert [(r.outcome, r.event_count) for r in last] == [[("accepted", 1)], [("violated", 3)]][n]


def test_principal_coordinates(spark):
    """Against a singular value decomposition of all rows."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] + 1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(4)
    got = {r.id: r.projected for r in vectors.project(df, "v", 3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centred = unit - unit.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose([got[i] for i in range(200)], centred @ axes.T, atol=1e-9) and got[999] is None
    assert vectors.project(df.limit(0), "v", 3).count() == 0
