"""Steps whose work must not grow with pairs of rows, against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import joins


def joined_rows(df) -> int:
    """Rows that the joins of a collected plan put out."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if "Join" in name and plan.metrics().contains("numOutputRows"):
                total += plan.metrics().apply("numOutputRows").value()
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("flows", [1, 2, 3, 40])
def test_precedents_look_up_places(spark, flows):
    draw = random.Random(flows)
    past = [(i, draw.randrange(flows) if i % 7 else 0, draw.randrange(300), [f"s{draw.randrange(2)}", "all"]) for i in range(600)] + [(5, 1, 40, ["all"]), (5, 2, 40, ["all"]), (900, None, 3, ["all"])]
    past += [past[3], (901, 1, None, ["all", None])]
    now = [(i, draw.randrange(flows), draw.randrange(320), [f"s{draw.randrange(3)}", "all", "all"]) for i in range(300)] + [(1000, None, 9, ["all"])]
    want = set()
    for i, flow, start, subjects in now:
        near = {(f, p) for p, w, f, s in past if None not in (flow, w, f) and f < start and w != flow and set(s) & set(subjects) - {None}}
        want |= {(i, p, f, r) for r, (f, p) in enumerate(sorted(near, reverse=True)[:3], 1)}
    df = joins.precedents(spark.createDataFrame(now, "id int, workflow int, started int, subjects array<string>"), spark.createDataFrame(past, "pid int, pworkflow int, finished int, psubjects array<string>"), 3)
    got = df.select("id", "pid", "finished", "rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert joined_rows(df) <= 300 * 3 * 15


def test_rounding_keeps_the_sign(spark):
    values = [-4e-7, 4e-7, 0.0, -1.5e-6, 0.1234565, -0.9999995, 1.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(S.round_signed(F.col("x"), 6)).collect()
    want = [math.copysign(math.floor(abs(v) * 1e6 + 0.5) / 1e6, v) for v in values]
    assert [(r[0], math.copysign(1, r[0])) for r in got] == [(w, math.copysign(1, w)) for w in want]


def test_hashed_vectors_with_negative_zero(spark, tmp_path):
    import duckdb

    from veinstone.plans import catalog

    duckdb.sql("COPY (SELECT * FROM (VALUES (4914504, 'error'), (1, 'view')) t(event_id, event_type)) TO '%s' (FORMAT parquet)" % (tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = dict(con.execute(catalog.ORACLES["hashed_vectors"]).fetchall())
    got = {r.event_id: r.v for r in catalog.QUERIES["hashed_vectors"](spark, str(tmp_path)).collect()}
    assert any(x == 0 and math.copysign(1, x) < 0 for x in want[4914504])
    assert {k: repr(list(v)) for k, v in got.items()} == {k: repr(list(v)) for k, v in want.items()}


def test_coverage_counts_lines_before_the_join(spark):
    draw = random.Random(3)
    lines = [(f"p{draw.randrange(2)}", draw.choice([draw.randrange(200), 7, None]), draw.choice([0, 1, None])) for _ in range(4000)]
    units = [(draw.choice(["p0", "p1", "q", None]), f"u{draw.randrange(20)}", s := draw.randrange(200), s + draw.choice([-1, 0, 40, 150]), "low") for _ in range(200)]
    units += units[:5]
    want: dict = {}
    for u in units:
        hit = [h for p, n, h in lines if p == u[0] and n is not None and u[2] <= n <= u[3]]
        executable, covered = want.get(u, (0, 0))
        want[u] = executable + len(hit), covered + sum(bool(h) for h in hit)
    df = joins.coverage_join(spark.createDataFrame(units, "path string, qualname string, start int, end int, risk string"), spark.createDataFrame(lines, "path string, line int, hits int"))
    got = {(r.path, r.qualname, r.start, r.end, r.risk): (r.executable, r.covered) for r in df.collect()}
    assert got == want
    assert joined_rows(df) < 200 * 250


def test_extraction_of_some_families(spark):
    from veinstone.operators import extract as X
    from veinstone.plans import sources

    files = sources.files(spark, "/root/testdata/sf0.001").limit(60).localCheckpoint()
    whole = {r.path: r for r in X.extract(files, "src").collect()}
    for names in (("units",), ("stmts", "calls"), ("names", "stats"), ("suppressions", "adoption", "reach"), ("qualnames", "classes", "branches"), ()):
        part = X.extract(files, "src", families=names)
        assert part.columns == ["path", "module", "ok", "error_kind", "error", *[c for c in X.extract(files, "src").columns if c in names]]
        assert {r.path: tuple(r) for r in part.collect()} == {p: tuple(r[c] for c in part.columns) for p, r in whole.items()}


def test_extraction_holds_few_files(spark, monkeypatch):
    """A worker's rows go on in batches of at most ``FILES``, however many files Arrow brings at once."""
    import pyarrow as pa

    from veinstone.operators import extract as X

    caught = []
    rows = spark.createDataFrame([("src/a.py", b"")], "path string, content binary")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    X.extract(rows, "src")
    n = 3 * X.FILES + 1
    batch = pa.RecordBatch.from_pydict({"path": [f"src/f{i}.py" for i in range(n)], "module": ["f"] * n, "content": [b"import os"] * n, "test": [False] * n})
    sizes = [b.num_rows for b in caught[0](iter([batch]))]
    assert sum(sizes) == n and max(sizes) <= X.FILES


def test_evidence_is_picked_before_rows_meet(spark):
    from veinstone.operators import metrics as M

    rows = [(i % 400, ["f"], ["s_x", "y"], "ok" if i % 3 else "bad", f"a{i % 4}", None if i % 50 == 0 else (i * 7919) % 900) for i in range(3000)]
    df = M.experiences(spark.createDataFrame(rows, "id int, families array<string>, signals array<string>, outcome string, agent string, finished int"))
    got = {(r.family, r.signal, r.outcome): r for r in df.collect()}
    for (_, signal, outcome), r in got.items():
        pairs = sorted({(-1 if f is None else f, i) for i, _, _, o, _, f in rows if o == outcome})
        assert r.evidence == [i for _, i in pairs][:20] and r.support == len({i for _, i in pairs}) and r.agents == 4, signal
    assert len(got) == 4
    assert "collect_set" not in df._jdf.queryExecution().toString()


def test_segment_reports_look_at_a_place_once(spark):
    from veinstone.operators import reporting as P

    items = [(g, "p" if g % 50 else None, "q", 1 + g % 3, 30 + g % 3) for g in range(600)] + [(600, "p", "q", 300, 310), (0, "p", "q", 1, 31)]
    stmts = [("p", "q", i, i, ["Assign", "Expr", "If", None][i % 4 if i > 5 else 0], i % 5 != 0, None if i % 3 else False) for i in range(1, 31)]
    df, gone = P.segment_report_groups(spark.createDataFrame(items, "group_key int, path string, qualname string, start int, end int"), spark.createDataFrame(stmts, "path string, qualname string, start int, end int, kind string, attribute_only boolean, call boolean"))
    assert gone.count() == 0 and df.count() == 602
    plain = [("p", "q", i, i, "Assign", True, False) for i in range(1, 31)]
    df, gone = P.segment_report_groups(spark.createDataFrame(items, "group_key int, path string, qualname string, start int, end int"), spark.createDataFrame(plain, "path string, qualname string, start int, end int, kind string, attribute_only boolean, call boolean"))
    assert {r.group_key for r in gone.collect()} == {g for g in range(600) if g % 50}
    assert {r.group_key for r in df.collect()} == {0, *range(0, 600, 50), 600}
    assert joined_rows(df) < 600 * 5


def test_classes_share_the_builtin_names(monkeypatch):
    """The names of ``builtins`` are listed once, not for every class."""
    from veinstone.functions import python_facts

    monkeypatch.setattr(python_facts, "dir", lambda x: pytest.fail("listed again"), raising=False)
    found = python_facts.facts("from m import g\nclass A:\n    def a(self): return g(len(self.x), A, B)\nclass B: pass", "t", False, frozenset(["classes"]))
    assert [(c[0], c[3]) for c in found["classes"]] == [("t:A", 2), ("t:B", 0)]


def test_adoption_alone_writes_no_signatures(monkeypatch):
    """Counts of annotations and public names need no text of an annotation; both ways agree."""
    from veinstone.functions import python_facts

    source = 'class C:\n    def a(self, n: int): return n\ndef f(n: int, m=0) -> int:\n    "Doc."\n    return n\ndef _g(x: str): pass'
    both = python_facts.facts(source, "t", False, frozenset(["adoption", "api"]))
    monkeypatch.setattr(python_facts.ast, "unparse", lambda x: pytest.fail("not asked for"))
    alone = python_facts.facts(source, "t", False, frozenset(["adoption"]))
    assert alone["adoption"] == both["adoption"] == (4, 3, 3, 1, 3, 1) and len(both["api"]) == 3 and alone["api"] == []


def test_index_counts_tokens_before_they_move(spark, tmp_path):
    """No row or regular expression of Spark for each token, and the tokens that bm25 counts, of any text."""
    from pyspark.sql import functions as F

    from veinstone.operators import textindex as X
    from veinstone.operators.ranking import text_tokens

    texts = ["", None, "a b a", "ÀÉ ß İi İ Σς ɏ ɐ \U0001f600x́y", " -- ", "x" * 50 + " " + "y " * 500, "A\tb\nB 0_9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.t for r in rows.select("id", text_tokens(F.col("text")).alias("t")).collect()}
    seen = []
    index = X.TextIndex(spark, str(tmp_path / "index"))
    segment = index._segment
    index._segment = lambda df: seen.extend(df.collect()) or segment(df)
    index.add(rows, "id", "text")
    assert {r.id: ({e.token: e.tf for e in r.t}, r.len) for r in seen} == {i: ({x: t.count(x) for x in t}, len(t)) for i, t in want.items()}
    index.merge()
    assert {r.id: {e.token: e.tf for e in r.t or ()} for r in seen[len(texts) :]} == {i: {x: t.count(x) for x in t} for i, t in want.items()}
    assert {r.id for r in index.search(spark.createDataFrame([(1, "b")], "qid int, token string")).collect()} == {2, 6}
