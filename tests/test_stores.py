"""The commit protocol, the stored index and the tool surface's races."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from veinstone.operators import ranking
from veinstone.operators.textindex import TextIndex
from veinstone.sinks.ledger import Conflict, Ledger


def test_one_of_two_writers_commits(spark, tmp_path):
    ledger, other = Ledger(spark, f"{tmp_path}/t"), Ledger(spark, f"{tmp_path}/t")
    seen = ledger.read()
    assert (seen.number, seen.parts) == (0, ())
    first = ledger.commit(seen, [{"name": "a"}])
    with pytest.raises(Conflict):
        other.commit(seen, [{"name": "b"}])
    assert other.read() == first and ledger.read(0).parts == ()
    failed = []
    gate = threading.Barrier(8)

    def race(k: int) -> None:
        mine = Ledger(spark, f"{tmp_path}/t")
        gate.wait()
        try:
            mine.commit(first, [{"name": f"w{k}"}])
        except Conflict:
            failed.append(k)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(failed) == 7 and ledger.read().number == 2


def test_changes_are_made_anew_after_a_conflict(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/t")
    tried = []

    def more(rows):
        n = rows.count()
        tried.append(n)
        if len(tried) == 1:  # another writer is first
            Ledger(spark, f"{tmp_path}/t").change("x int", lambda _: spark.createDataFrame([(7,)], "x int"))
        return spark.createDataFrame([(n,)], "x int")

    version = ledger.change("x int", more)
    assert tried == [0, 1] and version.number == 2
    assert sorted(r.x for r in ledger.table(version, "x int").collect()) == [1, 7]
    assert [r.x for r in ledger.table(ledger.read(1), "x int").collect()] == [7]
    assert ledger.vacuum() == [] and ledger.read().number == 2


def scores(df) -> dict:
    return {(r.qid, r.id): round(r.score, 9) for r in df.collect()}


def test_stored_index(spark, tmp_path, monkeypatch):
    from veinstone.operators import textindex

    monkeypatch.setattr(textindex, "GROUP", 16)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(5000)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for i in range(300)}
    texts[5], texts[7] = "", None
    queries = spark.createDataFrame([(q, f"w{rng.randint(1, 60)}") for q in range(12) for _ in range(3)] + [(3, "absent"), (3, "w1"), (3, "w1")], "qid int, token string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc int, body string").repartition(3)

    def want(d, k=None):
        out = scores(ranking.bm25(frame(d), "doc", F.col("body"), queries).withColumnRenamed("doc", "id"))
        if k is not None:
            out = {key: v for q in range(12) for key, v in sorted(((key, v) for key, v in out.items() if key[0] == q), key=lambda x: (-x[1], x[0][1]))[:k]}
        return out

    index = TextIndex(spark, f"{tmp_path}/index", buckets=8)
    assert scores(index.search(queries)) == {}
    index.add(frame({i: t for i, t in texts.items() if i % 2}), "doc", "body")
    index.add(frame({i: t for i, t in texts.items() if i % 2 == 0}), "doc", "body")
    assert scores(index.search(queries)) == want(texts)
    assert scores(index.search(queries, 4)) == want(texts, 4)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(999,)], "doc int"), "doc")
    new = {i: f"w1 w2 {texts[i]}" for i in range(0, 60, 5)}
    index.add(frame(new), "doc", "body")
    now = {i: t for i, t in texts.items() if i % 7} | new
    assert scores(index.search(queries)) == want(now) and scores(index.search(queries, 3)) == want(now, 3)
    index.merge()
    assert len(index.ledger.read().parts) == 1
    assert scores(index.search(queries)) == want(now) and scores(index.search(queries, 3)) == want(now, 3)
    assert index.ledger.vacuum() and scores(index.search(queries, 3)) == want(now, 3)
    plan = index.search(queries, 3)._jdf.queryExecution().toString()
    assert "bucket" in plan


def test_two_callers_do_not_open_the_same_path(spark, tmp_path):
    from veinstone.tools import Tools

    opened, refused = [], []

    def start(agent: str) -> None:
        try:
            opened.append(Tools(spark, f"{tmp_path}/tools").start_change("run", ["pkg/a.py"], agent))
        except ValueError:
            refused.append(agent)

    threads = [threading.Thread(target=start, args=(f"agent{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(opened) == 1 and len(refused) == 2
    tools = Tools(spark, f"{tmp_path}/tools")
    assert tools.start_change("run", ["pkg/b.py"], "agent")
    assert tools.intents().count() == 2
    tools.remember(spark.createDataFrame([("r1", "risk_note", "pkg", "x")], "id string, type string, subject string, statement string"))
    yes = spark.createDataFrame([("r1", "approve")], "id string, decision string")
    both = [threading.Thread(target=lambda: Tools(spark, f"{tmp_path}/tools").decide(yes)) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    rows = tools._memory.table(tools._memory.read(), "id string, revision int").collect()
    assert sorted(r.revision for r in rows) == [0, 1]


def test_changed_paths_show_clones_and_cycles(spark, tmp_path):
    from veinstone.engine import analyze
    from veinstone.tools import Tools

    body = "".join(f"    x{i} = a + {i}\n" for i in range(12))
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "one.py").write_text(f"import pkg.two\n\ndef f(a):\n{body}    return a\n")
    (root / "pkg" / "two.py").write_text(f"import pkg.one\n\ndef g(a):\n{body}    return a\n")
    (root / "pkg" / "far.py").write_text("def alone():\n    return 1\n")
    tools = Tools(spark, f"{tmp_path}/tools")
    run = tools.analyze_repository(str(root))
    for path, other in (("pkg/one.py", "pkg/two.py"), ("pkg/two.py", "pkg/one.py")):
        found = {r.family: r for r in tools.changed_findings(run, [path]).where("family <> 'dead_code'").collect()}
        assert set(found) == {"clone", "cycle"} and all(r.places == 2 for r in found.values())
        for r in found.values():
            assert {x.path for x in tools.locations(run, r.id).collect()} == {path, other}
    assert {r.family for r in tools.changed_findings(run, ["pkg/far.py"]).collect()} == {"dead_code"}
    assert all(r.path is not None for r in tools.list_findings(run).collect())
    document = analyze(spark, str(root)).report(changed=["pkg/two.py"]).first()
    assert "clone" in str(document) and "cycle" in str(document)


def test_trees_of_any_size_are_listed(spark, tmp_path):
    from veinstone.sources import readers

    for name in ("a.py", "pkg/__init__.py", "pkg/_b.py", "pkg/deep/c d.py", "pkg/deep/no.txt", "build/x.py", "pkg/.git/y.py", "z/q.py"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x = 1\n" * len(name))
    few, many = (readers.list_tree(spark, f"{tmp_path}/t", most=most).collect() for most in (1000, 2))
    assert few == many and len(few) == 5


def test_an_index_groups_documents_without_sorting_them(spark, tmp_path, monkeypatch):
    from veinstone.operators import textindex as T

    monkeypatch.setattr(T, "GROUP", 4)
    monkeypatch.setattr(T, "TASKS", 3)
    docs = spark.createDataFrame([(i, " ".join(f"w{i % k}" for k in range(1, 9)) + f" x{i % 5}" * (i % 4)) for i in range(50)], "id long, text string")
    index = T.TextIndex(spark, str(tmp_path / "index"))
    index.add(docs.withColumn("text", F.lit("w0")), "id", "text")
    index.add(docs, "id", "text")
    last = [p for p in index.ledger.read().parts if p["kind"] == "segment"][-1]
    rows = index._read(last, None).select("group", F.explode("docs.id").alias("id")).distinct().collect()
    assert len(rows) == 50 and {r.group for r in rows} <= set(range(13))
    asked = spark.createDataFrame([(1, "x2"), (1, "w3"), (2, "w0"), (2, "w6")], "qid int, token string")
    every, best = ({(r.qid, r.id): round(r.score, 9) for r in index.search(asked, k).collect()} for k in (None, 3))
    for q in (1, 2):
        order = sorted((-s, i) for (qid, i), s in every.items() if qid == q)[:3]
        assert order == sorted((-s, i) for (qid, i), s in best.items() if qid == q)
