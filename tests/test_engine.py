"""The extractor and the engine on small source trees."""

from __future__ import annotations

import json

import pytest

from veinstone.engine import analyze
from veinstone.functions import python_facts as P
from veinstone.sinks import report
from veinstone.sources import readers

SHAPE = '''
def {name}(items, limit):
    """Doc."""
    if not items:
        return None
    total = 0
    for item in items:
        if item > limit and item % 2:
            total += item
        else:
            total = total - 1
    result = total * 2
    other = result + 1
    return other
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj") / "src"
    pkg = root / "pkg"
    (pkg / "tests").mkdir(parents=True)
    (root / "venv").mkdir()
    (root / "venv" / "skipped.py").write_text("x = 1\n")
    (pkg / "__init__.py").write_text("")
    (pkg / "a.py").write_text("from pkg import b\nimport pkg.b\nimport subprocess\n" + SHAPE.format(name="alpha") + "\ndef used():\n    return b.beta([], 1)\n")
    (pkg / "b.py").write_text("import pkg.a\n" + SHAPE.format(name="beta").replace("total", "amount") + "\n# veinstone: ignore[dead-code]\ndef hidden():\n    return 1\n")
    (pkg / "c.py").write_text("import pkg.a\n\nclass Box:\n    def one(self):\n        return self.x\n    def two(self):\n        return self.y\n    def three(self):\n        return pkg.a.used()\n\ndef orphan():\n    return Box()\n")
    (pkg / "tests" / "test_c.py").write_text("from pkg.c import orphan\n\ndef test_it():\n    assert orphan()\n")
    (pkg / "broken.py").write_text("def (:\n")
    return str(root)


@pytest.fixture(scope="module")
def run(spark, tree):
    return analyze(spark, tree)


def test_facts_of_a_tree(run):
    inv = run.inventory().collect()[0]
    assert (inv.files, inv.analysed, inv.failed) == (6, 5, 1)
    units = {r.qualname: r for r in run.units.collect()}
    assert units["pkg.a:alpha"].cc == 5 and units["pkg.a:alpha"].nesting == 2 and units["pkg.a:alpha"].guards == 1
    assert units["pkg.a:alpha"].fingerprint == units["pkg.b:beta"].fingerprint
    assert units["pkg.a:alpha"].raw_hash != units["pkg.b:beta"].raw_hash


def test_clones(run):
    groups = run.function_clones().collect()
    assert [(g.items, g.clone_type, g.functions) for g in groups] == [(2, "Type-2", 2)]
    assert run.block_clones().count() > 0
    assert run.segment_clones().count() == 0


def test_graph_and_dead_code(run):
    assert [(r.component, r.members) for r in run.cycles().collect()] == [("pkg.a", ["pkg.a", "pkg.b"])]
    dead = {r.qualname for r in run.dead_code().collect()}
    assert "pkg.c:orphan" in dead and "pkg.b:hidden" not in dead and "pkg.a:used" not in dead
    assert {r.qualname for r in run.dead_code(True).where("suppressed").collect()} == {"pkg.b:hidden"}
    assert run.blast_radius(["pkg.b"]).collect()[0].level == "medium"
    assert {(r.role, r.symbol) for r in run.callers("pkg.a:used").collect()} == {("caller", "pkg.c:Box.three"), ("callee", "pkg.b:beta")}


def test_classes_surfaces_and_gates(run):
    box = run.classes().where("qualname = 'pkg.c:Box'").collect()[0]
    assert (box.lcom4, box.methods) == (3, 3)
    assert {r.category for r in run.security_surfaces().collect()} == {"process_boundary"}
    gate = run.evaluate_gates({"complexity_threshold": 3, "dependency_cycles": True, "clone_threshold": 5}).collect()[0]
    assert gate.reasons == ["metric:complexity_threshold", "metric:dependency_cycles"] and gate.exit_code == 3


def test_reports(run):
    doc = run.report()
    body = json.loads(report.to_json(doc))
    assert body["sections"]["inventory"][0]["files"] == 6 and len(body["digest"]) == 64
    assert report.to_json(doc) == report.to_json(run.report())
    assert "findings" in report.to_text(doc) and "| confidence | family |" in report.to_markdown(doc) and "<table>" in report.to_html(doc)


@pytest.mark.parametrize(
    ("body", "cc"),
    [
        ("return 1", 1), ("if a: b()", 2), ("if a and b or c: d()", 4), ("if not (a and b): c()", 3), ("while a: b()", 2), ("for x in y:\n  if x: break\nelse: z()", 3),
        ("try: a()\nexcept E: b()\nexcept F: c()\nfinally: d()", 3), ("match a:\n case 1: b()\n case _: c()", 2), ("match a:\n case 1: b()\n case 2: c()", 3),
        ("with a: b()", 1), ("if a: return 1\nelif b: return 2\nreturn 3", 3), ("return 1\nif a: b()", 1), ("for x in y:\n  if x: continue\n  z()", 3),
    ],
)
def test_control_graph(body, cc):
    fn = P.ast.parse("def f():\n" + "\n".join("  " + x for x in body.split("\n"))).body[0]
    assert P.ControlGraph(fn.body).complexity() == cc


def test_reachability():
    source = "import click\nfrom flask import Flask\nfrom django.urls import path\napp = Flask(__name__)\n@app.route('/')\ndef home(): pass\n@click.command()\ndef run(): pass\ndef page(): pass\nurls = [path('x', page)]\ndef lost(): pass\n"
    found = P.facts(source, "m")["reach"]
    assert found == [("m:home", "flask", "registers_handler", "high"), ("m:page", "django", "registers_handler", "medium"), ("m:run", "click", "registers_command", "medium")]


def test_sarif(spark):
    rows = [("r2", "warning", "m", "b.py", 3, "k1", "new"), ("r1", "error", "m", "a.py", 1, "k2", "known")]
    log = json.loads(report.sarif(spark.createDataFrame(rows, "rule string, level string, message string, path string, line int, key string, novelty string")).collect()[0].sarif)
    results = log["runs"][0]["results"]
    assert [(r["ruleId"], r["ruleIndex"], r["baselineState"]) for r in results] == [("r1", 0, "unchanged"), ("r2", 1, "new")]


def test_normal_form():
    a, b = (P.normal_dump(P.ast.parse(s)) for s in ("x += 1\nif not a in b: pass", "y = y + 2\nif c not in d: pass"))
    assert a == b
    assert P.normal_dump(P.ast.parse("f(x)")) != P.normal_dump(P.ast.parse("g(x)"))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("def f(a): return a", "def f(b): return b", False), ("def f(a: int) -> int: return a", "def f(a): return a", True), ("not a is b", "x is not y", True),
        ("x.y.f(z)", "x.w.f(z)", False), ("x.y.f(z)", "x.y.f(w)", True), ("g(1).f(z)", "g(2).f(z)", True), ("f(a=b)", "f(c=b)", False), ("x.a", "y.b", True),
        ("x |= 1", "x = x | 2", True), ("a - 1", "1 - a", False), ("def f():\n  'doc'\n  return 1", "def f():\n  return 2", True),
    ],
)
def test_normal_forms(a, b, same):
    assert (P.normal_dump(P.ast.parse(a)) == P.normal_dump(P.ast.parse(b))) is same


def test_commutative_numbers():
    def dump(s):
        return P.normal_dump(P.ast.parse(s, mode="eval"), constants=True)

    assert dump("2 + 1") == dump("1 + 2") and dump("4 | 3") == dump("3 | 4") and dump("2 ^ 1 ^ 0") != dump("'a' + 'b'")
    assert dump("2 - 1") != dump("1 - 2") and dump("x + 1") != dump("1 + x") and dump("2.0 | 1") != dump("1 | 2.0") and dump("True + 1") != dump("1 + True")


def test_module_key(spark):
    from pyspark.sql import functions as F

    from veinstone.functions.scalars import module_key

    cases = {("file:/src/app/src/pkg/a.py", "file:/src/app/src"): "pkg.a", ("/x/src/lib/src/a.py", "/x/src/"): "lib.src.a", ("/r/p/__init__.py", "/r"): "p", ("/a.b/c+d/e.py", "/a.b/c+d"): "e", ("/axb/e.py", "/a.b"): ".axb.e"}
    for (path, root), want in cases.items():
        assert spark.range(1).select(module_key(F.lit(path), root).alias("m")).collect()[0].m == want


def test_sources(spark, tmp_path, tree):
    xml = '<coverage><packages><package><classes><class filename="m.py"><lines><line number="1" hits="0"/><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    (tmp_path / "c.xml").write_text(xml)
    assert sorted(tuple(r) for r in readers.cobertura(spark, str(tmp_path / "c.xml")).collect()) == [("m.py", 1, 2), ("m.py", 2, 0)]
    refs = readers.entrypoint_refs(spark, '[project.scripts]\nx = "pkg.cli:main"\n[project.entry-points.g]\ny = "pkg.z:run"\n')
    assert sorted(tuple(r) for r in refs.collect()) == [("pkg.cli", "main"), ("pkg.z", "run")]
    files = readers.source_tree(spark, tree)
    assert not files.where("path LIKE '%skipped%'").count()
    cached = files.where("path LIKE '%a.py'").select("path", "modificationTime", "length")
    todo, reuse, kept = readers.cache_split(files.select("path", "modificationTime", "length"), cached)
    assert (todo.count(), reuse.count(), kept.count()) == (5, 1, 1)
    docs = spark.createDataFrame([(1, "# One\nsee `pkg/a.py`\n## Two\n12 tools and `x/b.py`")], "id int, text string")
    assert sorted((r.heading, r.path) for r in readers.document_links(docs, "text").collect()) == [("One", "pkg/a.py"), ("Two", "x/b.py")]
    assert [r.claimed for r in readers.count_contradictions(docs, "text", 11).collect()] == [12]


def test_cache_reads_changed_files_only(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for n in "ab":
        (root / f"{n}.py").write_text(f"def {n}():\n    return 1\n")
    cache = str(tmp_path / "lake")

    def units():
        run = analyze(spark, str(root), cache=cache)
        found = {r.qualname for r in run.units.collect()}
        run.facts.unpersist()
        return found

    assert units() == {"a:a", "b:b"} == units()
    (root / "b.py").write_text("def other():\n    return 22\n")
    (root / "c.py").write_text("def c():\n    return 1\n")
    assert units() == {"a:a", "b:other", "c:c"} == units()
    from veinstone import engine
    from veinstone.sources import readers

    lake = readers.fact_lake(spark, cache, engine.FACTS_VERSION, "full")
    assert [sorted(r.path.rpartition("/")[2] for r in lake.part(p).collect()) for p in lake.read().parts] == [["a.py", "b.py"], ["b.py", "c.py"]]  # only what changed is written
    (root / "a.py").unlink()
    assert units() == {"b:other", "c:c"}


def test_command_line(spark, tree, tmp_path, capsys):
    from veinstone import cli

    base, out = str(tmp_path / "base"), tmp_path / "r.sarif"
    assert cli.main([tree, "--format", "json", "--baseline", base, "--update-baseline", "--fail-on-new"]) == 3
    assert "clone:new" in capsys.readouterr().err
    assert cli.main([tree, "--format", "sarif", "--output", str(out), "--baseline", base, "--fail-on-new", "--changed", "pkg/b.py"]) == 0
    results = json.loads(out.read_text())["runs"][0]["results"]
    assert results and {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results} == {"pkg/b.py"}
    assert {r["baselineState"] for r in results if r["ruleId"] == "clone"} == {"unchanged"}
    xml = tmp_path / "c.xml"
    xml.write_text('<coverage><class filename="pkg/a.py"><lines><line number="5" hits="0"/></lines></class></coverage>')
    assert cli.main([tree, "--coverage", str(xml), "--fail-coverage-hotspots", "--fail-complexity", "3", "--changed", "pkg/c.py"]) == 3
    shown = capsys.readouterr()
    assert "metric:complexity_threshold" in shown.err and "pkg.c:orphan" in shown.out and "pkg.b" not in shown.out.split("findings")[1].split("cycles")[0]


def test_tools_over_stored_runs(spark, tree, tmp_path):
    import shutil

    from veinstone.tools import Tools

    root = str(tmp_path / "copy")
    shutil.copytree(tree, root)
    tools = Tools(spark, str(tmp_path / "store"))
    first = tools.analyze_repository(root)
    assert tools.latest_run() == first and tools.latest_run(first + "zz") == first
    found = {r.id: r for r in tools.list_findings(first).collect()}
    assert "dead_code:pkg.c:orphan" in found and found["dead_code:pkg.c:orphan"].path == "pkg/c.py"
    assert tools.finding(first, "cycle:pkg.a").count() == 1 and tools.list_findings(first, limit=2).count() == 2
    assert [r.advice for r in tools.remediation(first, "cycle:pkg.a").collect()] == ["invert one import"]
    assert tools.hotspots(first, 1).collect()[0].subject == "pkg.a"
    assert tools.check(first, "complexity", 3).count() == 2 and tools.check(first, "dead_code").count() > 0
    assert tools.blast_radius(first, ["pkg.b"]).collect()[0].component == "pkg.a" and {r.dependent for r in tools.blast_artifact(first, "pkg.b").collect()} == {"pkg.a", "pkg.c", "pkg.tests.test_c"}
    assert tools.evaluate_gates(first, {"dependency_cycles": True}).collect()[0].exit_code == 3
    assert tools.report_section(first, "inventory").collect()[0].files == 6
    intent = tools.start_change(first, ["pkg/c.py"], "me")
    with pytest.raises(ValueError, match="another open intent"):
        tools.start_change(first, ["pkg/c.py"], "you")
    (tmp_path / "copy" / "pkg" / "c.py").write_text("def late():\n    return 1\n")
    second, changed = tools.analyze_changed_paths(root, ["pkg/c.py"])
    assert {r.id for r in changed.collect()} == {"dead_code:pkg.c:late"}
    diff = {r.key if "key" in r else r[0]: r.change for r in tools.compare_runs(first, second).collect()}
    assert diff["dead_code:pkg.c:late"] == "added" and diff["dead_code:pkg.c:orphan"] == "removed"
    assert tools.pr_summary(second, first, ["pkg"]).collect()[0].added >= 1
    assert tools.check_patch(intent, second, ["pkg/c.py", "pkg/a.py"]).collect()[0].out_of_scope == 1
    assert tools.finish_change(intent, second, ["pkg/c.py"]).collect()[0].accepted
    assert {(r.agent, r.state) for r in tools.session_stats().collect()} == {("me", "accepted")}
    tools.remember(spark.createDataFrame([("1", "note", "pkg/c.py", "The box"), ("2", "note", "pkg/d", "Other")], "id string, type string, subject string, statement string"))
    tools.decide(spark.createDataFrame([("1", "approve")], "id string, decision string"))
    assert [r.status for r in tools.memory("search", "box").collect()] == ["active"] and tools.memory("drafts").count() == 1
    assert [r.id for r in tools.memory("for_path", "pkg/c.py").collect()] == ["1"]
    assert [r.id for r in tools.memory("get", "2").collect()] == ["2"] and tools.memory("stale").count() == 0
    assert [r.id for r in tools.memory("for_symbol", "pkg/c.py").collect()] == ["1"]
    seen = {r.path for r in tools.table(tools.latest_run(), "units").select("path").distinct().collect()}
    assert [tuple(r) for r in tools.memory("coverage", "pkg/c.py").collect()] == [(1, 1, 100)]
    assert [tuple(r) for r in tools.memory("coverage").collect()] == [(len(seen), 1, round(100 / len(seen)))]
    texts = [("a", "dead_code:pkg.c:late is not new. But dead_code:pkg.c:late was introduced here."), ("b", "F-12 is fine, no regressions."), ("c", "cycle:pkg.a does not block the release")]
    said = tools.validate_claims(second, spark.createDataFrame(texts, "text_id string, text string"))
    assert {(r.text_id, r.id) for r in said["citations"].collect()} == {("a", "dead_code:pkg.c:late"), ("c", "cycle:pkg.a")}
    assert {(r.text_id, r.pattern) for r in said["violations"].collect()} == {("a", "regression_overclaim")}
    assert {(r.text_id, r.warning) for r in said["warnings"].collect()} == {("b", "no_citations"), ("b", "unknown_id:F-12")}
    assert [r.text_id for r in said["text_violations"].collect()] == ["b"]
    with pytest.raises(ValueError, match="no check"):
        tools.check(first, "taste")


def test_metric_families(spark, run):
    from veinstone.operators import reporting

    found = reporting.payload(run)
    assert set(found) == set(reporting.FAMILIES)
    assert found["dependencies"].collect()[0].cycles == 1 and found["dead_code"].collect()[0].suppressed == 1
    assert found["overloaded_modules"].count() == 5 and found["inventory"].columns == sorted(found["inventory"].columns)


def test_parse_limit(spark):
    from veinstone.operators import extract

    slow = "x = " + "+".join(["[1, 2, 3]"] * 400) + "\n"
    rows = [("/r/a.py", b"def f(): pass\n"), ("/r/b.py", (slow * 300).encode())]
    got = {r.path: (r.ok, r.error_kind) for r in extract.extract(spark.createDataFrame(rows, "path string, content binary"), "/r", seconds=0.05).collect()}
    assert got == {"/r/a.py": (True, None), "/r/b.py": (False, "parse_error")}


def test_security_surfaces():
    source = """import os, subprocess as sp
from typing import TYPE_CHECKING
from pathlib import Path
import http.server
import zipfile
if TYPE_CHECKING:
    import pickle
class A:
    def f(self):
        sp.run(["x"])
        os.spawnv(0, "x", [])
        open("a", "w"); open("b"); open("c", mode="r+")
        Path("x").write_text("y")
        zipfile.ZipFile("z").extractall()
        return eval("1")
from .pickle import loads
import yaml.nodes
"""
    found = [(c, n, line, q.partition(":")[2]) for c, n, line, q, _ in P.facts(source, "m")["surfaces"]]
    assert found == [
        ("process_boundary", "subprocess_import", 1, ""), ("network_boundary", "http_server_import", 4, ""), ("archive_extraction", "zipfile_import", 5, ""), ("process_boundary", "subprocess_run", 10, "A.f"),
        ("process_boundary", "os_spawn", 11, "A.f"), ("filesystem_mutation", "builtin_open_write", 12, "A.f"), ("filesystem_mutation", "pathlib_write_text", 13, "A.f"), ("archive_extraction", "zip_extract", 14, "A.f"),
        ("dynamic_execution", "dynamic_eval", 15, "A.f"), ("deserialization", "yaml_import", 17, ""),
    ]


def test_deep_expressions(spark):
    from veinstone.operators import extract

    rows = [("/r/a.py", ("def f():\n    return " + " + ".join(["x"] * 3000) + "\n").encode())]
    got = extract.extract(spark.createDataFrame(rows, "path string, content binary"), "/r").collect()[0]
    assert (got.ok, got.error) == (True, None)


def test_memory_records_against_places(spark):
    from veinstone.operators import records

    rows = spark.createDataFrame([("1", "a"), ("2", "a/b/"), ("3", "a/b/c.py"), ("4", "a/x.py"), ("5", "m.f"), ("6", "m.g"), ("7", None)], "id string, subject string")
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("z.py",), (None,)], "path string")
    names = spark.createDataFrame([("m.f",), (None,)], "qualname string")
    assert sorted(r.id for r in records.without_place(rows, paths, names).collect()) == ["4", "6", "7"]

    def coverage(ids, scope):
        return tuple(records.subject_coverage(rows.where(rows.id.isin(ids)), paths, scope).first())

    assert coverage(["2"], []) == (3, 1, 33) and coverage(["1"], []) == (3, 2, 67)
    assert coverage(["3"], ["a/b/c.py", "a/b/"]) == (2, 1, 50) and coverage(["1"], ["nowhere"]) == (1, 0, 0)
    assert tuple(records.subject_coverage(rows, paths.limit(0), []).first()) == (0, 0, 100)


def test_trajectory_modes(spark, tmp_path):
    from veinstone.tools import Tools

    kinds = "workflow_id string, seq long, event_type string, status string, severity string, surface string, tool string, core string, core_sha string"
    rows = [("w1", 1, "intent.declared", "active", "info", "mcp", "t", "{}", "x"), ("w1", 2, "patch.verified", "accepted", "info", "mcp", "t", "{}", "x"), ("w2", 3, "intent.declared", "active", "error", "hook", "t", "{}", "x")]
    events, tools = spark.createDataFrame(rows, kinds), Tools(spark, str(tmp_path))
    assert [r.workflow_id for r in tools.trajectory(events, "get", "w2").collect()] == ["w2"]
    assert [r.workflow_id for r in tools.trajectory(events, "search", "patch.verified").collect()] == ["w1"]
    assert sum(r.n for r in tools.trajectory(events, "status").collect()) == 2
    assert all(r.n >= 1 and r.first in ("w1", "w2") for r in tools.trajectory(events, "anomalies").collect())
    with pytest.raises(ValueError):
        tools.trajectory(events, "none").collect()
