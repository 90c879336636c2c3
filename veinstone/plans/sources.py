"""The extractor over Python files written from ``part``: one file a part, whose shape
follows from the part's key and size, so that SQL can count its facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import clones as C
from veinstone.operators import context, gates, graph, joins
from veinstone.operators import extract as X
from veinstone.operators import metrics as M
from veinstone.plans.registry import query
from veinstone.session import cut_lineage, read_table


#: Files that a task extracts.
PART = 20_000


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): every 13th file is a test, every 50th does not parse."""
    p = read_table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("z"))
    k, z = F.col("k"), F.col("z")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def some(where: Column, *lines: Column) -> Column:
        return F.when(where, F.array(*lines)).otherwise(F.array().cast("array<string>"))

    def each(n: Column, *lines) -> Column:
        steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
        return F.flatten(F.transform(steps, lambda i: F.array(*[line(i) for line in lines])))

    n_if = z % 4
    lines = F.concat(
        F.array(F.lit("import os"), text("from m", k % 7, ".f", k % 11, " import g", k % 11)),
        some(z % 6 == 0, F.lit("import subprocess")), some(z % 10 == 3, F.lit("import pickle")), some(z % 5 == 1, F.lit("from flask import Flask"), F.lit("app = Flask(__name__)")),
        F.array(F.lit(""), text("class C", k, ":"), F.lit("    def a(self): return self.x"), text("    def b(self): return self.", F.when(k % 2 == 0, "x").otherwise("y")), text("    def c(self, n: int): return g", k % 11, "(n)"), F.lit("")),
        some(k % 4 == 0, F.lit("# veinstone: ignore[dead-code]")),
        F.array(text("def f", k, "(n: int, m=0)", F.when(k % 3 == 0, " -> int").otherwise(""), ":")), some(k % 2 == 0, F.lit('    """Doc."""')),
        each(k % 3, lambda i: text("    if n < ", i, ":"), lambda i: text("        return ", i)), F.array(F.lit("    total = 0")),
        each(n_if, lambda i: F.concat(F.repeat(F.lit("    "), i.cast("int")), text("if n > ", i, ":"))), some(n_if > 0, F.concat(F.repeat(F.lit("    "), (n_if + 1).cast("int")), F.lit("total += 1"))),
        F.array(F.lit("    for x in range(n):"), F.lit("        total += x"), F.lit("    return total"), F.lit("")),
        some(z % 3 == 0, text("def h", k, "(): return f", k, "(C", k, "().a(), os.getpid())")), some(z % 5 == 1, F.lit("@app.route('/x')"), text("def r", k, "(): return 1")),
    )
    folder = F.when(k % 13 == 0, "tests").otherwise(F.concat(F.lit("m"), (k % 7).cast("string")))
    content = F.when(k % 50 == 49, "def (:").otherwise(F.array_join(lines, "\n"))
    parts = max(8, spark.sparkContext.defaultParallelism, -(-p.count() // PART))
    return p.select(F.concat(F.lit("src/"), folder, F.lit("/f"), k.cast("string"), F.lit(".py")).alias("path"), F.encode(content, "UTF-8").alias("content")).repartition(parts, "path")


def facts(spark: SparkSession, sf: str, *families: str) -> DataFrame:
    """Some families of facts; extracted once where several steps read them."""
    found = X.extract(files(spark, sf), "src", families=families)
    return cut_lineage(found.select("path", "module", "ok", *families)) if len(families) > 1 else found


def family(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One fact table, without the others."""
    return X.family(facts(spark, sf, name), name)


_P = """p AS (SELECT *, fs + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 2 * (k % 3) + 1 + CASE WHEN z % 4 > 0 THEN z % 4 + 1 ELSE 0 END + 3 AS fe FROM (SELECT *, cs + 5 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS fs FROM (
  SELECT k, z, CASE WHEN k % 13 = 0 THEN 'tests' ELSE 'm' || k % 7 END || '.f' || k AS module, 'src/' || CASE WHEN k % 13 = 0 THEN 'tests' ELSE 'm' || k % 7 END || '/f' || k || '.py' AS path, k % 13 = 0 AS test,
    4 + CASE WHEN z % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN z % 10 = 3 THEN 1 ELSE 0 END + CASE WHEN z % 5 = 1 THEN 2 ELSE 0 END AS cs, 2 + CASE WHEN z % 6 = 0 THEN 1 ELSE 0 END AS imports
  FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS z FROM part) WHERE k % 50 <> 49))),
u AS (SELECT k, z, module || ':C' || k || '.a' AS qualname, cs + 1 AS s, cs + 1 AS e, 1 AS stmts, 1 AS cc, 0 AS nest, 0 AS guards, path, 'a' AS sort FROM p UNION ALL SELECT k, z, module || ':C' || k || '.b', cs + 2, cs + 2, 1, 1, 0, 0, path, 'b' FROM p
  UNION ALL SELECT k, z, module || ':C' || k || '.c', cs + 3, cs + 3, 1, 1, 0, 0, path, 'c' FROM p UNION ALL SELECT k, z, module || ':f' || k, fs, fe, 2 * (k % 3) + 4 + CASE WHEN z % 4 > 0 THEN z % 4 + 1 ELSE 0 END, 2 + k % 3 + z % 4, greatest(z % 4, 1), k % 3, path, 'f' FROM p
  UNION ALL SELECT k, z, module || ':h' || k, fe + 2, fe + 2, 1, 1, 0, 0, path, 'h' FROM p WHERE z % 3 = 0 UNION ALL SELECT k, z, module || ':r' || k, fe + 3 + CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END, fe + 3 + CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END, 1, 1, 0, 0, path, 'r' FROM p WHERE z % 5 = 1)"""


def _i(x: str, name: str) -> str:
    return f"CAST({x} AS INTEGER) AS {name}"


@query(f"""WITH {_P} SELECT path, qualname, {_i('s', 'start')}, {_i('e', 'end')}, {_i('e - s + 1', 'loc')}, {_i('stmts', 'stmt_count')}, {_i('cc', 'cc')}, {_i('nest', 'nesting')}, {_i('guards', 'guards')},
 CASE guards WHEN 0 THEN 'none' WHEN 1 THEN 'return' ELSE 'return,return' END AS guard_profile, FALSE AS guard_after_effect, 'return' AS terminal, CASE WHEN e - s < 19 THEN '0-19' WHEN e - s < 49 THEN '20-49' ELSE '50-99' END AS loc_bucket FROM u""")
def source_units(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.1, 2.3.2, 2.3.4, 2.3.5, 2.3.14, 2.3.15, 2.3.36."""
    return family(spark, sf, "units").drop("fingerprint", "raw_hash")


@query(f"""WITH {_P}, f AS (SELECT *, CASE WHEN e - s < 19 THEN '0-19' ELSE '20-49' END AS bucket FROM u WHERE sort = 'f' AND e - s + 1 >= 10 AND stmts >= 6)
SELECT count(*) AS items, count(*) AS raw_hashes, count(*) AS files, count(*) AS functions, min(qualname) AS first_qualname, 'Type-2' AS clone_type FROM f GROUP BY k % 3, z % 4, bucket HAVING count(*) > 1""")
def source_clones(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.6, 2.3.8, 2.3.10, 2.3.3, 2.4.1: functions that differ in names and numbers only."""
    return C.function_groups(C.eligible(family(spark, sf, "units"))).drop("group_key", "group_id")


@query(f"""WITH {_P}, f AS (SELECT k, qualname, stmts, k % 3 AS a, z % 4 AS b FROM u WHERE sort = 'f') SELECT qualname, CAST(stmts AS BIGINT) AS statements, CAST(0 AS BIGINT) AS asserts,
 CAST(CASE WHEN a > 0 THEN 2 ELSE 0 END + 1 + CASE WHEN b > 0 THEN b + 1 ELSE 0 END + 2 + 1 AS BIGINT) AS forms FROM f""")
def source_statements(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.7: statements of the functions and their distinct normal forms: guards are of one form,
    ``+= 1`` and ``+= x`` of two, ifs of one for each depth."""
    s = family(spark, sf, "stmts").where(F.col("qualname").rlike(r":f[0-9]+$"))
    return s.groupBy("qualname").agg(F.count("*").alias("statements"), F.count_if("is_assert").alias("asserts"), F.countDistinct("hash").alias("forms"))


@query(f"""WITH {_P} SELECT path, module || ':C' || k AS qualname, {_i('cs', 'start')}, {_i('cs + 3', 'end')}, 1 AS cbo, CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END AS lcom4, 3 AS methods, 'low' AS coupling_risk, CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'medium' END AS cohesion_risk FROM p""")
def source_classes(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.18 to 2.3.22."""
    c = family(spark, sf, "classes")
    return c.withColumns({"coupling_risk": S.coupling_risk(F.col("cbo")), "cohesion_risk": S.cohesion_risk(F.col("lcom4"))})


@query(f"""WITH {_P} SELECT module AS source, 'os' AS target, 'import' AS kind, 1 AS line, path FROM p UNION ALL SELECT module, 'm' || k % 7 || '.f' || k % 11, 'from', 2, path FROM p
UNION ALL SELECT module, 'subprocess', 'import', 3, path FROM p WHERE z % 6 = 0 UNION ALL SELECT module, 'pickle', 'import', CAST(imports + 1 AS INTEGER), path FROM p WHERE z % 10 = 3
UNION ALL SELECT module, 'flask', 'from', CAST(cs - 3 AS INTEGER), path FROM p WHERE z % 5 = 1""")
def source_imports(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.23, 2.1.2."""
    return family(spark, sf, "deps")


@query(f"""WITH {_P}, e AS (SELECT DISTINCT module AS src, 'm' || k % 7 || '.f' || k % 11 AS dst FROM p), r AS (SELECT DISTINCT string_split(module, '.')[1] AS root FROM p)
SELECT src, dst FROM e WHERE string_split(dst, '.')[1] IN (SELECT root FROM r)""")
def source_import_graph(spark: SparkSession, sf: str) -> DataFrame:
    """2.7.1 to 2.7.3 over the extracted imports: edges whose target is in the tree."""
    f = cut_lineage(facts(spark, sf, "deps"))
    roots = f.where("ok").select(F.substring_index("module", ".", 1).alias("root")).distinct()
    return graph.internal(graph.edges(X.family(f, "deps"), "source", "target"), roots)


@query(f"WITH {_P} SELECT path, {_i('fs', 'line')}, 'dead-code' AS rule FROM p WHERE k % 4 = 0")
def source_suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.28: directives, on the line that they bind to."""
    return family(spark, sf, "suppressions")


_CAND = """c AS (SELECT module || ':C' || k AS qualname, 'C' || k AS local_name, k, z, FALSE AS sup, 'class' AS kind, path, cs AS s, cs + 3 AS e FROM p WHERE NOT test UNION ALL SELECT qualname, 'C' || k || '.' || sort, k, z, FALSE, 'method', path, s, e FROM u WHERE sort IN ('a', 'b', 'c') AND k % 13 <> 0
  UNION ALL SELECT qualname, sort || k, k, z, sort = 'f' AND k % 4 = 0, 'function', path, s, e FROM u WHERE sort IN ('f', 'h') AND k % 13 <> 0)"""


@query(f"WITH {_P}, {_CAND} SELECT path, qualname, local_name, kind, {_i('s', 'start')}, {_i('e', 'end')}, sup AS suppressed FROM c")
def source_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.27, 2.3.29, 2.3.30: definitions that may be dead, and which are suppressed."""
    f = facts(spark, sf, "candidates", "suppressions")
    return X.suppressed(X.family(f, "candidates"), X.family(f, "suppressions"))


@query(f"""WITH {_P}, {_CAND} SELECT qualname, sup AS suppressed, CASE WHEN local_name LIKE '%.a' AND (SELECT count(*) FROM p WHERE z % 3 = 0 AND NOT test) > 0 THEN 'medium' ELSE 'high' END AS confidence
FROM c WHERE NOT (z % 3 = 0 AND (local_name = 'f' || k OR local_name = 'C' || k))""")
def source_dead_code(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.24, 2.3.25, 2.8.4 to 2.8.6 over extracted names."""
    f = facts(spark, sf, "candidates", "suppressions", "names", "qualnames", "reach")
    c = X.suppressed(X.family(f, "candidates"), X.family(f, "suppressions"))
    names, quals = (X.referenced(f, n) for n in ("names", "qualnames"))
    return joins.unreferenced(c, names, quals, X.family(f, "reach").select("qualname")).select("qualname", "suppressed", "confidence")


@query(f"""WITH {_P}, n AS (SELECT k, unnest(['self', 'x', 'n', 'range', 'total', 'int', 'g' || k % 11] || CASE WHEN k % 2 = 1 THEN ['y'] ELSE [] END || CASE WHEN z % 3 = 0 THEN ['f' || k, 'C' || k, 'a', 'os', 'getpid'] ELSE [] END || CASE WHEN z % 5 = 1 THEN ['Flask', '__name__', 'app', 'route'] ELSE [] END) AS name FROM p WHERE NOT test)
SELECT DISTINCT name FROM n""")
def source_names(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.24, 2.3.42: names that are read; those of tests do not count."""
    return X.referenced(facts(spark, sf, "names"), "names")


@query(f"""WITH {_P}, n AS (SELECT 'm' || k % 7 || '.f' || k % 11 || ':g' || k % 11 AS name FROM p WHERE NOT test UNION SELECT 'os:getpid' FROM p WHERE NOT test AND z % 3 = 0 UNION SELECT 'flask:Flask' FROM p WHERE NOT test AND z % 5 = 1) SELECT DISTINCT name FROM n""")
def source_qualnames(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.25: what the names mean by the imports."""
    return X.referenced(facts(spark, sf, "qualnames"), "qualnames")


@query(f"""WITH {_P} SELECT module || ':C' || k || '.c' AS caller, 'm' || k % 7 || '.f' || k % 11 || ':g' || k % 11 AS callee, TRUE AS resolved, {_i('cs + 3', 'line')}, path FROM p UNION ALL SELECT module || ':f' || k, 'range', FALSE, CAST(fe - 2 AS INTEGER), path FROM p
UNION ALL SELECT module || ':h' || k, unnest([module || ':f' || k, module || ':C' || k, 'C' || k || '().a', 'os:getpid']), unnest([TRUE, TRUE, FALSE, TRUE]), CAST(fe + 2 AS INTEGER), path FROM p WHERE z % 3 = 0""")
def source_calls(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.26."""
    return family(spark, sf, "calls")


@query(f"""WITH {_P} SELECT 'process_boundary' AS category, count(*) AS items, count(DISTINCT path) AS modules FROM p WHERE z % 6 = 0 HAVING count(*) > 0 UNION ALL SELECT 'deserialization', count(*), count(DISTINCT path) FROM p WHERE z % 10 = 3 HAVING count(*) > 0
UNION ALL SELECT 'network_boundary', count(*), count(DISTINCT path) FROM p WHERE z % 5 = 1 HAVING count(*) > 0""")
def source_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.31, 2.6.21."""
    return family(spark, sf, "surfaces").groupBy("category").agg(F.count("*").alias("items"), F.countDistinct("path").alias("modules"))


@query(f"""WITH {_P}, r AS (SELECT unnest(['framework', 'edge_kind', 'confidence']) AS dimension, unnest(['flask', 'registers_handler', 'high']) AS value FROM p WHERE z % 5 = 1) SELECT dimension, value, count(*) AS n FROM r GROUP BY 1, 2""")
def source_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.32, 2.6.22."""
    return context.counts_by(family(spark, sf, "reach"), "framework", "edge_kind", "confidence")


@query(f"""WITH {_P}, a AS (SELECT *, CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN z % 5 = 1 THEN 1 ELSE 0 END AS more FROM p)
SELECT count(*) * 3 AS params, count(*) * 2 AS annotated, CAST(sum(4 + more) AS BIGINT) AS returns, count(*) FILTER (k % 3 = 0) AS returns_annotated, CAST(sum(5 + more) AS BIGINT) AS public, count(*) FILTER (k % 2 = 0) AS documented FROM a""")
def source_adoption(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.33, 2.6.6."""
    a = facts(spark, sf, "adoption").where("ok").select("adoption.*")
    return a.agg(*[F.sum(c).alias(c) for c in a.columns])


@query(f"""WITH {_P} SELECT path, qualname, CASE sort WHEN 'c' THEN ['self:', 'n:int'] WHEN 'f' THEN ['n:int', 'm:'] WHEN 'h' THEN [] WHEN 'r' THEN [] ELSE ['self:'] END AS params, CASE WHEN sort IN ('a', 'b', 'c') THEN 'method' ELSE 'function' END AS kind FROM u
UNION ALL SELECT path, module || ':C' || k, [], 'class' FROM p""")
def source_api(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.34, 2.3.35, 2.1.17: the public names with their parameters."""
    return family(spark, sf, "api")


@query(f"""WITH {_P} SELECT path, 'C' || k AS class, CAST(3 AS BIGINT) AS methods, CAST(1 AS BIGINT) AS candidate, CAST(0 AS BIGINT) AS noop_stub, CAST(0 AS BIGINT) AS dunder, CAST(0 AS BIGINT) AS override FROM p""")
def source_instance_methods(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.39, 2.5.11: methods that never use their instance."""
    return gates.instance_methods(family(spark, sf, "methods").withColumn("kind", F.col("why")))


@query(f"WITH {_P} SELECT path, module || ':f' || k AS qualname, count(*) AS branches FROM (SELECT path, module, k, unnest(range(0, z % 4)) AS i FROM p) GROUP BY ALL")
def source_branches(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.37, 2.3.38: branches with more than a trivial statement."""
    return family(spark, sf, "branches").groupBy("path", "qualname").agg(F.count("*").alias("branches"))


@query(f"""WITH {_P} SELECT (SELECT count(*) FROM part) AS files, count(*) AS analysed, (SELECT count(*) FROM part) - count(*) AS failed, CAST(sum(fe + 1 + CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN z % 5 = 1 THEN 2 ELSE 0 END - CASE WHEN z % 3 <> 0 AND z % 5 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS lines,
 CAST(sum(1 + CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN z % 5 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS functions, count(*) * 3 AS methods, count(*) AS classes FROM p""")
def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.3, 2.3.40, 2.6.25."""
    s = facts(spark, sf, "stats").select("ok", "error_kind", "stats.*")
    return s.agg(F.count("*").alias("files"), F.count_if("ok").alias("analysed"), F.count("error_kind").alias("failed"), *[F.sum(c).alias(c) for c in ("lines", "functions", "methods", "classes")])


@query(f"""WITH {_P}, m AS (SELECT 'src/' || CASE WHEN k % 13 = 0 THEN 'tests' ELSE 'm' || k % 7 END || '/f' || k || '.py' AS path, k FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part))
SELECT path, CASE WHEN k % 50 = 49 THEN 'parse_error' END AS error_kind, CASE WHEN k % 13 = 0 THEN 'tests' ELSE 'production' END AS kind, k % 13 = 0 AS test FROM m""")
def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """2.3.41, 2.3.42, 2.1.4: what became of each file."""
    path = F.col("path")
    return facts(spark, sf).select("path", "error_kind", S.source_kind(path).alias("kind"), S.is_test_path(path).alias("test"))


@query(f"""WITH {_P}, c AS (SELECT CAST(cc AS DOUBLE) AS cc, qualname FROM u) SELECT round_even(avg(cc), 4) AS average, CAST(max(cc) AS INTEGER) AS maximum, coalesce(list_sort(list(DISTINCT qualname) FILTER (cc > 20)), []) AS high_risk FROM c""")
def source_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """2.6.2 over extracted functions."""
    return M.complexity_summary(family(spark, sf, "units"))
