"""Join queries: range, anti, diff and prefix joins over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions.scalars import threshold_risk
from veinstone.operators import joins as J
from veinstone.plans.registry import query
from veinstone.session import read_table

_COVERAGE = """units AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS path, s_name AS qualname, CAST(s_suppkey * 7 % 900 AS INTEGER) AS start, CAST(s_suppkey * 7 % 900 + 40 AS INTEGER) AS "end",
    CASE WHEN s_acctbal <= 2000 THEN 'low' WHEN s_acctbal <= 6000 THEN 'medium' ELSE 'high' END AS risk FROM supplier
), lines AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(c_custkey % 1000 AS INTEGER) AS line, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS hits FROM customer WHERE c_nationkey % 5 <> 0
), j AS (
  SELECT u.path, qualname, start, "end", risk, CAST(count(line) AS INTEGER) AS executable, CAST(count(*) FILTER (hits > 0) AS INTEGER) AS covered
  FROM units u LEFT JOIN lines l ON l.path = u.path AND line BETWEEN start AND "end" GROUP BY ALL
), c AS (
  SELECT *, CASE WHEN path NOT IN (SELECT path FROM lines) THEN 'missing_from_report' WHEN executable = 0 THEN 'no_executable_lines' ELSE 'measured' END AS status,
    CASE WHEN executable > 0 THEN CAST(round_even(1000.0 * covered / executable, 0) AS INTEGER) ELSE 0 END AS permille FROM j
)"""


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    s, c = read_table(spark, sf, "supplier"), read_table(spark, sf, "customer")
    start = (F.col("s_suppkey") * 7 % 900).cast("int")
    units = s.select(
        F.col("s_nationkey").cast("string").alias("path"), F.col("s_name").alias("qualname"), start.alias("start"),
        (start + 40).alias("end"), threshold_risk(F.col("s_acctbal"), 2000, 6000).alias("risk"),
    )
    lines = c.where("c_nationkey % 5 <> 0").select(
        F.col("c_nationkey").cast("string").alias("path"), (F.col("c_custkey") % 1000).cast("int").alias("line"), F.when(F.col("c_acctbal") > 4000, 1).otherwise(0).alias("hits")
    )
    return J.coverage_join(units, lines)


@query(f"WITH {_COVERAGE} SELECT * FROM c")
def coverage_join(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf)


@query(f"""WITH {_COVERAGE} SELECT path, qualname, CASE WHEN status = 'measured' THEN 'hotspot' ELSE 'scope_gap' END AS finding, permille FROM c
WHERE risk IN ('medium', 'high') AND (status = 'missing_from_report' OR (status = 'measured' AND permille / 10.0 < 60))""")
def coverage_findings(spark: SparkSession, sf: str) -> DataFrame:
    c = _coverage(spark, sf)
    return c.where(J.is_coverage_hotspot() | J.is_scope_gap()).select("path", "qualname", F.when(J.is_scope_gap(), "scope_gap").otherwise("hotspot").alias("finding"), "permille")


@query("""WITH l AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'), n AS (SELECT DISTINCT p_name FROM part WHERE p_size > 45)
SELECT CAST(p_partkey AS VARCHAR) AS qualname, p_name AS local_name, p_size % 7 = 0 AS suppressed,
  CASE WHEN string_split(p_name, '.')[-1] IN (SELECT p_name FROM n) THEN 'medium' ELSE 'high' END AS confidence
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM l) AND p_name NOT IN (SELECT p_name FROM n) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def dead_symbols(spark: SparkSession, sf: str) -> DataFrame:
    p, li, s = (read_table(spark, sf, t) for t in ("part", "lineitem", "supplier"))
    cand = p.select(F.col("p_partkey").cast("string").alias("qualname"), F.col("p_name").alias("local_name"), (F.col("p_size") % 7 == 0).alias("suppressed"))
    used = li.where("l_shipdate < timestamp'1995-06-01'").select(F.col("l_partkey").cast("string"))
    return J.unreferenced(cand, p.where("p_size > 45").select("p_name"), used, s.select(F.col("s_suppkey").cast("string")))


@query("""WITH q AS (SELECT DISTINCT c_mktsegment || '.' || lower(n_name) || '.x' || c_custkey % 50 || ':run' AS qualname FROM customer JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT DISTINCT lower(n_name) || '.x' || n_nationkey || ':run' AS want FROM nation UNION SELECT 'BUILDING.' || lower(n_name) || '.x1:run' FROM nation),
e AS (SELECT want, qualname FROM r JOIN q ON want = qualname),
t AS (SELECT want, count(*) AS n, min(qualname) AS qualname FROM r JOIN q ON ends_with(qualname, '.' || want) WHERE want NOT IN (SELECT want FROM e) GROUP BY want)
SELECT want, qualname FROM e UNION ALL SELECT want, qualname FROM t WHERE n = 1""")
def entrypoint_symbols(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read_table(spark, sf, "customer"), read_table(spark, sf, "nation")
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat("c_mktsegment", F.lit("."), F.lower("n_name"), F.lit(".x"), (F.col("c_custkey") % 50).cast("string"), F.lit(":run")).alias("qualname")
    )
    r = n.select(F.concat(F.lower("n_name"), F.lit(".x"), F.col("n_nationkey").cast("string")).alias("module"), F.lit("run").alias("local"))
    return J.entrypoints(r.union(n.select(F.concat(F.lit("BUILDING."), F.lower("n_name"), F.lit(".x1")), F.lit("run"))), q)


_OLD, _NEW = "o_orderdate < timestamp'1997-01-01'", "o_orderdate >= timestamp'1996-06-01'"


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01')
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'unchanged' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return J.set_diff(o.where(_OLD), o.where(_NEW), "o_custkey")


@query("""WITH d AS (SELECT CASE WHEN a.k IS NULL THEN 'improvements' WHEN b.k IS NULL THEN 'regressions' ELSE 'unchanged' END AS side
  FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') b ON a.k = b.k)
SELECT side, count(*) AS n FROM d GROUP BY side""")
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    side = F.when(F.col("change") == "added", "regressions").when(F.col("change") == "removed", "improvements").otherwise("unchanged")
    return J.set_diff(o.where(_OLD), o.where(_NEW), "o_custkey").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


_API = """SELECT l_orderkey AS k, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey) AS p FROM lineitem WHERE {w} GROUP BY 1"""


@query(f"""WITH a AS ({_API.format(w="l_linenumber <= 3 AND l_orderkey % 5 <> 0")}), b AS ({_API.format(w="l_linenumber <= 4 AND l_orderkey % 7 <> 0")}),
j AS (SELECT coalesce(a.k, b.k) AS qualname, a.p AS pa, b.p AS pb, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.p <> b.p THEN 'signature_break' END AS change FROM a FULL JOIN b ON a.k = b.k)
SELECT CAST(qualname AS VARCHAR) AS qualname, change, CASE WHEN change = 'signature_break' THEN CAST(list_filter(range(1, greatest(len(pa), len(pb)) + 1), lambda i: pa[i] IS DISTINCT FROM pb[i])[1] AS INTEGER) ELSE 0 END AS position FROM j WHERE change IS NOT NULL""")
def api_changes(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")

    def side(where: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("f"))))
        return li.where(where).groupBy(F.col("l_orderkey").cast("string").alias("qualname")).agg(F.transform(x, lambda e: e["f"]).alias("params"))

    return J.api_diff(side("l_linenumber <= 3 AND l_orderkey % 5 <> 0"), side("l_linenumber <= 4 AND l_orderkey % 7 <> 0"))


@query("""WITH x AS (SELECT o_orderpriority AS path, CAST(o_custkey AS VARCHAR) AS symbol, count(*) FILTER (o_orderdate < TIMESTAMP '1996-06-01') AS b, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-06-01') AS a,
  max(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1996-06-01') AS pb, max(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1996-06-01') AS pa FROM orders GROUP BY 1, 2),
d AS (SELECT 'complexity' AS family, path, symbol, CAST(b AS DOUBLE) AS before, CAST(a AS DOUBLE) AS after, CAST(a - b AS DOUBLE) AS delta FROM x WHERE a > b AND b > 0
UNION ALL SELECT 'coupling', path, symbol, pb, pa, pa - pb FROM x WHERE pa > pb),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY delta DESC, family, path, symbol) AS INTEGER) AS rank FROM d)
SELECT family, path, symbol, before, after, round(delta, 4) AS delta, rank FROM r WHERE rank <= 25""")
def worsened_symbols(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")

    def side(where: str) -> DataFrame:
        return o.where(where).groupBy(F.col("o_orderpriority").alias("path"), F.col("o_custkey").cast("string").alias("symbol")).agg(F.count("*").cast("double").alias("cc"), F.max("o_totalprice").alias("cbo"))

    from veinstone.operators.windows import top_k

    b, a = side("o_orderdate < timestamp'1996-06-01'"), side("o_orderdate >= timestamp'1996-06-01'")
    both = J.worsened(b, a, "complexity", "cc").unionByName(J.worsened(b, a, "coupling", "cbo"))
    return top_k(both, [], [F.desc("delta"), F.col("family"), F.col("path"), F.col("symbol")], 25).withColumn("delta", F.round("delta", 4))


@query("""WITH c AS (SELECT unnest(['en/src1', 'de', 'fr/src19/d7']) AS p)
SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM c WHERE lang || '/' || source || '/d' || doc_id % 10 = p OR starts_with(lang || '/' || source || '/d' || doc_id % 10, p || '/'))""")
def changed_path_findings(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string"))).alias("path"))
    c = spark.createDataFrame([("en/src1",), ("de",), ("fr/src19/d7",)], "p string")
    return J.under_paths(d, "path", c, "p").select("doc_id")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst, CASE WHEN l_quantity < 3 THEN 'contradicts' WHEN l_quantity < 25 THEN 'supersedes' ELSE 'mentions' END AS kind FROM lineitem),
r AS (SELECT src AS id, 'supersedes' AS role, dst AS other FROM l WHERE kind = 'supersedes' UNION SELECT dst, 'superseded_by', src FROM l WHERE kind = 'supersedes'
 UNION SELECT src, 'contradicted_by', dst FROM l WHERE kind = 'contradicts' UNION SELECT dst, 'contradicted_by', src FROM l WHERE kind = 'contradicts')
SELECT id, role, list(other ORDER BY other) AS others FROM r GROUP BY 1, 2""")
def record_relations(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    links = li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.when(F.col("l_quantity") < 3, "contradicts").when(F.col("l_quantity") < 25, "supersedes").otherwise("mentions").alias("kind")).distinct()
    return J.relations(links)


_TRIPS = """t AS (SELECT event_id AS id, user_id AS workflow, ts AS at, [event_type || CAST(event_id % 40 AS VARCHAR), event_type || CAST(user_id % 40 AS VARCHAR)] AS subjects FROM events)"""


@query(f"""WITH {_TRIPS}, c AS (SELECT * FROM t WHERE id % 100 = 0), j AS (
  SELECT c.id, p.id AS pid, p.at AS finished, CAST(row_number() OVER (PARTITION BY c.id ORDER BY p.at DESC, p.id DESC) AS INTEGER) AS rank
  FROM c JOIN t p ON p.at < c.at AND p.workflow <> c.workflow AND list_has_any(c.subjects, p.subjects))
SELECT id, pid, finished, rank FROM j WHERE rank <= 3""")
def trajectory_precedents(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    subjects = F.array(*[F.concat("event_type", (F.col(c) % 40).cast("string")) for c in ("event_id", "user_id")])
    t = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("workflow"), F.col("ts").alias("at"), subjects.alias("subjects"))
    p = t.select(F.col("id").alias("pid"), F.col("workflow").alias("pworkflow"), F.col("at").alias("finished"), F.col("subjects").alias("psubjects"))
    return J.precedents(t.where("id % 100 = 0").withColumnRenamed("at", "started"), p, 3)


@query("""WITH i AS (SELECT s_suppkey AS id, list(DISTINCT l_partkey) FILTER (l_quantity > 49) AS h, list(DISTINCT l_partkey) FILTER (l_quantity < 2) AS s FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
p AS (SELECT id, unnest(h) AS p, TRUE AS h FROM i UNION SELECT id, unnest(s), FALSE FROM i)
SELECT a.id, b.id AS id2, CASE WHEN bool_or(a.h AND b.h) THEN 'hard' ELSE 'soft' END AS overlap, count(DISTINCT a.p) AS paths FROM p a JOIN p b ON a.p = b.p AND a.id < b.id AND (a.h OR b.h) GROUP BY 1, 2""")
def intent_scope_overlap(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    i = li.groupBy(F.col("l_suppkey").alias("id")).agg(
        F.collect_set(F.when(F.col("l_quantity") > 49, F.col("l_partkey"))).alias("hard"), F.collect_set(F.when(F.col("l_quantity") < 2, F.col("l_partkey"))).alias("soft")
    )
    return J.scope_overlap(i)


@query("""WITH f AS (SELECT doc_id AS finding_id, CASE quality WHEN 1 THEN 'info' ELSE 'warning' END AS severity FROM labels),
s AS (SELECT doc_id AS finding_id, arg_min(lang || source, n_chars * 100000 + doc_id) AS action FROM documents GROUP BY 1)
SELECT coalesce(f.finding_id, s.finding_id) AS finding_id, severity, action FROM f FULL JOIN s ON f.finding_id = s.finding_id""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    f = read_table(spark, sf, "labels").select(F.col("doc_id").alias("finding_id"), F.when(F.col("quality") == 1, "info").otherwise("warning").alias("severity"))
    s = read_table(spark, sf, "documents").select(F.col("doc_id").alias("finding_id"), F.col("n_chars").alias("rank"), F.concat("lang", "source").alias("action"))
    return J.review_queue(f, s)


@query("""SELECT n_name AS target, CASE WHEN regexp_matches(c_mktsegment, '^(BUILDING|MACHINERY)$') THEN 'tests' ELSE 'production' END AS kind, count(DISTINCT c_custkey) AS importers
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def importers_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    c, n = read_table(spark, sf, "customer"), read_table(spark, sf, "nation")
    e = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.col("n_name").alias("dst"), F.col("c_mktsegment").rlike("^(BUILDING|MACHINERY)$").alias("test"))
    return J.importers(e, F.col("test"))


_SIG = """s AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
o AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'class' ELSE 'function' END AS kind, list(struct_pack(name := 'a' || n, kind := 'pos_or_kw', d := p % 2 = 0) ORDER BY n) AS ps FROM s GROUP BY k),
w AS (SELECT k, CASE WHEN k % 9 = 0 OR k % 11 = 0 THEN 'class' ELSE 'function' END AS kind, list(struct_pack(name := CASE WHEN (k + n) % 13 = 0 THEN 'b' ELSE 'a' END || n, kind := CASE WHEN (k + n) % 17 = 0 THEN 'kw_only' ELSE 'pos_or_kw' END, d := p % 2 = 0 AND p % 5 <> 0) ORDER BY n) FILTER (k % 7 <> 0 OR n < 2) AS ps FROM s GROUP BY k)"""


@query(f"""WITH {_SIG}, j AS (SELECT o.k, o.kind AS ka, w.kind AS kb, o.ps AS a, coalesce(w.ps, []) AS b FROM o JOIN w ON w.k = o.k),
d AS (SELECT CAST(k AS VARCHAR) AS qualname, CASE WHEN ka <> kb THEN 'Changed public symbol kind from ' || ka || ' to ' || kb || '.' WHEN kb <> 'function' THEN NULL WHEN len(a) <> len(b) THEN 'Changed callable parameter count.'
 ELSE list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i].kind <> b[i].kind THEN 'Changed parameter kind for ' || a[i].name || ' from ' || a[i].kind || ' to ' || b[i].kind || '.' WHEN a[i].name <> b[i].name THEN 'Renamed public parameter ' || a[i].name || ' to ' || b[i].name || '.'
 WHEN a[i].d AND NOT b[i].d THEN 'Parameter ' || a[i].name || ' became required.' END), lambda x: x IS NOT NULL)[1] END AS detail FROM j) SELECT * FROM d WHERE detail IS NOT NULL""")
def signature_breaks(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    k, n, p = F.col("k"), F.col("n"), F.col("p")

    def side(name, kind, default, symbol, keep) -> DataFrame:
        one = F.struct("n", F.concat(name, n.cast("string")).alias("name"), kind.alias("kind"), default.alias("has_default"), F.lit("int").alias("annotation"))
        g = s.groupBy("k").agg(F.array_sort(F.collect_list(F.when(keep, one))).alias("params"))
        return g.select(k.cast("string").alias("qualname"), symbol.alias("kind"), "params", F.lit("int").alias("returns"))

    before = side(F.lit("a"), F.lit("pos_or_kw"), p % 2 == 0, F.when(k % 9 == 0, "class").otherwise("function"), F.lit(True))
    after = side(
        F.when((k + n) % 13 == 0, "b").otherwise("a"), F.when((k + n) % 17 == 0, "kw_only").otherwise("pos_or_kw"), (p % 2 == 0) & (p % 5 != 0),
        F.when((k % 9 == 0) | (k % 11 == 0), "class").otherwise("function"), (k % 7 != 0) | (n < 2),
    )
    return J.signature_breaks(before, after)


@query("""WITH r AS (SELECT 'caller' AS role, 'u' || l_suppkey AS symbol, 'f' || l_suppkey AS path, l_linenumber AS line FROM lineitem WHERE l_partkey = 7 UNION SELECT 'importer', 'm' || s_suppkey, 'f' || s_suppkey, 1 FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 'contract', 'p7:' || n_name, 'n', NULL FROM nation),
t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY path, line, symbol) AS turn FROM r) SELECT role, symbol, path, CAST(line AS INTEGER) AS line FROM t ORDER BY turn, role LIMIT 30""")
def symbol_context(spark: SparkSession, sf: str) -> DataFrame:
    li, s, n = (read_table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))

    def name(prefix: str, c: str):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    calls = li.select(name("u", "l_suppkey").alias("caller"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(":f")).alias("callee"), name("f", "l_suppkey").alias("path"), F.col("l_linenumber").cast("int").alias("line"))
    deps = s.select(name("m", "s_suppkey").alias("source"), F.when(F.col("s_suppkey") % 4 == 0, "p7").otherwise("other").alias("target"), name("f", "s_suppkey").alias("path"), F.lit(1).alias("line"))
    api = n.select(name("p7:", "n_name").alias("qualname"), F.lit("n").alias("path"))
    return J.around("p7:f", calls, deps, api, 30)
