"""Scalar, gate, reader and sink queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import claims, context, gates
from veinstone.operators import events as E
from veinstone.operators import ranking as R
from veinstone.plans.registry import query
from veinstone.session import read_table
from veinstone.sinks import report
from veinstone.sources import readers


@query("""SELECT doc_id, list_filter([CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN length(text) > 800 THEN 'long' END, CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 2 THEN 'multi_paragraph' END,
 CASE WHEN len(regexp_extract_all(lower(text), '(^|[ \n])(and|or|but|also)[ ,\n]')) >= 4 THEN 'compound' END, CASE WHEN starts_with(text, '<') THEN 'markup' END, CASE WHEN doc_id % 10 / 10 < CAST(0.2 AS DOUBLE) THEN 'weak' END], lambda x: x IS NOT NULL) AS flags FROM documents""")
def noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", S.noise_flags(F.col("text"), F.col("doc_id") % 10 / 10).alias("flags"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS DOUBLE)) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) + 0) AS v FROM n""")
def normal_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    v = F.when(F.col("vec_id") % 9 == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return read_table(spark, sf, "embeddings").select("vec_id", F.transform(S.l2_normal(v), lambda x: F.round(x, 6) + 0).alias("v"))


@query("""WITH h AS (SELECT event_id, sha256(event_type || event_id || chr(0) || '0') AS s FROM events), w AS (SELECT event_id, list_transform(range(0, 8), lambda j: CAST('0x' || substr(s, CAST(1 + 8 * j AS INTEGER), 8) AS BIGINT) / CAST(4294967295 AS DOUBLE) * 2 - 1) AS v FROM h)
SELECT event_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS v FROM w""")
def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("event_type", F.col("event_id").cast("string"))
    return read_table(spark, sf, "events").select("event_id", F.transform(S.hash_embedding(text, 8), lambda x: S.round_signed(x, 6)).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE greatest(0, (o_orderkey % 7 - 2) * 90) END AS seconds, least(100, least(40, o_orderkey % 30 * 2) + least(30, o_orderkey % 17 * 3) + least(20, o_orderkey % 19 * 2)) AS score FROM orders""")
def trajectory_scores(spark: SparkSession, sf: str) -> DataFrame:
    k, start = F.col("o_orderkey"), F.lit("2024-03-01 10:00:00").cast("timestamp")
    end = F.date_format(F.timestamp_seconds(F.unix_timestamp(start) + (k % 7 - 2) * 90), "yyyy-MM-dd'T'HH:mm:ss")
    seconds = S.duration_seconds(F.lit("2024-03-01T10:00:00"), F.when(k % 4 == 0, "soon").otherwise(end))
    return read_table(spark, sf, "orders").select("o_orderkey", seconds.alias("seconds"), S.complexity_score(k % 30, k % 17, k % 19).alias("score"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'intent:' || user_id WHEN event_id % 4 = 1 THEN 'run:' || event_type WHEN event_id % 4 = 2 THEN 'own' ELSE 'event:' || event_id END AS workflow,
 '{"core_schema_version":1,"event_family":"f","event_type":"' || event_type || '","status":"ok","facts":{"user":' || user_id || '}}' AS core FROM events""")
def event_cores(spark: SparkSession, sf: str) -> DataFrame:
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    workflow = E.workflow_id(F.when(i % 4 == 0, F.col("user_id").cast("string")).otherwise(""), F.when(i % 4 == 1, F.col("event_type")), F.when(i % 4 == 2, "own"), i)
    core = E.event_core(F.lit("f"), F.col("event_type"), F.lit("ok"), F.struct(F.col("user_id").alias("user")))
    return e.select("event_id", workflow.alias("workflow"), core.alias("core"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size >= 3 OR p_partkey % 3 > 1 THEN 'critical' ELSE 'warning' END ELSE CASE WHEN p_size >= 4 OR p_partkey % 3 > 1 THEN 'warning' ELSE 'info' END END AS severity FROM part""")
def structural_severities(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 2 == 0, "cohort_drift").otherwise("duplicated_branches")
    return read_table(spark, sf, "part").select("p_partkey", gates.structural_severity(kind, F.col("p_size"), F.col("p_partkey") % 3).alias("severity"))


@query("""SELECT 'complexity' AS category, CAST(p_partkey AS VARCHAR) AS subject, CASE WHEN p_size > 40 THEN 'critical' ELSE 'warning' END AS severity FROM part WHERE p_size > 20 UNION ALL SELECT 'coupling', CAST(s_suppkey AS VARCHAR), 'warning' FROM supplier WHERE s_suppkey % 20 > 10
UNION ALL SELECT 'cohesion', CAST(s_suppkey AS VARCHAR), 'warning' FROM supplier WHERE s_suppkey % 7 >= 4 UNION ALL SELECT 'dependency', r_name, 'critical' FROM region""")
def design_findings(spark: SparkSession, sf: str) -> DataFrame:
    units = read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("qualname"), F.col("p_size").alias("cc"))
    k = F.col("s_suppkey")
    classes = read_table(spark, sf, "supplier").select(k.cast("string").alias("qualname"), (k % 20).alias("cbo"), (k % 7).alias("lcom4"))
    return gates.design_groups(units, classes, read_table(spark, sf, "region").select(F.col("r_name").alias("component")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'preexisting' WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 THEN 'unattributed_in_scope' WHEN o_orderkey % 4 = 0 THEN 'own_out_of_scope' ELSE 'foreign' END AS class FROM orders""")
def dirty_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select("o_orderkey", gates.dirty_class(k % 2 == 0, k % 4 == 0, k % 3 == 0).alias("class"))


@query("""SELECT o_custkey AS repo, bool_or(o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS allowed FROM orders GROUP BY 1""")
def edits_allowed(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.when(F.col("o_orderstatus") == "F", "own_active").otherwise("own_stale").alias("state"), (F.col("o_orderkey") % 2 == 0).alias("authorised"))
    return gates.edit_allowed(o)


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 5 > 2 THEN 'complexity_growth' END, CASE WHEN o_orderkey % 3 > 0 THEN 'new_clones' END], lambda x: x IS NOT NULL) AS broken FROM (SELECT o_orderkey FROM orders)""")
def broken_budgets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", (k % 3).alias("new_clones"), F.lit(0).alias("new_cycles"), F.when(k % 5 > 2, 1).otherwise(0).alias("complexity_growth"))
    return o.select("o_orderkey", F.array_sort(gates.over_budget("strict")).alias("broken"))


@query("""SELECT c_custkey, list_sort(list_filter([CASE WHEN c_custkey % 50 < 10 THEN 'too_few_items' END, CASE WHEN c_custkey % 4 < 1 THEN 'no_clusters' END, CASE WHEN c_custkey % 10 / 10 > CAST(0.5 AS DOUBLE) THEN 'too_noisy' END, CASE WHEN c_custkey % 7 / 7 > CAST(0.8 AS DOUBLE) THEN 'one_dominates' END, CASE WHEN c_custkey % 4 > 2 THEN 'too_many_clusters' END], lambda x: x IS NOT NULL)) AS reasons FROM customer""")
def profile_suitability(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select("c_custkey", (k % 50).alias("items"), (k % 4).alias("clusters"), (k % 10 / 10).alias("noise_ratio"), (k % 7 / 7).alias("dominant_ratio"))
    return c.select("c_custkey", gates.suitability({"items": 10, "noise": 0.5, "dominant": 0.8, "clusters": 2}).alias("reasons"))


@query("""SELECT doc_id AS finding_id, CAST(doc_id % 3 AS INTEGER) AS run_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND d.doc_id % 3 = 1)""")
def unreviewed_findings(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("finding_id"), (F.col("doc_id") % 3).cast("int").alias("run_id"), "lang")
    marks = read_table(spark, sf, "labels").where("quality = 1").select(F.lit(1).alias("run_id"), F.col("doc_id").alias("finding_id"))
    return gates.without_reviewed(d, marks)


@query("""SELECT doc_id FROM documents WHERE list_has_all(list_transform(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_À-ɏ./-]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')), ['the', 'that'])""")
def token_matches(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return R.matches(d, "doc_id", F.col("text"), F.array(F.lit("the"), F.lit("that")), every=True)


@query("""SELECT s_suppkey AS origin, 'c' || s_nationkey AS component FROM supplier WHERE s_nationkey % 2 = 0""")
def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier")
    cycles = s.where("s_nationkey % 2 = 0").groupBy(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("component")).agg(F.collect_set("s_suppkey").alias("members"))
    return context.cycle_membership(cycles, s.select(F.col("s_suppkey").alias("origin")))


_SAID = """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Well. dead_code:p' || p_partkey || ' is surely unused. Attack it.' WHEN 1 THEN 'cycle:p' || p_partkey || ' does not really block anything' WHEN 2 THEN 'x dead_code:p' || p_partkey || ' was fixed' WHEN 3 THEN 'nothing here' ELSE 'cycle:p' || p_partkey || ' blocks it' END AS text FROM part"""


@query(f"""WITH t AS ({_SAID}) SELECT k AS text_id, CASE WHEN k % 5 IN (0, 2) THEN 'dead_code:p' ELSE 'cycle:p' END || k AS id, CASE k % 5 WHEN 0 THEN 'dead_code_certainty' WHEN 2 THEN 'fix_overclaim' ELSE 'gate_overclaim' END AS pattern, CASE k % 5 WHEN 0 THEN 'dead' WHEN 2 THEN 'fixed' ELSE 'block' END AS word FROM t WHERE k % 5 IN (0, 2, 4)
UNION ALL SELECT k, 'dead_code:p' || k, 'dead_code_certainty', 'dead' FROM t WHERE k % 5 = 2""")
def claim_violations(spark: SparkSession, sf: str) -> DataFrame:
    """2.10.11: what texts say of findings beyond what a run shows; the id itself names its family."""
    k = F.col("p_partkey")
    name = k.cast("string")
    said = F.when(k % 5 == 0, F.concat(F.lit("Well. dead_code:p"), name, F.lit(" is surely unused. Attack it."))).when(k % 5 == 1, F.concat(F.lit("cycle:p"), name, F.lit(" does not really block anything")))
    said = said.when(k % 5 == 2, F.concat(F.lit("x dead_code:p"), name, F.lit(" was fixed"))).when(k % 5 == 3, "nothing here").otherwise(F.concat(F.lit("cycle:p"), name, F.lit(" blocks it")))
    p = read_table(spark, sf, "part")
    family = F.when(k % 5 < 3, F.when(k % 5 == 1, "cycle").otherwise("dead_code")).otherwise("cycle")
    f = p.select(F.concat(family, F.lit(":p"), name).alias("id"), family.alias("family"), F.lit("medium").alias("confidence"), F.lit("new").alias("novelty"), F.lit(False).alias("reachable"), (family == "cycle").alias("report_only"))
    return claims.violations(claims.citations(p.select(k.alias("text_id"), said.alias("text")), f), f, compared=True)


@query("""SELECT 'src/f' || l_partkey % 500 || '.py' AS path, count(*) AS changes FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_partkey % 3 <> 0 GROUP BY 1 HAVING count(*) >= 10""")
def changed_often(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.14."""
    suffix = F.when(F.col("l_partkey") % 3 == 0, ".txt").otherwise(".py")
    log = read_table(spark, sf, "lineitem").select(F.concat(F.lit("src/f"), (F.col("l_partkey") % 500).cast("string"), suffix).alias("path"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return readers.churn(log, "1996-01-01")


@query("""SELECT DISTINCT doc_id, lang AS heading, source || '/x.py' AS path FROM documents""")
def documented_paths(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.15: paths in backticks under a heading."""
    text = F.concat(F.lit("# "), "lang", F.lit("\nsee `"), "source", F.lit("/x.py` and `plain`"))
    return readers.document_links(read_table(spark, sf, "documents").select("doc_id", text.alias("text")), "text")


@query("""SELECT DISTINCT CAST(p_size AS INTEGER) AS claimed FROM part WHERE p_size <> 11""")
def contradicted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.20."""
    text = F.concat(F.lit("It has "), F.col("p_size").cast("string"), F.lit(" tools."))
    return readers.count_contradictions(read_table(spark, sf, "part").select(text.alias("text")), "text", 11)


@query("""SELECT DISTINCT 'module_role' AS type, p_brand AS subject FROM part UNION ALL SELECT 'complexity', p_brand FROM part WHERE p_size > 40 UNION ALL SELECT 'security', p_brand FROM part WHERE p_size < 5""")
def memory_notes(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.16, 2.1.18, 2.1.21: roles and risk notes in one batch."""
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_brand").alias("module"), "p_size")
    return readers.merge_batches(readers.module_roles(p), readers.risk_notes(p.where("p_size > 40"), p.where("p_size < 5")).withColumnRenamed("reason", "type"))


@query("""SELECT source AS path, list_sort(list(DISTINCT lang || doc_id))[1:5] AS names FROM documents WHERE length(lang || doc_id) > 3 GROUP BY 1""")
def test_anchor_names(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.19."""
    return readers.test_anchors(read_table(spark, sf, "documents").select(F.col("source").alias("path"), F.concat("lang", F.col("doc_id").cast("string")).alias("name")))


@query("""SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS todo, count(*) FILTER (o_orderkey % 3 = 0) AS reuse, count(*) FILTER (o_orderkey % 6 = 0 OR o_orderkey % 6 = 3 OR o_orderkey % 6 = 1) AS kept FROM orders""")
def cache_plan(spark: SparkSession, sf: str) -> DataFrame:
    """2.1.5, 2.1.6, 2.1.8, 2.1.10: every third file is as it was, every sixth has changed, the
    cache also holds files that are gone."""
    k = F.col("o_orderkey")
    files = read_table(spark, sf, "orders").select(k.alias("path"), F.lit(1).alias("modificationTime"), F.lit(2).alias("length"))
    gone = files.select((F.col("path") + 10**9).alias("path"), "modificationTime", "length")
    cached = files.where("path % 3 = 0").unionByName(files.where("path % 6 = 1").withColumn("length", F.lit(3))).unionByName(gone)
    todo, reuse, kept = readers.cache_split(files, cached)
    return todo.agg(F.count("*").alias("todo")).join(reuse.agg(F.count("*").alias("reuse"))).join(kept.agg(F.count("*").alias("kept")))


@query("""WITH a AS (SELECT '[' || string_agg('{"n":' || n || ',"name":"' || name || '"}', ',' ORDER BY name) || ']' AS j FROM (SELECT n_name AS name, n_nationkey AS n FROM nation)), b AS (SELECT '[' || string_agg('{"n":' || n || ',"name":"' || name || '"}', ',' ORDER BY name) || ']' AS j FROM (SELECT r_name AS name, r_regionkey AS n FROM region)),
d AS (SELECT '{"nations":' || a.j || ',"regions":' || b.j || '}' AS body FROM a, b) SELECT '{"meta":{"root":"r"},"sections":' || body || '}' AS document, sha256(body) AS digest FROM d""")
def report_document(spark: SparkSession, sf: str) -> DataFrame:
    """2.2.1, 2.2.2: the canonical document and its digest."""
    n = read_table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"))
    r = read_table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("n"))
    return report.document({"regions": (r, ["name"]), "nations": (n, ["name"])}, {"root": "r"})


@query("""SELECT list_sort(list(DISTINCT source)) AS ids, sha256(array_to_string(list_sort(list(DISTINCT source)), chr(10))) AS digest FROM documents""")
def saved_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """2.2.10, 2.2.11."""
    return report.baseline(read_table(spark, sf, "documents"), "source")


@query("""WITH f AS (SELECT n_name AS path, 'r' || n_regionkey AS rule, n_nationkey AS line FROM nation), r AS (SELECT rule, row_number() OVER (ORDER BY rule) - 1 AS i FROM (SELECT DISTINCT rule FROM f)), p AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path FROM f)),
x AS (SELECT string_agg('{"ruleId":"' || f.rule || '","ruleIndex":' || r.i || ',"level":"warning","message":{"text":"m"},"baselineState":"' || CASE WHEN line % 2 = 0 THEN 'new' ELSE 'unchanged' END || '","partialFingerprints":{"primary":"k' || line || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || f.path || '","index":' || p.i || '},"region":{"startLine":' || line || '}}}]}', ',' ORDER BY f.rule, f.path, line) AS j FROM f JOIN r ON r.rule = f.rule JOIN p ON p.path = f.path)
SELECT '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"veinstone","rules":[' || (SELECT string_agg('{"id":"' || rule || '"}', ',' ORDER BY rule) FROM r) || ']}},"artifacts":[' || (SELECT string_agg('{"location":{"uri":"' || path || '"}}', ',' ORDER BY path) FROM p) || '],"results":[' || j || ']}]}' AS sarif FROM x""")
def sarif_log(spark: SparkSession, sf: str) -> DataFrame:
    """2.2.6."""
    n = read_table(spark, sf, "nation")
    return report.sarif(n.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("rule"), F.lit("warning").alias("level"), F.lit("m").alias("message"), F.col("n_name").alias("path"), F.col("n_nationkey").alias("line"),
        F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "new").otherwise("known").alias("novelty"),
    ))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, round(list_distance(v, list_transform(v, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE x END)), 6) + 0 AS distance FROM n""")
def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    """2.11.18, 2.11.19: how far each vector is from its direction."""
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", (F.round(S.euclidean(F.col("v"), S.l2_normal(F.col("v"))), 6) + 0).alias("distance"))
