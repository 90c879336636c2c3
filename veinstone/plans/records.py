"""Record, scan, job, vector-check and report queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import records as R
from veinstone.operators import reporting as P
from veinstone.plans.registry import query
from veinstone.session import read_table


@query("""SELECT p_partkey, trim(p_name) || ' part ' || CASE WHEN p_size > 25 THEN 'big ' ELSE '' END || 'path a/' || p_size || ' brand ' || trim(p_brand) || ' type x' AS text FROM part""")
def record_search_text(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    subjects = F.array(F.struct(F.lit("path").alias("kind"), F.concat(F.lit("a\\"), F.col("p_size").cast("string")).alias("key")))
    fields = [F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit("part"), F.when(F.col("p_size") > 25, "big").otherwise("")]
    return p.select("p_partkey", R.search_text(fields, subjects, F.create_map(F.lit("type"), F.lit("x"), F.lit("brand"), F.col("p_brand"))).alias("text"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'the') AND contains(lower(coalesce(text, '')), 'and')")
def like_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.like_matches(read_table(spark, sf, "documents"), "doc_id", F.col("text"), "The and", every=True)


@query("""SELECT event_id, CAST(ceil(length(j) / 4.0) AS BIGINT) AS estimate, sha256(j) AS digest FROM (SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS j FROM events)""")
def payload_digests(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    body = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return e.select("event_id", R.payload_estimate(body).alias("estimate"), R.content_digest(body).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN FALSE ELSE CAST(event_id AS VARCHAR) = CAST(event_id % 1000 AS VARCHAR) OR starts_with(CAST(event_id % 1000 AS VARCHAR), CAST(event_id AS VARCHAR)) END AS same,
 sha1('duplicated_branches|qualname=m:' || event_type || '|sig=' || user_id) AS key, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN -7 ELSE -1 END AS number FROM events""")
def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    stored = F.when(i % 5 == 0, F.when(i % 2 == 0, "")).otherwise(i.cast("string"))
    number = F.when(i % 3 == 0, F.concat(F.lit(" "), i.cast("string"))).when(i % 3 == 1, "-7").otherwise(F.concat(F.lit("x"), i.cast("string")))
    return e.select(
        "event_id", R.run_matches(stored, (i % 1000).cast("string")).alias("same"), R.finding_key(F.concat(F.lit("m:"), "event_type"), F.col("user_id").cast("string")).alias("key"), R.as_int(number, -1).alias("number")
    )


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'empty collection' WHEN 2 THEN 'none (confirmed empty)' WHEN 3 THEN 'a, ' || lang ELSE lang END AS shown FROM documents""")
def metadata_shown(spark: SparkSession, sf: str) -> DataFrame:
    d, i = read_table(spark, sf, "documents"), F.col("doc_id")
    body = F.when(i % 5 == 0, "{}").when(i % 5 < 3, '{"f": []}').when(i % 5 == 3, F.concat(F.lit('{"f": ["'), "lang", F.lit('", "a", "'), "lang", F.lit('"]}'))).otherwise(F.concat(F.lit('{"f": "'), "lang", F.lit('"}')))
    return d.select("doc_id", F.when(i % 5 == 2, R.metadata_display(body, "f", True)).otherwise(R.metadata_display(body, "f")).alias("shown"))


@query("""SELECT event_id AS id, 'w' || user_id AS workflow_id FROM events WHERE event_type <> 'error' AND user_id % 4 <> 0 AND value IS NOT NULL""")
def audit_core_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    workflow = F.when(F.col("user_id") % 8 == 0, F.lit(None)).when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("w"), F.col("user_id").cast("string")))
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "other").otherwise("repo").alias("repo"), workflow.alias("workflow_id"), F.col("value").cast("string").alias("core_json"), F.sha2(F.col("value").cast("string"), 256).alias("core_sha"))
    return R.audit_scan(rows, "repo").select("id", "workflow_id")


@query("""WITH o AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN event_id - 1 END AS parent, event_id // 10 AS correlation, ts FROM events), l AS (SELECT correlation FROM o WHERE parent IS NULL ORDER BY ts DESC, id DESC LIMIT 20)
SELECT id, correlation FROM o WHERE correlation IN (SELECT correlation FROM l)""")
def last_operations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    o = read_table(spark, sf, "events").select(i.alias("id"), F.when(i % 10 != 0, i - 1).alias("parent"), F.floor(i / 10).alias("correlation"), F.col("user_id").alias("session"), F.col("ts").alias("started"))
    return R.select_operations(o, last=20).select("id", "correlation")


@query("""WITH j AS (SELECT o_custkey AS project, o_orderkey AS id, o_orderdate AS requested, CASE WHEN o_orderkey % 6 = 0 AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'pending' WHEN o_orderkey % 6 = 0 THEN 'running' WHEN o_orderkey % 3 = 1 THEN 'done' ELSE 'pending' END AS status FROM orders),
b AS (SELECT project, bool_or(status = 'running') AS busy FROM j GROUP BY 1), n AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY requested, id) AS r FROM j WHERE status = 'pending')
SELECT j.project, j.id, CASE WHEN NOT busy AND n.r = 1 THEN 'running' ELSE status END AS status, CASE WHEN NOT busy AND n.r = 1 THEN 'me' END AS claimed_by, CASE WHEN NOT busy AND n.r = 1 THEN 1 ELSE 0 END AS attempt FROM j JOIN b USING (project) LEFT JOIN n ON n.project = j.project AND n.id = j.id""")
def claimed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = read_table(spark, sf, "orders")
    jobs = o.select(
        F.col("o_custkey").alias("project"), k.alias("id"), F.when(k % 6 == 0, "running").when(k % 3 == 1, "done").otherwise("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("requested"),
        F.col("o_orderdate").cast("timestamp").alias("started"), F.lit(None).cast("string").alias("claimed_by"), F.lit(0).alias("attempt"),
    )
    return R.claim_next(jobs, "me", F.lit("1997-01-01 01:00:00").cast("timestamp")).select("project", "id", "status", "claimed_by", "attempt")


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN 'foreign' WHEN vec_id % 17 = 0 THEN 'dimensions' WHEN vec_id % 19 = 0 THEN 'not_finite' WHEN vec_id % 23 = 0 THEN 'digest' END AS fault
FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0 OR vec_id % 17 = 0 OR vec_id % 19 = 0 OR vec_id % 23 = 0""")
def stored_vector_faults(spark: SparkSession, sf: str) -> DataFrame:
    e, i = read_table(spark, sf, "embeddings"), F.col("vec_id")
    v = F.col("embedding").cast("array<double>")
    width = e.agg(F.max(F.size("embedding"))).collect()[0][0]
    vector = F.when(i % 17 == 0, F.slice(v, 1, 3)).when(i % 19 == 0, F.concat(F.slice(v, 1, F.size(v) - 1), F.array(F.lit(float("nan"))))).otherwise(v)
    rows = e.where("vec_id % 11 <> 0").select(i.alias("id"), vector.alias("vector"), F.when(i % 23 == 0, "old").otherwise("new").alias("digest"))
    return R.vector_faults(e.where("vec_id % 11 = 0 OR vec_id % 13 <> 0").select(i.alias("id"), F.lit("new").alias("digest")), rows, width or 0)


@query("""WITH g AS (SELECT p_size AS dims, p_partkey % 7 AS min_size, p_partkey % 3 AS min_samples, p_brand AS method, least(p_size % 16, 12) / 12 - (p_partkey % 5) / 10 AS score FROM part) SELECT dims, min_size, min_samples, method, round(score, 6) AS score FROM g ORDER BY score DESC, dims, min_size, min_samples, method LIMIT 1""")
def sweep_best(spark: SparkSession, sf: str) -> DataFrame:
    from veinstone.operators.vectors import sweep_score

    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    g = p.select(F.col("p_size").alias("dims"), (k % 7).alias("min_size"), (k % 3).alias("min_samples"), F.col("p_brand").alias("method"), sweep_score(F.col("p_size") % 16, (k % 5) / 10).alias("score"))
    return R.sweep_winner(g).withColumn("score", F.round("score", 6))


@query("""WITH i AS (SELECT CAST(doc_id % 6 AS INTEGER) - 1 AS label, unnest(['lang', 'source']) AS field, unnest([lang, source]) AS value FROM documents), g AS (SELECT label, field, value, count(*) AS n FROM i GROUP BY ALL),
r AS (SELECT *, round_even(n / sum(n) OVER (PARTITION BY label, field), 4) AS share, CAST(row_number() OVER (PARTITION BY label, field ORDER BY n DESC, value) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 3""")
def cluster_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").withColumn("label", (F.col("doc_id") % 6 - 1).cast("int"))
    return R.cluster_diagnostics(d, "label", ["lang", "source"])


@query("""WITH d AS (SELECT lang, text, CAST(greatest(1, ceil(length(text) / 1000.0)) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL), u AS (SELECT lang, n, i, substring(text, CAST(i * 1000 + 1 AS INTEGER), 1000) AS s FROM (SELECT *, unnest(range(0, n)) AS i FROM d))
SELECT lang, count(*) FILTER (i = 0) AS documents, count(*) AS units, count(*) FILTER (i = 0 AND n > 1) AS multi_unit, CAST(max(ceil(length(s) / 4.0)) AS BIGINT) AS largest, count(*) FILTER (ceil(length(s) / 4.0) > 200) AS overflow FROM u GROUP BY lang""")
def projection_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return R.projection_probe(read_table(spark, sf, "documents").where("text IS NOT NULL"), "lang", "text", 200, 1000)


@query("""WITH h AS (SELECT c_custkey AS id, 'customer' AS source, c_acctbal AS score, c_name AS text FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, s_name FROM supplier) SELECT * FROM h ORDER BY score DESC, source, id LIMIT 15""")
def semantic_hits(spark: SparkSession, sf: str) -> DataFrame:
    c, s = read_table(spark, sf, "customer"), read_table(spark, sf, "supplier")
    hits = c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("score")).union(s.select("s_suppkey", F.lit("supplier"), "s_acctbal")).union(s.select(-F.col("s_suppkey") - 1, F.lit("supplier"), F.lit(1e9)))
    rows = {"customer": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text")), "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))}
    return R.semantic_search(hits, rows, 15)


@query("""SELECT 'public_surface' AS type, 'symbol' AS subject_kind, p_name || p_partkey AS subject, CASE WHEN p_size > 25 THEN 'class()' ELSE 'function(a, ' || p_brand || ')' END AS statement FROM part UNION ALL SELECT 'public_surface', 'tool', n_name, 'tool ' || n_name FROM nation""")
def public_surface_records(spark: SparkSession, sf: str) -> DataFrame:
    big = F.col("p_size") > 25
    api = read_table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("qualname"), F.when(big, "class").otherwise("function").alias("kind"), F.when(big, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.col("p_brand"))).alias("params"))
    return R.public_surfaces(api, read_table(spark, sf, "nation").select(F.col("n_name").alias("name")))


_SEG = """i AS (SELECT l_partkey AS g, l_suppkey AS p, CAST(l_linenumber AS INTEGER) * 3 AS s FROM lineitem), d AS (SELECT DISTINCT g, p, s FROM i), m AS (SELECT *, CASE WHEN s <= lag(s + 4) OVER (PARTITION BY g, p ORDER BY s) + 1 THEN 0 ELSE 1 END AS fresh FROM d),
k AS (SELECT g, p, s, sum(fresh) OVER (PARTITION BY g, p ORDER BY s) AS island FROM m), r AS (SELECT g, p, min(s) AS s, max(s) + 4 AS e, count(*) AS n FROM k GROUP BY g, p, island)"""


@query(f"WITH {_SEG} SELECT g AS group_key, p AS path, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", n AS merged FROM r")
def block_reports(spark: SparkSession, sf: str) -> DataFrame:
    return P.block_report_groups(_items(spark, sf)).drop("qualname")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_linenumber").cast("int") * 3
    return read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("group_key"), F.col("l_suppkey").alias("path"), F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")).alias("qualname"), start.alias("start"), (start + 4).alias("end")).distinct()


@query(f"""WITH {_SEG}, t AS (SELECT p, line, unnest([0, 1, 2, 3]) AS q FROM (SELECT s_suppkey AS p, unnest(range(1, 26)) AS line FROM supplier)), k2 AS (SELECT p, q, line, CASE WHEN q = 0 THEN 'Assign' WHEN q = 1 THEN 'Expr' WHEN q = 2 AND line % 5 = 0 THEN 'If' WHEN line % 2 = 0 THEN 'Assign' ELSE 'Expr' END AS kind FROM t),
x AS (SELECT r.g, r.p, r.s, r.e, count(k2.kind) AS n, count(*) FILTER (kind = 'Assign') AS a, coalesce(bool_or(kind = 'If'), FALSE) AS flow, coalesce(bool_or(kind = 'Expr' AND line % 7 = 0), FALSE) AS acts, count(DISTINCT kind) AS kinds FROM r LEFT JOIN k2 ON k2.p = r.p AND k2.q = r.g % 4 AND k2.line BETWEEN r.s AND r.e GROUP BY ALL),
z AS (SELECT g FROM x GROUP BY g HAVING bool_and(n > 0) AND (bool_and(a >= 0.8 * n AND NOT flow AND NOT acts) OR bool_and(NOT flow AND kinds < 2)))
SELECT r.g AS group_key, r.p AS path, CAST(r.s AS INTEGER) AS start, CAST(r.e AS INTEGER) AS "end", r.n AS merged FROM r WHERE r.g NOT IN (SELECT g FROM z)""")
def segment_reports(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(25))).alias("start"))
    s = s.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    q, line = F.col("q"), F.col("start")
    kind = F.when(q == 0, "Assign").when(q == 1, "Expr").when((q == 2) & (line % 5 == 0), "If").when(line % 2 == 0, "Assign").otherwise("Expr")
    stmts = s.select("path", F.concat(F.lit("f"), q.cast("string")).alias("qualname"), "start", line.alias("end"), kind.alias("kind"), F.lit(True).alias("attribute_only"), ((kind == "Expr") & (line % 7 == 0)).alias("call"))
    return P.segment_report_groups(_items(spark, sf), stmts)[0].drop("qualname")


_SUG = """f AS (SELECT doc_id AS id, ['critical', 'warning', 'info'][doc_id % 3 + 1] AS severity, ['production', 'tests', 'fixtures', 'mixed', 'other'][doc_id % 5 + 1] AS kind, n_chars % 40 AS spread, n_chars % 97 AS priority, ['clones', 'structural', 'dead_code', 'metrics'][doc_id % 4 + 1] AS family FROM documents)"""


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    def pick(*values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))

    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), pick("critical", "warning", "info").alias("severity"), pick("production", "tests", "fixtures", "mixed", "other").alias("kind"), (F.col("n_chars") % 40).alias("spread"),
        (F.col("n_chars") % 97).alias("priority"), pick("clones", "structural", "dead_code", "metrics").alias("family"),
    )


@query(f"""WITH {_SUG}, r AS (SELECT 'most_actionable' AS list, row_number() OVER (ORDER BY priority DESC, id) AS rank, * FROM f WHERE severity <> 'info' UNION ALL SELECT 'highest_spread', row_number() OVER (ORDER BY spread DESC, priority DESC, id), * FROM f
 UNION ALL SELECT 'production_hotspots', row_number() OVER (ORDER BY priority DESC, id), * FROM f WHERE kind = 'production' UNION ALL SELECT 'test_fixture_hotspots', row_number() OVER (ORDER BY priority DESC, id), * FROM f WHERE kind IN ('tests', 'fixtures'))
SELECT list, CAST(rank AS INTEGER) AS rank, id, severity, kind, spread, priority, family FROM r WHERE rank <= 5""")
def report_overview(spark: SparkSession, sf: str) -> DataFrame:
    s = _suggestions(spark, sf)
    return P.cards(P.overview(s), s)


@query(f"""WITH {_SUG} SELECT {', '.join(f"count(*) FILTER (family = '{x}') AS family_{x}" for x in ('clones', 'structural', 'dead_code', 'metrics'))}, {', '.join(f"count(*) FILTER (kind = '{x}') AS kind_{x}" for x in ('production', 'tests', 'fixtures', 'mixed', 'other'))} FROM f""")
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.overview_counts(_suggestions(spark, sf))


@query("""SELECT 'dead_code:' || p_partkey AS id, 'dead_code' AS family, 'function' AS category, CASE WHEN p_size > 25 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN p_size > 25 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS priority, 1 AS count, p_brand AS path, p_size AS start, p_size + 1 AS "end" FROM part""")
def dead_code_report(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return P.dead_code_groups(p.select(F.col("p_partkey").cast("string").alias("qualname"), F.col("p_brand").alias("path"), F.lit("function").alias("kind"), F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end"), F.when(F.col("p_size") > 25, "high").otherwise("medium").alias("confidence")))


@query("""SELECT label, '{"label":' || label || ',"members":[' || array_to_string(list_sort(list(vec_id)), ',') || '],"run":"r1","size":' || count(*) || '}' AS line FROM (SELECT CAST(label AS INTEGER) AS label, vec_id FROM embeddings) GROUP BY label""")
def clustering_export(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("label"), F.col("vec_id").alias("id"))
    run = spark.range(1).select(F.lit("r1").alias("run"))
    return P.clustering_document(run, e.groupBy("label").agg(F.count("*").alias("size")), e)
