"""Change-context queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import context as C
from veinstone.plans.graph import _EDGES, trade
from veinstone.plans.registry import query
from veinstone.session import read_table


@query("""SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def reachability_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.counts_by(read_table(spark, sf, "documents"), "lang", "source")


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events) AS agents, (SELECT count(*) FROM events WHERE event_type = 'view') AS intents, (SELECT count(*) FROM events WHERE event_type = 'view' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20') AS leased,
 (SELECT arg_max(event_id, (ts, event_id)) FROM events WHERE event_type = 'purchase') AS latest_run""")
def session_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    intents = e.where("event_type = 'view'").select((F.col("ts") + F.expr("interval 1 day")).alias("lease"))
    return C.session_snapshot(e.select(F.col("user_id").alias("agent")), intents, e.where("event_type = 'purchase'").select(F.col("event_id").alias("run_id"), "ts"), F.lit("2024-01-20").cast("timestamp"))


@query(f"""WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), c AS (SELECT node FROM d ORDER BY CASE WHEN node LIKE 'c1%' THEN 0 ELSE 9 END, degree DESC, node LIMIT 900)
SELECT src, dst, (SELECT count(*) FROM e) AS all_edges FROM e WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c) ORDER BY src, dst LIMIT 20""")
def graph_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = trade(spark, sf)
    seeds = e.where("src LIKE 'c1%'").select(F.col("src").alias("node")).union(e.where("dst LIKE 'c1%'").select("dst")).distinct().withColumn("priority", F.lit(0))
    return C.graph_sample(e, seeds, 900, 20)


@query("""WITH r AS (SELECT source AS path, lang AS reason, CASE lang WHEN 'es' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS priority FROM documents WHERE n_chars > 4000), k AS (SELECT path, reason, row_number() OVER (PARTITION BY path ORDER BY priority, reason) AS r FROM r)
SELECT path, reason, 'do_not_touch' AS list FROM k WHERE r = 1 UNION ALL SELECT source, min(lang), 'review' FROM documents WHERE source NOT IN (SELECT path FROM k) GROUP BY source""")
def change_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of long documents are not to be touched, all others to be reviewed."""
    d = read_table(spark, sf, "documents").select("n_chars", F.col("source").alias("path"), F.col("lang").alias("reason"))
    rules = d.where("n_chars > 4000").withColumn("priority", F.when(F.col("reason") == "es", 0).when(F.col("reason") == "de", 1).otherwise(2))
    return C.change_boundaries(rules, d)


@query("""SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, 'toxic' AS signal FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'poor' FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def risk_signals(spark: SparkSession, sf: str) -> DataFrame:
    path, labels = F.col("doc_id").cast("string").alias("path"), read_table(spark, sf, "labels")
    zone = read_table(spark, sf, "documents").where("lang = 'en'").select(path)
    return C.risk_signals(zone, toxic=labels.where("toxic = 1").select(path), poor=labels.where("quality = 0").select(path))


@query("""WITH o AS (SELECT o_orderpriority || o_orderstatus AS c, o_orderstatus AS s FROM orders), a AS (SELECT list(DISTINCT c) AS cycles, count(*) AS health FROM o WHERE s = 'F'), b AS (SELECT list(DISTINCT c) AS cycles, count(*) AS health FROM o)
SELECT list_sort(list_filter(b.cycles, lambda x: NOT list_contains(a.cycles, x))) AS new_cycles, b.health - a.health AS health_delta FROM a, b""")
def metrics_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The finished orders against all orders."""
    o = read_table(spark, sf, "orders")
    a, b = (o.where(w).agg(F.collect_set(F.concat("o_orderpriority", "o_orderstatus")).alias("cycles"), F.count("*").alias("health")) for w in ("o_orderstatus = 'F'", "true"))
    return C.metrics_diff(a, b, ["cycles"], ["health"])


@query("""SELECT o_orderkey AS id, o_orderdate AS updated FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'AUTO')) ORDER BY updated DESC, id LIMIT 25 OFFSET 10""")
def records_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    subjects = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("record_id"), F.col("c_mktsegment").alias("key"))
    return C.records_of(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated")), subjects, "AUTO", True, 10, 25)


@query("""SELECT DISTINCT user_id AS id FROM events WHERE (event_type = 'purchase' AND event_id % 40 = 7) OR (event_type = 'error' AND event_id % 40 = 3)""")
def trajectories_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 40).alias("key"))
    return C.with_subjects(e.select("id").distinct(), e, spark.createDataFrame([("purchase", 7), ("error", 3)], "kind string, key long"))


@query("""SELECT doc_id AS id, round(n_chars % 100 / CAST(100 AS DOUBLE) - CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 6) AS score, n_chars AS updated FROM documents ORDER BY score DESC, updated DESC, id LIMIT 40""")
def ranked_records(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100 / 100).alias("score"), F.col("n_chars").alias("updated"))
    return C.ranked_records(d, read_table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), 40)


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'draft' ELSE 'active' END AS status, ts AS updated FROM events), d AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS decision FROM events WHERE event_id % 5 = 0), j AS (SELECT r.*, decision FROM r LEFT JOIN d ON d.id = r.id AND r.status = 'draft')
SELECT id, CASE decision WHEN 'approve' THEN 'active' WHEN 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN decision IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE updated END AS updated, TRUE AS current FROM j UNION ALL SELECT id, status, updated, FALSE FROM j WHERE decision IS NOT NULL""")
def record_revisions(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    r = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "draft").otherwise("active").alias("status"), F.col("ts").alias("updated"))
    d = e.where("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "approve").otherwise("reject").alias("decision"))
    return C.revise(r, d, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY lang, doc_id) AS rank FROM documents)
SELECT id, 'lexical' AS origin, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 50 UNION ALL SELECT id, 'vector', CAST(rank AS INTEGER) FROM b WHERE rank <= 50 AND id NOT IN (SELECT id FROM a WHERE rank <= 50)""")
def hybrid_candidates(spark: SparkSession, sf: str) -> DataFrame:
    from veinstone.operators.windows import top_k

    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return C.hybrid_candidates(top_k(d, [], [F.desc("n_chars"), F.col("id")], 50), top_k(d, [], [F.col("lang"), F.col("id")], 50))


@query("""WITH p AS (SELECT DISTINCT source AS prefix FROM documents) SELECT count(*) AS prefixes, CAST(CASE WHEN count(*) < 12 THEN 3 WHEN count(*) > 60 THEN 1 ELSE 2 END AS INTEGER) AS depth FROM p""")
def module_map_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").agg(F.countDistinct("source").alias("prefixes")).withColumn("depth", C.zoom_depth(F.col("prefixes")))
