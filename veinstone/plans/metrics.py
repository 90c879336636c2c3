"""Metric queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import metrics as M
from veinstone.plans.registry import query
from veinstone.session import read_table


@query("""WITH u AS (SELECT o_custkey, CAST(count(*) AS INTEGER) AS cc FROM orders GROUP BY 1)
SELECT round_even(avg(greatest(1, cc)), 4) AS average, max(greatest(1, cc)) AS maximum, coalesce(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR)) FILTER (greatest(1, cc) > 20)), []) AS high_risk FROM u""")
def complexity_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("qualname")).agg(F.count("*").cast("int").alias("cc"))
    return M.complexity_summary(u)


@query("""WITH c AS (SELECT l_suppkey, count(DISTINCT l_partkey) % 14 AS cbo, count(DISTINCT l_returnflag || l_linestatus) AS lcom4 FROM lineitem GROUP BY 1)
SELECT round_even(avg(cbo), 4) AS cbo_average, max(cbo) AS cbo_maximum, count(*) FILTER (cbo > 10) AS cbo_high, round_even(avg(lcom4), 4) AS lcom4_average, max(lcom4) AS lcom4_maximum, count(*) FILTER (lcom4 > 3) AS lcom4_high FROM c""")
def class_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.countDistinct("l_partkey") % 14).alias("cbo"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("lcom4"))
    return M.class_summary(c)


_CURVE = "CASE WHEN d <= 0.05 THEN 100.0 - d / 0.05 * 10 WHEN d <= 0.2 THEN 90.0 - (d - 0.05) / 0.15 * 40 WHEN d <= 0.5 THEN 50.0 - (d - 0.2) / 0.3 * 50 ELSE 0 END"


@query(f"""WITH x AS (SELECT l_suppkey AS unit, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS d, CAST(sum(CAST(l_quantity AS INTEGER)) % 101 AS DOUBLE) AS q FROM lineitem GROUP BY 1),
y AS (SELECT unit, CAST({_CURVE} AS DOUBLE) AS clones, q FROM x),
z AS (SELECT unit, clones, CAST(greatest(0, least(100, CAST(round_even(clones * CAST(0.25 AS DOUBLE) + q * CAST(0.2 AS DOUBLE) + q * CAST(0.1 AS DOUBLE) + q * CAST(0.15 AS DOUBLE) + q * CAST(0.1 AS DOUBLE) + q * CAST(0.1 AS DOUBLE) + q * CAST(0.1 AS DOUBLE), 0) AS INTEGER))) AS INTEGER) AS score FROM y)
SELECT unit, round(clones, 6) AS clones, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM z""")
def health_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(
        (F.count_if(F.col("l_returnflag") == "R").cast("double") / F.count("*")).alias("d"), (F.sum(F.col("l_quantity").cast("int")) % 101).cast("double").alias("q")
    )
    dims = li.select("unit", S.clone_density_score(F.col("d")).alias("clones"), *[F.col("q").alias(c) for c in list(M.HEALTH_WEIGHTS)[1:]])
    return M.health(dims).select("unit", F.round("clones", 6).alias("clones"), "score", "grade")


def _mid(c: str) -> str:
    return f"CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE round_even((2 * (rank() OVER (ORDER BY {c}) - 1) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0 / (count(*) OVER () - 1), 4) END AS m_{c}"


@query(f"""WITH s AS (SELECT l_suppkey AS module, count(*) AS loc, CAST(sum(l_quantity) AS BIGINT) AS callables, count(DISTINCT l_partkey) AS fan_in, count(DISTINCT l_orderkey) AS fan_out FROM lineitem GROUP BY 1),
m AS (SELECT module, {_mid('loc')}, {_mid('callables')}, {_mid('fan_in')}, {_mid('fan_out')} FROM s),
t AS (SELECT module, round_even((round_even(m_loc * 10000, 0) + round_even(m_callables * 10000, 0)) / CAST(2 AS DOUBLE), 0) AS s, round_even((round_even(m_fan_in * 10000, 0) + round_even(m_fan_out * 10000, 0)) / CAST(2 AS DOUBLE), 0) AS l FROM m),
u AS (SELECT module, s / CAST(10000 AS DOUBLE) AS size_score, l / CAST(10000 AS DOUBLE) AS link_score, round_even((s + l) / CAST(2 AS DOUBLE), 0) / CAST(10000 AS DOUBLE) AS score FROM t),
c AS (SELECT least(1.0, greatest(quantile_cont(score, 0.9), quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)))) AS cutoff FROM u)
SELECT module, size_score, link_score, score, score >= cutoff AS candidate FROM u, c""")
def overloaded_modules(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(
        F.count("*").alias("loc"), F.sum("l_quantity").cast("long").alias("callables"), F.countDistinct("l_partkey").alias("fan_in"), F.countDistinct("l_orderkey").alias("fan_out")
    )
    return M.overloaded(s, "module", ["loc", "callables"], ["fan_in", "fan_out"])


@query("""WITH i AS (SELECT doc_id // 3 AS finding_id, lang AS family, source AS directory, source || doc_id % 7 AS path FROM documents),
r AS (SELECT *, unnest(['all', family]) AS bucket FROM i),
g AS (SELECT bucket, directory, count(DISTINCT finding_id) AS findings, count(*) AS items, count(DISTINCT path) AS files FROM r GROUP BY 1, 2),
s AS (SELECT *, round_even(items * 100.0 / sum(items) OVER (PARTITION BY bucket), 2) AS share, CAST(row_number() OVER (PARTITION BY bucket ORDER BY items DESC, findings DESC, directory) AS INTEGER) AS rank FROM g)
SELECT * FROM s WHERE rank <= 5""")
def directory_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return M.directory_hotspots(d.select(F.floor(F.col("doc_id") / 3).alias("finding_id"), F.col("lang").alias("family"), F.col("source").alias("directory"), F.concat("source", (F.col("doc_id") % 7).cast("string")).alias("path")))


@query("""WITH i AS (SELECT source AS g, CASE WHEN doc_id % 5 = 0 THEN 'tests/fixtures/a' WHEN lang = 'fr' THEN 'pkg/tests/b' WHEN lang = 'es' THEN '' ELSE 'pkg/c' END AS path FROM documents),
k AS (SELECT g, CASE WHEN path = '' THEN 'other' WHEN regexp_matches(path, '(^|/)tests/fixtures(/|$)') THEN 'fixtures' WHEN regexp_matches(path, '(^|/)tests(/|$)') THEN 'tests' ELSE 'production' END AS kind FROM i),
c AS (SELECT g, count(*) FILTER (kind = 'production') AS production, count(*) FILTER (kind = 'tests') AS tests, count(*) FILTER (kind = 'fixtures') AS fixtures, count(*) FILTER (kind = 'other') AS other, count(DISTINCT kind) AS n, min(kind) AS one FROM k GROUP BY g)
SELECT g, production, tests, fixtures, other, CASE WHEN n > 1 THEN 'mixed' ELSE one END AS dominant, CASE WHEN production > 0 AND n = 1 THEN 'runtime' WHEN production = 0 THEN 'non_runtime' ELSE 'mixed' END AS impact_scope FROM c""")
def source_scopes(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 5 == 0, "tests/fixtures/a").when(F.col("lang") == "fr", "pkg/tests/b").when(F.col("lang") == "es", "").otherwise("pkg/c")
    return M.source_scope(d.select(F.col("source").alias("g"), S.source_kind(path).alias("kind")), "g", "kind")


@query("""SELECT lang AS g, count(DISTINCT source) AS files, count(DISTINCT source || doc_id % 9) AS functions,
  list_sort(list(DISTINCT source || ':' || lpad(CAST(doc_id AS VARCHAR), 6, '0')))[1:3] AS locations FROM documents GROUP BY 1""")
def representative_locations(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return M.group_locations(d.select(F.col("lang").alias("g"), F.col("source").alias("path"), F.concat("source", (F.col("doc_id") % 9).cast("string")).alias("qualname"), F.col("doc_id").alias("line")), "g")


_AUDIT = """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'intent.declared' WHEN 'click' THEN 'intent.closed' WHEN 'purchase' THEN 'patch.accepted' WHEN 'error' THEN 'patch.violated' ELSE 'run.finished' END AS event_type,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS severity, ts FROM events"""


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    e, t = read_table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t == "view", "intent.declared").when(t == "click", "intent.closed").when(t == "purchase", "patch.accepted").when(t == "error", "patch.violated").otherwise("run.finished")
    return e.select(F.col("event_id").alias("id"), kind.alias("event_type"), F.when(t == "error", "error").when(F.col("value") > 50, "warning").otherwise("info").alias("severity"), "ts")


@query(f"""SELECT count(*) AS total, count(*) FILTER (event_type LIKE 'intent.%') AS intents, count(*) FILTER (event_type IN ('patch.accepted', 'patch.violated')) AS patches,
 count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(id, (ts, id)) AS last_id FROM ({_AUDIT})""")
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.audit_summary(audit_events(spark, sf))


@query("""SELECT event_type, count(*) AS n, CAST(sum(b) AS BIGINT) AS total, max(b) AS largest, CAST(floor(sum(b) / count(*)) AS BIGINT) AS average, list_reverse_sort(list(b))[count(*) * 5 // 100 + 1] AS p95
FROM (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS b FROM events) GROUP BY 1""")
def payload_footprint(spark: SparkSession, sf: str) -> DataFrame:
    return M.payload_footprint(read_table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 10).alias("b")), "event_type", "b")


@query("""SELECT CASE WHEN event_type = 'view' THEN 'intent' WHEN value > 20 THEN 'run' ELSE 'event' END AS kind,
 CASE WHEN event_type = 'view' THEN 'i' || user_id WHEN value > 20 THEN 'r' || user_id % 10 ELSE CAST(event_id AS VARCHAR) END AS id, count(*) AS total FROM events GROUP BY 1, 2 ORDER BY total DESC, kind, id LIMIT 5""")
def top_workflows(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", F.concat(F.lit("i"), F.col("user_id").cast("string"))).alias("intent_id"), F.when(F.col("value") > 20, F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string"))).alias("run_id"))
    return M.top_workflows(rows)


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0 OR user_id % 13 = 0) AS gaps FROM events")
def audit_core_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return M.core_gaps(e.select(F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("core_json"), F.when(F.col("event_id") % 11 != 0, F.lit("x")).alias("core_sha"), F.when(F.col("user_id") % 13 != 0, F.lit("w")).alias("workflow_id")))


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INTEGER) + 1] AS p95 FROM events GROUP BY 1""")
def tool_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return M.tool_aggregates(read_table(spark, sf, "events"), "event_type", "value")


@query("""WITH g AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'surface' WHEN event_type = 'purchase' THEN 'memory' ELSE 'audit' END AS subsystem, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1),
s AS (SELECT *, CAST(round_even(total * 1000.0 / sum(total) OVER (), 0) AS INTEGER) AS share FROM g) SELECT subsystem, total, share, share >= 250 AS heavy FROM s""")
def pipeline_shares(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    sub = F.when(t.isin("view", "click"), "surface").when(t == "purchase", "memory").otherwise("audit")
    return M.shares(read_table(spark, sf, "events").select(sub.alias("subsystem"), F.floor(F.col("value") * 100).alias("v")), "subsystem", "v")


@query("""SELECT event_type, 'k' AS counter, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, max(CAST(props->>'k' AS BIGINT)) AS largest FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1""")
def span_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("counters"))
    return M.counter_costs(e, "event_type", "counters")


@query("""(SELECT 'slowest' AS list, event_id AS id, value FROM events ORDER BY value DESC, event_id LIMIT 5) UNION ALL (SELECT 'largest', event_id, CAST(CAST(props->>'k' AS BIGINT) AS DOUBLE) FROM events ORDER BY CAST(props->>'k' AS BIGINT) DESC NULLS LAST, event_id LIMIT 5)""")
def trace_extremes(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("long").alias("bytes"))
    return M.extremes(e)


@query("""SELECT 'noop_span' AS kind, CAST(event_id AS VARCHAR) AS subject, value AS cost FROM events WHERE event_type = 'error' AND value >= 50
UNION ALL SELECT 'heavy_payload', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY event_type HAVING count(*) > 1500""")
def trace_waste(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    spans = e.select(F.when(F.col("event_type") == "error", "noop").alias("reason"), F.col("value").alias("duration"), F.col("event_id").cast("string").alias("name"))
    tools = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("cost")).withColumn("heavy", F.col("cost") > 1500)
    return M.waste(spans, tools)


_TRAJ = """SELECT user_id * 31 + event_id % 31 AS id, ['f' || user_id % 5] AS families, [CASE WHEN value > 10 THEN 's_loop' ELSE 'plain' END, event_type] AS signals, CASE WHEN event_id % 4 = 0 THEN 'violated' ELSE 'accepted' END AS outcome, 'a' || user_id % 3 AS agent, ts AS finished FROM events"""


@query(f"""WITH t AS ({_TRAJ}), r AS (SELECT id, outcome, agent, finished, unnest(families) AS family, signals FROM t), x AS (SELECT id, outcome, agent, finished, family, unnest(signals) AS signal FROM r),
g AS (SELECT family, signal, outcome, count(DISTINCT id) AS support, count(DISTINCT agent) AS agents, list_transform(list_sort(list(DISTINCT (finished, id))), lambda z: z[2])[1:20] AS evidence FROM x GROUP BY 1, 2, 3),
v AS (SELECT *, least(100, CASE WHEN agents >= 2 THEN 60 ELSE 0 END + CASE WHEN starts_with(signal, 's') THEN 25 ELSE 0 END) AS information FROM g) SELECT * FROM v WHERE support >= 5 AND information >= 50""")
def experience_distillation(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    t = e.select(
        (F.col("user_id") * 31 + F.col("event_id") % 31).alias("id"), F.array(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"))).alias("families"),
        F.array(F.when(F.col("value") > 10, "s_loop").otherwise("plain"), "event_type").alias("signals"), F.when(F.col("event_id") % 4 == 0, "violated").otherwise("accepted").alias("outcome"),
        F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("agent"), F.col("ts").alias("finished"),
    )
    return M.experiences(t)


@query("""SELECT count(*) FILTER (label >= 0) AS clusters, round_even(sum(CASE WHEN label < 0 THEN n ELSE 0 END) / sum(n), 4) AS noise_ratio, round_even(max(CASE WHEN label >= 0 THEN n END) / sum(n), 4) AS dominant_ratio, max(n) AS largest
FROM (SELECT label - 1 AS label, count(*) AS n FROM embeddings GROUP BY 1)""")
def partition_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.partition_metrics(read_table(spark, sf, "embeddings").select((F.col("label") - 1).alias("label")), "label")


@query("""WITH g AS (SELECT props->>'k' AS value, count(*) AS n FROM events GROUP BY 1) SELECT value, n, round_even(n / sum(n) OVER (), 4) AS rate FROM g""")
def metadata_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return M.metadata_distribution(read_table(spark, sf, "events"), "props", "k")


@query("""SELECT min(value) AS low, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS high, round(avg(value), 6) AS mean, count(*) FILTER (value = 0) AS zeros FROM events""")
def numeric_field_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.numeric_summary(read_table(spark, sf, "events"), "value")


def _floor(q: float) -> str:
    return f"list_sort(list(v))[CAST(floor({q} * (count(*) - 1)) AS INTEGER) + 1]"


@query(f"""SELECT lang, {_floor(0.0)} AS shortest, {_floor(0.5)} AS p50, {_floor(0.75)} AS p75, {_floor(0.95)} AS p95, {_floor(0.99)} AS p99, {_floor(1.0)} AS longest, count(*) FILTER (v > 512) AS overflow, max(greatest(0, v - 512)) AS most_over
FROM (SELECT lang, CAST(ceil(length(text) / 4.0) AS BIGINT) AS v FROM documents) GROUP BY 1""")
def length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("lang", S.token_estimate(F.col("text")).cast("long").alias("v"))
    return M.length_distribution(d, "v", "lang", 512)


@query("SELECT lang AS type, source AS status, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def record_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.status_counts(read_table(spark, sf, "documents").select(F.col("lang").alias("type"), F.col("source").alias("status")))
