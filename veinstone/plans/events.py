"""Event queries: ``events`` by user as an audit log by workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import events as E
from veinstone.plans.registry import query
from veinstone.session import read_table

_TYPES = ["intent.declared", "intent.checked", "patch_contract.verified", "review_receipt.created", "intent.expired", "claim_validation.completed", "intent.cleared", "analysis.completed"]
_LOG = f"""log AS (SELECT 'intent:' || user_id || '-' || event_id % 7 AS workflow_id, event_id AS seq,
 CASE WHEN event_id % 97 = 0 THEN 'intent.violated' WHEN event_id % 89 = 0 THEN 'workspace.conflict_detected' ELSE {_TYPES}[event_id % 8 + 1] END AS event_type,
 CASE WHEN event_id % 8 = 2 THEN CASE WHEN user_id % 3 = 0 THEN 'accepted_with_external_changes' ELSE 'accepted' END WHEN event_id % 8 = 1 THEN 'clean' END AS status,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity, CASE WHEN event_id % 50 = 0 THEN 'hook' ELSE 'mcp' END AS surface,
 CASE WHEN event_id % 60 = 0 THEN 'manage_engineering_memory' ELSE 'check' END AS tool, props AS core, CASE WHEN event_id % 100 = 1 THEN 'bad' ELSE sha256(props) END AS core_sha, 'f' || event_id % 5 AS path FROM events)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    types = F.array(*[F.lit(t) for t in _TYPES])
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("intent:"), u.cast("string"), F.lit("-"), (i % 7).cast("string")).alias("workflow_id"), i.alias("seq"),
        F.when(i % 97 == 0, "intent.violated").when(i % 89 == 0, "workspace.conflict_detected").otherwise(F.element_at(types, (i % 8 + 1).cast("int"))).alias("event_type"),
        F.when(i % 8 == 2, F.when(u % 3 == 0, "accepted_with_external_changes").otherwise("accepted")).when(i % 8 == 1, "clean").alias("status"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info").alias("severity"),
        F.when(i % 50 == 0, "hook").otherwise("mcp").alias("surface"), F.when(i % 60 == 0, "manage_engineering_memory").otherwise("check").alias("tool"),
        F.col("props").alias("core"), F.when(i % 100 == 1, "bad").otherwise(F.sha2("props", 256)).alias("core_sha"), F.concat(F.lit("f"), (i % 5).cast("string")).alias("path"),
    )


def _quoted(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_LABELS = ", ".join(
    f"CASE WHEN {c} THEN '{k}' END"
    for k, c in {
        "change_control_workflow": f"list_has_any(types, {_quoted(E.CHANGE_CONTROL)})",
        "analysis_observed": f"NOT list_has_any(types, {_quoted(E.CHANGE_CONTROL)}) AND list_contains(types, 'analysis.completed')",
        "verified_finish": "starts_with(outcome, 'accepted') AND list_contains(types, 'patch_contract.verified')",
        "scope_clean": "clean", "hook_blocked": "hook", "memory_used": "memory", "external_changes_accepted": "list_contains(statuses, 'accepted_with_external_changes')",
        **{k: f"list_contains(types, '{t}')" for k, t in E.TYPE_LABELS.items()},
    }.items()
)
_TRAJ = f"""{_LOG}, g AS (SELECT workflow_id, list_sort(list(DISTINCT event_type)) AS types, coalesce(list(DISTINCT status) FILTER (status IS NOT NULL), []) AS statuses, count(*) AS event_count, min(seq) AS first_seq, max(seq) AS last_seq,
 bool_or(event_type = 'intent.checked' AND coalesce(status, '') IN ('clean', 'expanded')) AS clean, bool_or(surface = 'hook' AND severity IN ('warn', 'error')) AS hook, bool_or(starts_with(tool, 'manage_engineering_memory')) AS memory,
 count(*) FILTER (severity IN ('warn', 'error')) AS incidents, count(*) FILTER (sha256(core) <> core_sha) AS hash_errors FROM log GROUP BY 1),
o AS (SELECT *, CASE WHEN list_has_any(types, {_quoted(E.VIOLATED)}) THEN 'violated' WHEN list_contains(types, 'patch_contract.verified') AND list_contains(statuses, 'accepted_with_external_changes') THEN 'accepted_with_external_changes'
 WHEN list_contains(types, 'patch_contract.verified') AND list_contains(statuses, 'accepted') THEN 'accepted' WHEN list_has_any(types, {_quoted(E.EXPIRED)}) THEN 'abandoned' WHEN list_has_any(types, {_quoted(E.BLOCKED)}) THEN 'blocked' ELSE 'partial' END AS outcome FROM g),
l AS (SELECT *, list_sort(list_filter([{_LABELS}], lambda x: x IS NOT NULL)) AS labels FROM o),
t AS (SELECT workflow_id, types, event_count, first_seq, last_seq, incidents, hash_errors, outcome, labels, CASE WHEN outcome = 'violated' OR list_has_any(labels, ['baseline_abuse_detected', 'claim_guard_failed', 'hook_blocked']) THEN 'incident' WHEN outcome = 'partial' THEN 'partial'
 WHEN starts_with(outcome, 'accepted') THEN CASE WHEN list_has_any(types, ['patch_contract.violated', 'intent.violated']) THEN 'corrected' ELSE 'verified' END ELSE 'routine' END AS tier FROM l)"""


@query(f"WITH {_TRAJ} SELECT * FROM t")
def workflow_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    return E.trajectories(log(spark, sf))


_ANOM = """a AS (SELECT *, list_filter([CASE WHEN outcome = 'violated' THEN {'kind': 'outcome_violated', 'severity': 'error'} END, CASE WHEN outcome = 'blocked' THEN {'kind': 'outcome_blocked', 'severity': 'error'} END,
 CASE WHEN outcome = 'abandoned' THEN {'kind': 'outcome_abandoned', 'severity': 'warn'} END, CASE WHEN tier = 'incident' THEN {'kind': 'quality_incident', 'severity': 'error'} END, CASE WHEN incidents >= 3 THEN {'kind': 'elevated_incidents', 'severity': 'warn'} END,
 CASE WHEN list_contains(labels, 'foreign_conflict_seen') THEN {'kind': 'label_foreign_conflict_seen', 'severity': 'warn'} END, CASE WHEN list_contains(labels, 'hook_blocked') THEN {'kind': 'label_hook_blocked', 'severity': 'warn'} END,
 CASE WHEN list_contains(labels, 'change_control_workflow') AND NOT list_contains(labels, 'verified_finish') AND NOT starts_with(outcome, 'accepted') THEN {'kind': 'incomplete_change_cycle', 'severity': 'warn'} END,
 CASE WHEN NOT list_contains(types, 'intent.cleared') AND list_contains(types, 'patch_contract.verified') THEN {'kind': 'missing_intent_clear', 'severity': 'warn'} END], lambda x: x IS NOT NULL) AS anomalies FROM t)"""
_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.OUTCOME_SCORES.items())
_TIERS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.TIER_SCORES.items())


@query(f"""WITH {_TRAJ}, {_ANOM} SELECT workflow_id, outcome, tier, CAST(least(CASE outcome {_CASES} END, CASE tier {_TIERS} END, greatest(0, 100 - incidents * 10), greatest(0, 100 - coalesce(list_sum(list_transform(anomalies, lambda x: CASE WHEN x.severity = 'error' THEN 12 ELSE 5 END)), 0)),
 CASE WHEN list_contains(labels, 'change_control_workflow') AND NOT list_contains(labels, 'receipt_issued') THEN 85 ELSE 100 END) AS INTEGER) AS quality_score FROM a""")
def trajectory_quality(spark: SparkSession, sf: str) -> DataFrame:
    return E.quality(E.trajectories(log(spark, sf))).select("workflow_id", "outcome", "tier", "quality_score")


@query(f"WITH {_TRAJ}, {_ANOM}, x AS (SELECT unnest(anomalies) AS z FROM a) SELECT z.kind AS kind, z.severity AS severity, count(*) AS n FROM x GROUP BY 1, 2")
def anomaly_summary(spark: SparkSession, sf: str) -> DataFrame:
    from veinstone.operators.metrics import anomaly_summary as summary

    return summary(E.quality(E.trajectories(log(spark, sf))))


@query(f"WITH {_TRAJ}, {_ANOM} SELECT 'agent' || length(workflow_id) AS agent, count(*) AS trajectories, count(DISTINCT split_part(workflow_id, '-', 1)) AS intents, count(*) FILTER (outcome = 'violated') AS failed, CAST(sum(incidents) AS BIGINT) AS incidents, CAST(sum(len(anomalies)) AS BIGINT) AS anomalies FROM a GROUP BY 1")
def agent_rows(spark: SparkSession, sf: str) -> DataFrame:
    from veinstone.operators.metrics import agent_rows as rows

    t = E.quality(E.trajectories(log(spark, sf)))
    return rows(t.withColumn("agent", F.concat(F.lit("agent"), F.length("workflow_id").cast("string"))).withColumn("intent", F.substring_index("workflow_id", "-", 1)))


@query("""WITH w AS (SELECT DISTINCT user_id FROM events WHERE event_id > (SELECT max(event_id) - 40 FROM events)) SELECT user_id, count(*) AS events FROM events WHERE user_id IN (SELECT user_id FROM w) GROUP BY 1""")
def incremental_rebuild_scope(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("workflow_id"))
    top = e.agg(F.max("seq")).collect()[0][0] or 0
    return E.changed_workflows(e, top - 40).groupBy(F.col("workflow_id").alias("user_id")).agg(F.count("*").alias("events"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def canonical_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return E.keep_latest(read_table(spark, sf, "events"), "user_id", [rank, F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"""WITH {_LOG}, g AS (SELECT workflow_id, coalesce(list(DISTINCT path) FILTER (event_type IN ('intent.declared', 'intent.expanded')), []) AS d, coalesce(list(DISTINCT path) FILTER (event_type = 'intent.checked'), []) AS c,
 coalesce(arg_max(coalesce(status, 'unverified'), seq) FILTER (event_type = 'patch_contract.verified'), 'not_reached') AS verify FROM log GROUP BY 1)
SELECT workflow_id, list_sort(list_intersect(d, c)) AS in_scope, list_sort(list_filter(c, lambda x: NOT list_contains(d, x))) AS unexpected, list_sort(list_filter(d, lambda x: NOT list_contains(c, x))) AS untouched, verify,
 CASE WHEN len(list_filter(c, lambda x: NOT list_contains(d, x))) > 0 THEN 'violated' ELSE 'clean' END AS scope_status, sha256(array_to_string(list_sort(d), ',') || '|' || array_to_string(list_sort(c), ',') || '|' || verify) AS digest FROM g""")
def patch_trails(spark: SparkSession, sf: str) -> DataFrame:
    return E.patch_trails(log(spark, sf))


@query("""WITH r AS (SELECT doc_id AS key, source AS path, lang AS fingerprint, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'active' END AS status FROM documents), b AS (SELECT doc_id AS key, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE lang END AS f FROM documents WHERE doc_id % 5 <> 0)
SELECT r.key, status AS before, CASE WHEN path >= 'src3' OR f <> fingerprint THEN 'stale' WHEN b.key IS NULL THEN 'historical' ELSE 'active' END AS after, CASE WHEN path >= 'src3' THEN 'file_missing' WHEN f <> fingerprint THEN 'fingerprint_changed' ELSE '' END AS reason FROM r LEFT JOIN b ON b.key = r.key""")
def refresh_staleness(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("key"), F.col("source").alias("path"), F.col("lang").alias("fingerprint"), F.when(F.col("doc_id") % 4 == 0, "stale").otherwise("active").alias("status"))
    b = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("lang")).alias("fingerprint"))
    return E.staleness(r, b, d.where("source < 'src3'").select(F.col("source").alias("path")))


@query("""SELECT event_id FROM events WHERE NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-25' OR event_type = 'error' AND ts < TIMESTAMP '2024-01-10')""")
def memory_vacuum(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("updated"))
    return E.vacuum(e, F.lit("2024-01-30").cast("timestamp"), {"view": 5, "error": 20}).select("event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def distinct_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_per_key(read_table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, value <= 1 OR user_id % 10 = 0 OR event_id % 13 = 0 OR event_id % 100 >= 90 OR TIMESTAMP '2024-01-15' >= ts + to_seconds(greatest(1, CAST(floor(value) AS INTEGER))) AS due FROM events""")
def flush_decisions(spark: SparkSession, sf: str) -> DataFrame:
    window = F.when(F.col("value") <= 1, 0).otherwise(F.floor("value")).cast("int")
    last = F.when(F.col("event_id") % 13 != 0, F.col("ts").cast("timestamp"))
    due = E.flush_due(window, F.col("user_id") % 10 == 0, last, F.col("event_id") % 100, 90, F.lit("2024-01-15").cast("timestamp"))
    return read_table(spark, sf, "events").select("event_id", due.alias("due"))


@query("""WITH a AS (SELECT doc_id, lang AS d FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS d FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.d = b.d THEN 'keep' ELSE 'replace' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def replace_experiences(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    new = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "new").otherwise(F.col("lang")).alias("d"))
    return E.diff_rows(d.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("d")), new, "doc_id", "d")


@query("""WITH s AS (SELECT DISTINCT doc_id AS path FROM documents) SELECT count(*) AS paths, round_even(count(*) FILTER (path IN (SELECT doc_id FROM labels)) * 100.0 / count(*), 2) AS records, round_even(count(*) FILTER (path IN (SELECT event_id FROM events WHERE event_id % 3 = 0)) * 100.0 / count(*), 2) AS trajectories FROM s""")
def context_coverage(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("doc_id").alias("path")
    e = read_table(spark, sf, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("path"))
    return E.context_coverage(read_table(spark, sf, "documents").select(path), records=read_table(spark, sf, "labels").select(path), trajectories=e)


@query("""WITH RECURSIVE o AS (SELECT lang, doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY lang ORDER BY CAST(ceil(n_chars / 4.0) AS BIGINT), doc_id) AS r FROM documents),
b AS (SELECT lang, doc_id, tokens, r, 0 AS batch, 1 AS n FROM o WHERE r = 1 UNION ALL
 SELECT o.lang, o.doc_id, o.tokens, o.r, CASE WHEN b.n + 1 > 32 OR (b.n + 1) * o.tokens > 8000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n + 1 > 32 OR (b.n + 1) * o.tokens > 8000 THEN 1 ELSE b.n + 1 END FROM b JOIN o ON o.lang = b.lang AND o.r = b.r + 1)
SELECT lang, doc_id, tokens, CAST(batch AS INTEGER) AS batch FROM b""")
def adaptive_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("lang", "doc_id", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return E.adaptive_batches(d, "lang", "doc_id", "tokens", 32, 8000)


@query("""WITH RECURSIVE o AS (SELECT source, n_chars AS z, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, r, CASE WHEN z <= 9000 AND z <= 40000 THEN z ELSE 0 END AS used, CASE WHEN z <= 9000 THEN 1 ELSE 0 END AS kept, CASE WHEN z > 9000 THEN 1 ELSE 0 END AS truncated, 0 AS skipped FROM o WHERE r = 1 UNION ALL
 SELECT o.source, o.r, CASE WHEN z <= 9000 AND used + z <= 40000 THEN used + z ELSE used END, kept + CASE WHEN z <= 9000 AND used + z <= 40000 THEN 1 ELSE 0 END, truncated + CASE WHEN z > 9000 THEN 1 ELSE 0 END, skipped + CASE WHEN z <= 9000 AND used + z > 40000 THEN 1 ELSE 0 END FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
SELECT source, CAST(arg_max(used, r) AS BIGINT) AS used, CAST(arg_max(kept, r) AS BIGINT) AS kept, CAST(arg_max(truncated, r) AS BIGINT) AS truncated, CAST(arg_max(skipped, r) AS BIGINT) AS skipped FROM f GROUP BY 1""")
def export_shards(spark: SparkSession, sf: str) -> DataFrame:
    return E.export_lines(read_table(spark, sf, "documents"), "source", ["doc_id"], "n_chars", 40000, 9000)
