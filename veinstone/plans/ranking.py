"""Findings, search and gate queries over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.functions import scalars as S
from veinstone.operators import gates as G
from veinstone.operators import ranking as R
from veinstone.operators.textindex import TextIndex
from veinstone.plans.registry import query
from veinstone.session import read_table, shared_folder

_FIND = """f AS (SELECT doc_id AS id, ['critical', 'warning', 'info', 'odd'][doc_id % 4 + 1] AS severity, ['easy', 'moderate', 'hard'][doc_id % 3 + 1] AS effort, CASE WHEN doc_id % 5 = 0 THEN 'known' ELSE 'new' END AS novelty,
 ['production', 'mixed', 'tests', 'fixtures', 'other'][doc_id % 5 + 1] AS kind, ['high', 'medium', 'low'][doc_id % 3 + 1] AS confidence, n_chars % 40 AS spread, lang AS family FROM documents)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")

    def pick(values: list[str], n: int):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))

    return read_table(spark, sf, "documents").select(
        i.alias("id"), pick(["critical", "warning", "info", "odd"], 4).alias("severity"), pick(["easy", "moderate", "hard"], 3).alias("effort"),
        F.when(i % 5 == 0, "known").otherwise("new").alias("novelty"), pick(["production", "mixed", "tests", "fixtures", "other"], 5).alias("kind"),
        pick(["high", "medium", "low"], 3).alias("confidence"), (F.col("n_chars") % 40).alias("spread"), F.col("lang").alias("family"),
    )


def _case(name: str) -> str:
    values, last = R.WEIGHTS[name]
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + f" ELSE CAST({last} AS DOUBLE) END"


_PRIO = f"{_FIND}, p AS (SELECT *, round(pow(CASE WHEN max(spread) OVER () <= 0 THEN 0.3 ELSE greatest(CAST(0.2 AS DOUBLE), least(CAST(1.0 AS DOUBLE), spread / max(spread) OVER ())) END * {' * '.join(_case(n) for n in R.WEIGHTS)}, 1.0 / 6), 4) AS score FROM f)"


@query(f"WITH {_PRIO} SELECT id, score FROM p")
def finding_priority(spark: SparkSession, sf: str) -> DataFrame:
    return R.prioritised(findings(spark, sf)).select("id", "score")


@query(f"WITH {_PRIO} SELECT id, score, count(*) OVER () AS total FROM p WHERE family = 'en' AND novelty = 'new' ORDER BY score DESC, id LIMIT 20 OFFSET 10")
def findings_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.findings_page(R.prioritised(findings(spark, sf)), 10, 20, family="en", novelty="new").select("id", "score", "total")


@query(f"""WITH {_PRIO}, r AS (SELECT 'most_actionable' AS list, row_number() OVER (ORDER BY score DESC, id) AS rank, id, score FROM p UNION ALL SELECT 'production', row_number() OVER (ORDER BY score DESC, id), id, score FROM p WHERE kind = 'production'
 UNION ALL SELECT 'highest_spread', row_number() OVER (ORDER BY spread DESC, score DESC, id), id, score FROM p WHERE spread > 0) SELECT list, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 5""")
def hotspot_lists(spark: SparkSession, sf: str) -> DataFrame:
    return R.hotspot_lists(R.prioritised(findings(spark, sf)), 5)


@query(f"""WITH {_PRIO}, x AS (SELECT *, row_number() OVER (PARTITION BY severity, kind ORDER BY score DESC, id) = 1 AS lead FROM p) SELECT id, severity, kind, score FROM x ORDER BY lead DESC, score DESC, id LIMIT 30""")
def diverse_top(spark: SparkSession, sf: str) -> DataFrame:
    return R.diverse(R.prioritised(findings(spark, sf)), ["severity", "kind"], [F.desc("score"), F.asc("id")], 30).select("id", "severity", "kind", "score")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS r FROM documents)
SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, round(coalesce(1.0 / (60.0 + x.r), 0) + coalesce(1.0 / (60.0 + y.r), 0), 9) AS score FROM (SELECT * FROM a WHERE r < 200) x FULL JOIN (SELECT * FROM b WHERE r < 200) y ON x.doc_id = y.doc_id""")
def reciprocal_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    from veinstone.operators.windows import top_k

    d = read_table(spark, sf, "documents")
    a = top_k(d, [], [F.desc("n_chars"), F.col("doc_id")], 200).withColumn("rank", F.col("rank") - 1)
    b = top_k(d, [], [F.col("lang"), F.col("doc_id")], 200).withColumn("rank", F.col("rank") - 1)
    return R.rrf(a, b, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


_TOK = "list_filter(string_split_regex(lower(coalesce({t}, '')), '[^a-z0-9À-ɏ]+'), lambda x: x <> '')"


@query(f"""WITH q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format(t='text')}) AS token FROM benchmark WHERE item_id % 100 = 0),
t AS (SELECT doc_id, unnest({_TOK.format(t='text')}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT doc_id, len({_TOK.format(t='text')}) AS len FROM documents),
n AS (SELECT count(*) AS n, avg(len) AS al FROM s), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)
SELECT qid, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN df USING (token) JOIN tf USING (token) JOIN s USING (doc_id), n GROUP BY 1, 2""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark").where("item_id % 100 = 0")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9À-ɏ]+"), lambda t: t != "")
    q = b.select(F.col("item_id").alias("qid"), F.explode(words).alias("token"))
    return R.bm25(read_table(spark, sf, "documents"), "doc_id", F.col("text"), q).select("qid", "doc_id", F.round("score", 6).alias("score"))


_INDEXED = f"""WITH q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK.format(t='text')}) AS token FROM benchmark),
d AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, unnest({_TOK.format(t='text')}) AS token FROM d), tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT doc_id, len({_TOK.format(t='text')}) AS len FROM d),
n AS (SELECT count(*) AS n, avg(len) AS al FROM s), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT qid, doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM q JOIN df USING (token) JOIN tf USING (token) JOIN s USING (doc_id), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS k FROM x)
SELECT qid, doc_id, round(score, 6) AS score FROM r WHERE k <= 10"""


@query(_INDEXED)
def stored_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every benchmark item, from an index that was built in two steps:
    a first version of every document (its language), then the texts in their place."""
    d = read_table(spark, sf, "documents")
    index = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.add(d, "doc_id", "lang")
    index.add(d, "doc_id", "text")
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(R.text_tokens(F.col("text"))).alias("token"))
    return index.search(q, 10).select("qid", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT doc_id AS id, ['contract_note', 'risk_note', 'module_role', 'x'][doc_id % 4 + 1] AS type, ['git', 'doc', 'analysis'][doc_id % 3 + 1] AS ingest, ['verified', 'supported', 'low'][doc_id % 3 + 1] AS confidence, doc_id % 2 AS ap, doc_id % 8 AS ev, ['draft', 'stale', 'active'][doc_id % 3 + 1] AS status, (doc_id % 10) / 10.0 AS prox,
 CASE WHEN source = 'src1' THEN 1.0 WHEN starts_with(source, 'src1/') OR starts_with('src1/a', source || '/') THEN 0.8 ELSE 0 END AS scope FROM documents)
SELECT id, CASE WHEN scope <= 0 THEN 0 ELSE round(scope + CASE type WHEN 'contract_note' THEN 0.25 WHEN 'risk_note' THEN 0.15 WHEN 'module_role' THEN 0.1 ELSE 0 END + CASE ingest WHEN 'git' THEN 0.1 WHEN 'doc' THEN 0.06 ELSE 0.04 END + CASE confidence WHEN 'verified' THEN 0.15 WHEN 'supported' THEN 0.1 ELSE 0 END
 + ap * 0.1 + least(0.1, ev * 0.02) + CASE status WHEN 'draft' THEN 0.35 WHEN 'stale' THEN -0.5 ELSE 0 END + prox * 0.3, 4) END AS score FROM r""")
def record_relevance(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")

    def pick(values: list[str], n: int):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))

    d = read_table(spark, sf, "documents").select(
        i.alias("id"), pick(["contract_note", "risk_note", "module_role", "x"], 4).alias("type"), pick(["git", "doc", "analysis"], 3).alias("ingest"), pick(["verified", "supported", "low"], 3).alias("confidence"),
        (i % 2 == 1).alias("approved"), (i % 8).alias("evidence"), pick(["draft", "stale", "active"], 3).alias("status"), F.lit("agent").alias("origin"), ((i % 10) / 10).alias("proximity"), S.scope_match(F.col("source"), F.lit("src1")).alias("scope"),
    )
    return d.select("id", R.relevance(F.col("scope"), True).alias("score"))


@query("""WITH m AS (SELECT 'complexity' AS family, CAST(o_custkey AS VARCHAR) AS subject, count(*) * 3 AS value, 'high' AS confidence FROM orders GROUP BY o_custkey UNION ALL SELECT 'coupling', CAST(l_suppkey AS VARCHAR), count(DISTINCT l_partkey) % 20, 'low' FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'dead_code', p_name || p_partkey, 1, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END FROM part),
s AS (SELECT family || '_suggestion' AS kind, subject, value, CASE family WHEN 'complexity' THEN CASE WHEN value > 40 THEN 'critical' WHEN value > 20 THEN 'warning' END WHEN 'coupling' THEN CASE WHEN value > 10 THEN 'warning' END ELSE CASE WHEN confidence = 'high' THEN 'warning' END END AS severity,
 CASE family WHEN 'coupling' THEN 'hard' WHEN 'dead_code' THEN 'easy' ELSE 'moderate' END AS effort FROM m)
SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, CASE effort WHEN 'easy' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, value DESC, kind, subject) AS INTEGER) AS rank FROM s WHERE severity IS NOT NULL""")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    o, li, p = (read_table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    a = o.groupBy("o_custkey").agg((F.count("*") * 3).alias("value")).select(F.lit("complexity").alias("family"), F.col("o_custkey").cast("string").alias("subject"), "value", F.lit("high").alias("confidence"))
    b = li.groupBy("l_suppkey").agg((F.countDistinct("l_partkey") % 20).alias("value")).select(F.lit("coupling"), F.col("l_suppkey").cast("string"), "value", F.lit("low"))
    c = p.select(F.lit("dead_code"), F.concat("p_name", F.col("p_partkey").cast("string")), F.lit(1).cast("long"), F.when(F.col("p_size") > 25, "high").otherwise("medium"))
    return R.suggestions(a.union(b).union(c))


@query("""WITH s AS (SELECT l_suppkey AS id, count(*) % 50 AS complexity_max, count(DISTINCT l_partkey) % 15 AS coupling_max, count(*) % 101 AS health_score, count(*) FILTER (l_returnflag = 'R') % 3 AS dependency_cycles, count(*) % 7 - 3 AS health_delta, count(*) % 4 AS clone_new_count, count(*) % 9 AS clone_total FROM lineitem GROUP BY 1),
r AS (SELECT id, list_filter([CASE WHEN complexity_max > 20 THEN 'metric:complexity_threshold' END, CASE WHEN coupling_max > 10 THEN 'metric:coupling_threshold' END, CASE WHEN health_score < 60 THEN 'metric:health_threshold' END, CASE WHEN dependency_cycles > 0 THEN 'metric:dependency_cycles' END, CASE WHEN health_delta < 0 THEN 'metric:health_regression' END, CASE WHEN clone_new_count > 0 THEN 'clone:new' END, CASE WHEN clone_total > 5 THEN 'clone:threshold' END], lambda x: x IS NOT NULL) AS reasons FROM s)
SELECT id, reasons, CASE WHEN len(reasons) > 0 THEN 3 ELSE 0 END AS exit_code FROM r""")
def gate_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    s = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        (n % 50).alias("complexity_max"), (F.countDistinct("l_partkey") % 15).alias("coupling_max"), (n % 101).alias("health_score"), (F.count_if(F.col("l_returnflag") == "R") % 3).alias("dependency_cycles"),
        (n % 7 - 3).alias("health_delta"), (n % 4).alias("clone_new_count"), (n % 9).alias("clone_total"),
    )
    config = {"complexity_threshold": 20, "coupling_threshold": 10, "health_threshold": 60, "dependency_cycles": True, "health_regression": True, "clone_new": True, "clone_threshold": 5}
    return G.evaluate(s, config).select("id", "reasons", "exit_code")


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 AND (user_id % 5 > 2 OR event_id % 3 > 0) THEN 'baseline_changed_with_functional_code' END, CASE WHEN event_id % 2 = 0 AND user_id % 5 > 2 THEN 'baseline_updated_while_regressions_present' END,
 CASE WHEN event_id % 2 = 0 AND user_id % 7 <> 0 THEN 'baseline_updated_without_intent' END, CASE WHEN event_id % 2 = 0 AND event_type = 'error' AND value >= 5 THEN 'ci_greened_by_accepting_debt' END], lambda x: x IS NOT NULL) AS triggers FROM events""")
def baseline_abuse(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select(
        "event_id", (F.col("event_type") == "error").alias("before_fails"), (F.col("value") < 5).alias("after_fails"), (F.col("event_id") % 2 == 0).alias("updated"),
        F.greatest(F.lit(0), F.col("user_id") % 5 - 2).alias("regressions"), (F.col("event_id") % 3).alias("changed"), (F.col("user_id") % 7 == 0).alias("intent"),
    )
    return e.select("event_id", G.baseline_abuse().alias("triggers"))


@query("""WITH m AS (SELECT doc_id AS path, n_chars AS stat FROM documents WHERE doc_id % 10 <> 1), c AS (SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS stat FROM documents WHERE doc_id % 11 <> 2), j AS (SELECT coalesce(m.path, c.path) AS path, m.path AS a, c.path AS b, m.stat AS sa, c.stat AS sb FROM m FULL JOIN c ON m.path = c.path)
SELECT path, CASE WHEN b IS NULL THEN 'deleted' WHEN a IS NULL THEN 'added' WHEN sa <> sb OR path IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'drifted' ELSE 'fresh' END AS state FROM j""")
def workspace_drift(spark: SparkSession, sf: str) -> DataFrame:
    d, path = read_table(spark, sf, "documents"), F.col("doc_id").alias("path")
    m = d.where("doc_id % 10 <> 1").select(path, F.col("n_chars").alias("stat"))
    c = d.where("doc_id % 11 <> 2").select(path, F.when(F.col("doc_id") % 6 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("stat"))
    return G.drift(m, c, read_table(spark, sf, "labels").where("toxic = 1").select(path))


@query("""WITH i AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts + INTERVAL 10 DAY END AS expires, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 7 DAY END AS lease, user_id % 3 = 0 AS own, event_type <> 'error' AS alive FROM events)
SELECT event_id, CASE WHEN expires IS NULL OR expires <= TIMESTAMP '2024-01-20' THEN 'expired' WHEN own THEN CASE WHEN coalesce(lease > TIMESTAMP '2024-01-20', FALSE) THEN 'own_active' ELSE 'own_stale' END WHEN NOT alive THEN 'recoverable' WHEN coalesce(lease > TIMESTAMP '2024-01-20', FALSE) THEN 'foreign_active' ELSE 'foreign_stale' END AS state FROM i""")
def intent_ownership(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    e = read_table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 != 0, ts + F.expr("interval 10 day")).alias("expires"), F.when(F.col("event_id") % 4 != 0, ts + F.expr("interval 7 day")).alias("lease"), (F.col("event_type") != "error").alias("alive"))
    return e.select("event_id", G.ownership(F.col("user_id") % 3 == 0, F.lit("2024-01-20").cast("timestamp")).alias("state"))


@query("""WITH b AS (SELECT DISTINCT conv_id AS qualname, role || ':' || CAST(length(text) // 200 AS VARCHAR) AS signature, turn AS start, turn AS "end" FROM conversations) SELECT qualname, signature, count(*) AS n, min(start) AS first_start FROM b GROUP BY 1, 2 HAVING count(*) >= 2""")
def duplicate_branches(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return G.duplicate_branches(c.select(F.col("conv_id").alias("qualname"), F.concat("role", F.lit(":"), F.floor(F.length("text") / 200).cast("string")).alias("signature"), F.col("turn").alias("start"), F.col("turn").alias("end")))


_MODE = "(SELECT l_partkey, {p} AS m FROM (SELECT l_partkey, {p}, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, {p}) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1)"


@query(f"""WITH c AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_returnflag) AS df, count(DISTINCT l_linestatus) AS ds FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
d AS (SELECT l.l_partkey, l_orderkey * 100 + l_linenumber AS member, list_filter([CASE WHEN ds > 1 AND l_linestatus <> b.m THEN 'l_linestatus' END, CASE WHEN df > 1 AND l_returnflag <> a.m THEN 'l_returnflag' END], lambda x: x IS NOT NULL) AS drift_fields FROM lineitem l JOIN c ON c.l_partkey = l.l_partkey JOIN {_MODE.format(p='l_returnflag')} a ON a.l_partkey = l.l_partkey JOIN {_MODE.format(p='l_linestatus')} b ON b.l_partkey = l.l_partkey)
SELECT l_partkey, member, drift_fields FROM d WHERE len(drift_fields) > 0""")
def cohort_drift(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("member"), "l_returnflag", "l_linestatus")
    return G.cohort_drift(li, "l_partkey", "member", ["l_returnflag", "l_linestatus"])


@query("""SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS family_clone, count(*) FILTER (lang = 'fr') AS family_structural, count(*) FILTER (lang = 'de') AS family_dead_code, count(*) FILTER (lang = 'es') AS family_design,
 count(*) FILTER (doc_id % 4 = 0) AS severity_critical, count(*) FILTER (doc_id % 4 = 1) AS severity_warning, count(*) FILTER (doc_id % 4 = 2) AS severity_info, count(*) FILTER (doc_id % 5 <> 0) AS novelty_new, count(*) FILTER (doc_id % 5 = 0) AS novelty_known FROM documents""")
def findings_summary(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in (("en", "clone"), ("fr", "structural"), ("de", "dead_code"), ("es", "design")) for x in kv])
    return G.findings_summary(findings(spark, sf).withColumn("family", F.element_at(names, F.col("family"))))


@query("""WITH m AS (SELECT l_suppkey AS path, l_partkey % 3 AS class, CASE WHEN l_quantity < 10 THEN 'candidate' WHEN l_quantity < 15 THEN 'noop_stub' WHEN l_quantity < 20 THEN 'dunder' ELSE 'override' END AS kind FROM lineitem)
SELECT path, class, count(*) AS methods, count(*) FILTER (kind = 'candidate') AS candidate, count(*) FILTER (kind = 'noop_stub') AS noop_stub, count(*) FILTER (kind = 'dunder') AS dunder, count(*) FILTER (kind = 'override') AS override FROM m GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'candidate') > 0""")
def instance_methods(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    kind = F.when(q < 10, "candidate").when(q < 15, "noop_stub").when(q < 20, "dunder").otherwise("override")
    return G.instance_methods(read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 3).alias("class"), kind.alias("kind")))


_CT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
for _p, _m in S.CORPUS_MASKS:
    _CT = f"regexp_replace({_CT}, '{_p}', '{_m}', 'g')"


@query(f"SELECT doc_id, sha256(regexp_replace({_CT}, '^(?i)(?:{'|'.join(S.TEMPLATE_PREFIXES)})', '')) AS digest FROM documents")
def corpus_digests(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(S.corpus_text(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query("""SELECT conv_id, turn, list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9_À-ɏ./-]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')), lambda t: length(t) >= 2)) IS NOT NULL AS has_tokens,
 CAST(len(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9_À-ɏ./-]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')), lambda t: length(t) >= 2))) AS INTEGER) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimate, CASE WHEN length(text) > 240 THEN substring(text, 1, 239) || '…' ELSE text END AS preview FROM conversations""")
def text_features(spark: SparkSession, sf: str) -> DataFrame:
    t = S.query_tokens(F.col("text"))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", t.isNotNull().alias("has_tokens"), F.size(t).alias("tokens"), S.token_estimate(F.col("text")).alias("estimate"), S.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, sha256(lang || chr(10) || source || chr(10) || doc_id) AS item_id, 'doc:' || url_encode(source || '/a b') || ':' || lang AS identity_key, CASE WHEN contains(lower(source), 'src1') THEN 'one' WHEN contains(lower(source), 'rc') THEN 'any' ELSE 'unknown' END AS family FROM documents""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        "doc_id", S.joined_id(F.col("lang"), F.col("source"), F.col("doc_id")).alias("item_id"), S.identity_key(F.lit("doc"), F.concat("source", F.lit("/a b")), F.col("lang")).alias("identity_key"),
        S.first_containing(F.col("source"), [("src1", "one"), ("rc", "any")]).alias("family"),
    )


@query("""WITH s AS (SELECT event_id, 'SELECT  * FROM t' || user_id % 3 || ' WHERE id IN (' || event_id || ', ' || user_id || ') AND name = ''' || event_type || '''' AS q FROM events)
SELECT event_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(q), '[ \t\r\n]+', ' ', 'g')), '''[^'']*''', '?', 'g'), '0x[0-9a-f]+', '?', 'g'), '[0-9]+(\\.[0-9]+)?', '?', 'g'), '\\( ?\\?( ?, ?\\?)* ?\\)', '(?)', 'g'), 1, 200) AS fingerprint, regexp_extract(lower(trim(q)), '^([a-z]+)', 1) AS kind, regexp_extract(lower(q), '(?:from|into|update|join) +([a-z_][a-z0-9_.]*)', 1) AS tab FROM s""")
def sql_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    q = F.concat(F.lit("SELECT  * FROM t"), (F.col("user_id") % 3).cast("string"), F.lit(" WHERE id IN ("), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit(") AND name = '"), F.col("event_type"), F.lit("'"))
    return read_table(spark, sf, "events").select("event_id", S.sql_fingerprint(q).alias("fingerprint"), S.sql_kind(q).alias("kind"), S.sql_table(q).alias("tab"))
