"""Clone queries over ``documents``: a document is a function, a line a statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import clones as C
from veinstone.operators.windows import merge_intervals, outermost
from veinstone.plans.registry import query
from veinstone.session import read_table

_NORM = r"regexp_replace(regexp_replace(lower(trim({x})), '[0-9]+', '0', 'g'), '[ \t]+', ' ', 'g')"
_LINES = f"""lines AS (
  SELECT 'src/' || source AS path, source || ':' || doc_id AS qualname, i AS line, {_NORM.format(x='x')} AS norm
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
  WHERE {_NORM.format(x='x')} <> ''
), stmts AS (
  SELECT path, qualname, list(norm ORDER BY line) AS norms, list(line ORDER BY line) AS pos FROM lines GROUP BY ALL
), units AS (
  SELECT 'src/' || d.source AS path, d.source || ':' || d.doc_id AS qualname, coalesce(norms, []) AS norms, coalesce(pos, []) AS pos,
    coalesce(pos[-1], 0) AS loc, sha1(coalesce(array_to_string(norms, '|'), '')) AS fingerprint,
    sha1(regexp_replace(coalesce(d.text, ''), '[ \t\n\r\f\v]+', '', 'g')) AS raw_hash
  FROM documents d LEFT JOIN stmts s ON s.qualname = d.source || ':' || d.doc_id
), keyed AS (
  SELECT *, fingerprint || '|' || CASE WHEN loc <= 19 THEN '0-19' WHEN loc <= 49 THEN '20-49' WHEN loc <= 99 THEN '50-99' ELSE '100+' END AS group_key FROM units
)"""
_GROUPS = (
    _LINES
    + """, groups AS (
  SELECT group_key, count(*) AS items, count(DISTINCT raw_hash) AS raw_hashes, count(DISTINCT path) AS files,
    count(DISTINCT qualname) AS functions, min(qualname) AS first_qualname, 'clone:function:' || group_key AS group_id,
    CASE WHEN count(DISTINCT raw_hash) = 1 THEN 'Type-1' ELSE 'Type-2' END AS clone_type
  FROM keyed GROUP BY group_key HAVING count(*) > 1
)"""
)


def units_of(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return C.units(d, F.concat(F.lit("src/"), "source"), F.concat_ws(":", "source", F.col("doc_id").cast("string")), F.col("text"))


@query(f"WITH {_GROUPS} SELECT * FROM groups")
def clone_groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.function_groups(units_of(spark, sf))


@query(f"""WITH {_GROUPS}, known AS (
  SELECT group_key FROM keyed WHERE CAST(split_part(qualname, ':', 2) AS BIGINT) % 2 = 0 GROUP BY 1 HAVING count(*) > 1
), s AS (
  SELECT g.*, CASE WHEN items >= 4 THEN 'critical' ELSE 'warning' END AS severity, k.group_key IS NULL AS fresh FROM groups g LEFT JOIN known k USING (group_key)
)
SELECT * EXCLUDE (fresh), CAST(CASE severity WHEN 'critical' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS priority, CASE WHEN fresh THEN 'new' ELSE 'known' END AS novelty FROM s""")
def clone_group_rows(spark: SparkSession, sf: str) -> DataFrame:
    u = units_of(spark, sf)
    before = C.function_groups(u.where(F.split_part("qualname", F.lit(":"), F.lit(2)).cast("long") % 2 == 0))
    return C.group_rows(C.function_groups(u), before)


@query(f"WITH {_LINES} SELECT path, qualname, CAST(loc AS INTEGER) AS loc, CAST(len(norms) AS INTEGER) AS stmt_count, fingerprint FROM units WHERE loc >= 10 AND len(norms) >= 6")
def eligible_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.eligible(units_of(spark, sf)).select("path", "qualname", "loc", "stmt_count", "fingerprint")


_BLOCKS = (
    _LINES
    + """, kept AS (
  SELECT path, qualname, norms, pos, list_reduce(list_transform(pos[1:len(pos) - 3], lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 3 THEN list_concat(acc, x) ELSE acc END)[1:15] AS starts
  FROM units WHERE len(norms) >= 4
), blocks AS (
  SELECT path, qualname, start, pos[list_position(pos, start) + 3] AS "end", CAST(4 AS INTEGER) AS size,
    array_to_string(list_transform(norms[list_position(pos, start):list_position(pos, start) + 3], lambda n: sha1(n)), '|') AS block_hash
  FROM (SELECT *, unnest(starts) AS start FROM kept)
), bgroups AS (
  SELECT block_hash, count(*) AS items, count(DISTINCT qualname) AS functions FROM blocks GROUP BY 1 HAVING count(DISTINCT qualname) >= 2
)"""
)


@query(f'WITH {_BLOCKS} SELECT block_hash, path, qualname, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", size FROM blocks')
def block_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocks(units_of(spark, sf))


@query(f"WITH {_BLOCKS} SELECT * FROM bgroups")
def block_groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.block_groups(C.blocks(units_of(spark, sf)))


@query(f"""WITH {_BLOCKS} SELECT block_hash, items, CAST(len(string_split(block_hash, '|')) AS INTEGER) AS "window",
  CAST(len(list_distinct(string_split(block_hash, '|'))) AS INTEGER) AS distinct_statements, len(list_distinct(string_split(block_hash, '|'))) = 1 AS repeated, items - 1 AS peers FROM bgroups""")
def block_group_facts(spark: SparkSession, sf: str) -> DataFrame:
    return C.block_facts(C.block_groups(C.blocks(units_of(spark, sf))))


_SEGMENTS = (
    _LINES
    + """, seg AS (
  SELECT path, qualname, pos[i] AS start, pos[i + 2] AS "end", list_transform(norms[i:i + 2], lambda n: sha1(n)) AS h
  FROM (SELECT *, unnest(range(1, least(len(norms) - 1, 61))) AS i FROM units WHERE len(norms) >= 3)
), hashed AS (
  SELECT path, qualname, start, "end", sha1(array_to_string(h, '|')) AS segment_hash, sha1(array_to_string(list_sort(h), '|')) AS segment_sig FROM seg
), sgroups AS (
  SELECT segment_hash, qualname, count(*) AS items, min(segment_sig) AS segment_sig, segment_hash || '|' || qualname AS group_key FROM hashed GROUP BY 1, 2 HAVING count(*) >= 2
)"""
)


@query(f"WITH {_SEGMENTS} SELECT * FROM sgroups")
def segment_groups(spark: SparkSession, sf: str) -> DataFrame:
    return C.segment_groups(C.segments(units_of(spark, sf), 3))


@query(f"""WITH {_SEGMENTS}, r AS (
  SELECT g.group_key, h.* FROM hashed h JOIN sgroups g USING (segment_hash, qualname)
), f AS (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY group_key, path, qualname ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r
), i AS (
  SELECT *, sum(fresh) OVER (PARTITION BY group_key, path, qualname ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f
)
SELECT group_key, path, qualname, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end", count(*) AS merged, CAST(max("end") - min(start) + 1 AS INTEGER) AS size FROM i GROUP BY group_key, path, qualname, island""")
def merged_segments(spark: SparkSession, sf: str) -> DataFrame:
    return C.merged_segments(C.segments(units_of(spark, sf), 3))


@query(f"""WITH {_LINES}, m AS (SELECT group_key, path FROM keyed)
SELECT group_key, count(*) AS items, bool_and(regexp_matches(path, 'src/src1[0-9]?$') OR regexp_matches(path, 'src/src2$')) AS suppressed,
  count(*) FILTER (regexp_matches(path, 'src/src1[0-9]?$') OR regexp_matches(path, 'src/src2$')) AS matched FROM m GROUP BY 1""")
def golden_fixture_split(spark: SparkSession, sf: str) -> DataFrame:
    u = units_of(spark, sf).select(F.concat_ws("|", "fingerprint", "loc_bucket").alias("group_key"), "path")
    return C.split_fixtures(u, "group_key", "path", ["src/src1[0-9]?$", "src/src2$"])


@query("""WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS line, bool_or(l_returnflag = 'R') AS is_assert FROM lineitem GROUP BY 1, 2),
r AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, 1 AS start, CAST(2 + o_orderkey % 3 AS INTEGER) AS "end" FROM orders),
j AS (SELECT r.*, s.line, s.is_assert, row_number() OVER w AS seq, sum(CASE WHEN is_assert THEN 1 ELSE 0 END) OVER w AS hits
  FROM r LEFT JOIN s ON s.path = r.path AND line BETWEEN start AND "end" WINDOW w AS (PARTITION BY r.path, start, "end" ORDER BY line)),
e AS (SELECT path, start, "end", CASE WHEN is_assert THEN seq - hits END AS run, count(line) AS n FROM j GROUP BY ALL)
SELECT path, start, "end", CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (run IS NOT NULL), 0) AS BIGINT) AS asserts, coalesce(max(n) FILTER (run IS NOT NULL), 0) AS longest FROM e GROUP BY 1, 2, 3""")
def assert_runs(spark: SparkSession, sf: str) -> DataFrame:
    li, o = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders")
    s = li.groupBy(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("is_assert"))
    r = o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit(1).alias("start"), (2 + F.col("o_orderkey") % 3).cast("int").alias("end"))
    return C.assert_runs(s, r)


_ISLANDS = """WITH r AS (SELECT l_suppkey AS owner, CAST(l_partkey AS INTEGER) AS start, CAST(floor(l_partkey + l_quantity / 10) AS INTEGER) AS "end" FROM lineitem),
f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
"""


@query(_ISLANDS + 'SELECT owner, min(start) AS start, max("end") AS "end", count(*) AS merged FROM i GROUP BY owner, island')
def merged_ranges(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    end = F.floor(F.col("l_partkey") + F.col("l_quantity") / 10).cast("int")
    return merge_intervals(li.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").cast("int").alias("start"), end.alias("end")), ["owner"], "start", "end")


@query("""WITH g AS (SELECT l_suppkey AS owner, list_sort(list({'s': CAST(l_partkey AS INTEGER), 'n': CAST(-(l_partkey + l_quantity) AS INTEGER)})) AS x FROM lineitem GROUP BY 1),
r AS (SELECT owner, list_reduce(list_transform(x, lambda z: [z.s, -z.n]), lambda acc, z: CASE WHEN z[1] > acc[-1] THEN list_concat(acc, z) ELSE acc END) AS k FROM g)
SELECT owner, CAST(k[2 * i - 1] AS INTEGER) AS start, CAST(k[2 * i] AS INTEGER) AS "end" FROM (SELECT owner, k, unnest(range(1, len(k) // 2 + 1)) AS i FROM r)""")
def outermost_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    spans = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").cast("int").alias("start"), (-(F.col("l_partkey") + F.col("l_quantity"))).cast("int").alias("neg_end"))))
    kept = li.groupBy(F.col("l_suppkey").alias("owner")).agg(spans.alias("s")).select("owner", F.explode(outermost(F.col("s"))).alias("x"))
    return kept.select("owner", F.col("x.start").alias("start"), (-F.col("x.neg_end")).alias("end"))
