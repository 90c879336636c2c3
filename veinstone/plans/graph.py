"""Graph queries: orders as modules of their customer's package. An order imports the
customer's next one and the next one with the same part in its first line, so the
graph grows with the tables and its paths are dozens of modules long. In the cyclic
version every third customer's last order imports the first, and these orders import
within their package only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.operators import graph as G
from veinstone.plans.registry import query
from veinstone.session import read_table

_NAMED = """ord AS (SELECT o_orderkey AS k, o_custkey AS c, 'c' || o_custkey || '.o' || o_orderkey AS m FROM orders),
line1 AS (SELECT DISTINCT ord.k, ord.c, ord.m, l_partkey AS p FROM lineitem JOIN ord ON ord.k = l_orderkey WHERE l_linenumber = 1),
own AS (SELECT m AS src, lead(m) OVER (PARTITION BY c ORDER BY k) AS dst FROM ord), part1 AS (SELECT c, m AS src, lead(m) OVER (PARTITION BY p ORDER BY k) AS dst FROM line1)"""
_DAG = f"{_NAMED}, e AS (SELECT src, dst FROM own WHERE dst IS NOT NULL UNION SELECT src, dst FROM part1 WHERE dst IS NOT NULL)"
_EDGES = f"""{_NAMED}, ring AS (SELECT arg_max(m, k) AS src, arg_min(m, k) AS dst FROM ord WHERE c % 3 = 0 GROUP BY c),
e AS (SELECT src, dst FROM own WHERE dst IS NOT NULL UNION SELECT src, dst FROM part1 WHERE dst IS NOT NULL AND c % 3 <> 0 UNION SELECT src, dst FROM ring)"""


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """(k, c, m): orders, their customers and module names."""
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".o"), F.col("o_orderkey").cast("string")).alias("m"))


def _next(rows: DataFrame, by: str) -> DataFrame:
    return rows.select("c", F.col("m").alias("src"), F.lead("m").over(Window.partitionBy(by).orderBy("k")).alias("dst")).where("dst IS NOT NULL")


def dag(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to later orders of the customer and of the part."""
    return _linked(spark, sf).select("src", "dst").distinct()


def _linked(spark: SparkSession, sf: str, parts: str = "true") -> DataFrame:
    o = modules(spark, sf)
    first = read_table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    return _next(o, "c").unionByName(_next(o.join(first, "k").distinct(), "p").where(parts))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """The version with a circle for every third customer."""
    ring = modules(spark, sf).where("c % 3 = 0").groupBy("c").agg(F.max_by("m", "k").alias("src"), F.min_by("m", "k").alias("dst"))
    return _linked(spark, sf, "c % 3 <> 0").unionByName(ring).select("src", "dst").distinct()


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE string_split(dst, '.')[1] IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)")
def internal_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The roots of the tree are the packages of customers with a balance."""
    roots = read_table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("root"))
    return G.internal(trade(spark, sf), roots)


@query(f"""WITH RECURSIVE {_EDGES}, r(o, n) AS (SELECT src, dst FROM e UNION SELECT r.o, e.dst FROM r JOIN e ON e.src = r.n),
c AS (SELECT a.o AS node, least(a.o, min(a.n)) AS component FROM r a JOIN r b ON a.o = b.n AND a.n = b.o GROUP BY a.o)
SELECT component, list(node ORDER BY node) AS members, count(*) AS size FROM c GROUP BY component""")
def dependency_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.cycles(trade(spark, sf))


_DEPTH = f"""WITH RECURSIVE {_DAG}, r(n, d) AS (SELECT src, 1 FROM e UNION SELECT dst, 1 FROM e UNION SELECT e.src, r.d + 1 FROM r JOIN e ON e.dst = r.n),
d AS (SELECT n AS node, CAST(max(d) AS INTEGER) AS depth FROM r GROUP BY n)"""


@query(f"{_DEPTH} SELECT node, depth FROM d")
def dependency_depths(spark: SparkSession, sf: str) -> DataFrame:
    return G.depths(dag(spark, sf))


@query(f"{_DEPTH} SELECT max(depth) AS max_depth, round_even(avg(depth), 4) AS avg_depth, list_sort(list(depth))[CAST(ceil(count(*) * 0.95) AS INTEGER)] AS p95 FROM d")
def dependency_depth_profile(spark: SparkSession, sf: str) -> DataFrame:
    return G.depth_profile(G.depths(dag(spark, sf)))


@query(f"""WITH RECURSIVE {_DAG}, p(n, path) AS (SELECT dst, [dst] FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, list_prepend(e.src, p.path) FROM p JOIN e ON e.dst = p.n)
SELECT CAST(-z.l AS INTEGER) AS length, z.path AS path FROM (SELECT n, min(struct_pack(l := -len(path), path := path)) AS z FROM p GROUP BY n) ORDER BY length DESC, path LIMIT 5""")
def longest_chains(spark: SparkSession, sf: str) -> DataFrame:
    return G.chains(dag(spark, sf))


_FAN = f"""WITH {_EDGES}, g AS (SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node),
f AS (SELECT *, round_even(fan_out / (fan_in + fan_out), 4) AS instability, round_even(least(fan_in, fan_out) / greatest(fan_in, fan_out), 4) AS hub_balance FROM g)"""


@query(f"{_FAN} SELECT * FROM f")
def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    return G.fan(trade(spark, sf))


@query(f"""{_FAN}, p AS (SELECT quantile_cont(fan_in, 0.9) AS p90 FROM f), s AS (SELECT node, fan_in, list_filter([CASE WHEN fan_in >= p90 THEN 'high_fan_in' END, CASE WHEN hub_balance >= 0.5 THEN 'hub' END, CASE WHEN instability >= 0.8 THEN 'unstable' END], lambda x: x IS NOT NULL) AS signals FROM f, p)
SELECT * FROM s WHERE len(signals) > 0 ORDER BY len(signals) DESC, fan_in DESC, node LIMIT 25""")
def unwind_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return G.unwind_candidates(G.fan(trade(spark, sf)))


@query(f"WITH {_DAG}, p AS (SELECT string_split(src, '.')[1] AS src, string_split(dst, '.')[1] AS dst FROM e) SELECT src, dst, count(*) AS weight FROM p WHERE src <> dst GROUP BY 1, 2")
def package_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return G.rollup(dag(spark, sf), 1)


@query(f"WITH {_DAG} SELECT DISTINCT dst AS origin, src AS dependent FROM e WHERE src <> dst")
def direct_dependents(spark: SparkSession, sf: str) -> DataFrame:
    e = dag(spark, sf)
    return G.dependents(e, G.nodes(e).select(F.col("node").alias("origin")))


@query(f"""WITH RECURSIVE {_DAG}, q AS (SELECT m AS o FROM ord WHERE k % 100 = 0), r(o, n, d) AS (SELECT dst, src, 1 FROM e WHERE dst IN (SELECT o FROM q) UNION SELECT r.o, e.src, r.d + 1 FROM r JOIN e ON e.dst = r.n)
SELECT o AS origin, n AS dependent, CAST(min(d) AS INTEGER) AS depth FROM r WHERE o <> n GROUP BY 1, 2""")
def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for the modules of every hundredth order, against all edges."""
    return G.transitive_dependents(dag(spark, sf), modules(spark, sf).where("k % 100 = 0").select(F.col("m").alias("origin")))


@query(f"""WITH {_DAG}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node, coalesce(x, 0) AS direct FROM n LEFT JOIN (SELECT dst, count(DISTINCT src) AS x FROM e WHERE src <> dst GROUP BY 1) ON dst = node)
SELECT node, direct, CASE WHEN direct = 0 THEN 'low' WHEN direct <= 5 THEN 'medium' ELSE 'high' END AS level FROM c""")
def blast_radius_levels(spark: SparkSession, sf: str) -> DataFrame:
    e = dag(spark, sf)
    d = G.dependents(e, G.nodes(e).select(F.col("node").alias("origin"))).groupBy("origin").agg(F.count("*").alias("direct"))
    rows = G.nodes(e).join(d, F.col("node") == F.col("origin"), "left").select("node", F.coalesce("direct", F.lit(0)).alias("direct"))
    return rows.withColumn("level", G.radius_level(F.col("direct")))


@query("""WITH g AS (SELECT DISTINCT l_partkey AS "group", l_suppkey AS path FROM lineitem) SELECT DISTINCT a.path AS origin, b.path AS path FROM g a JOIN g b ON a."group" = b."group" AND a.path <> b.path WHERE a.path % 100 = 0""")
def clone_cohort_members(spark: SparkSession, sf: str) -> DataFrame:
    g = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("group"), F.col("l_suppkey").alias("path")).distinct()
    return G.cohort_members(g, g.select(F.col("path").alias("origin")).distinct().where("origin % 100 = 0"))


@query("""WITH h AS (SELECT DISTINCT p_name AS name, CASE WHEN lower(p_name) = 'ring' THEN 0 WHEN list_contains(string_split_regex(lower(p_name), '[._: -]'), 'ring') THEN 1 WHEN starts_with(lower(p_name), 'ring') THEN 2 WHEN contains(lower(p_name), 'ring') THEN 3 END AS tier FROM part)
SELECT name, CAST(tier AS INTEGER) AS tier FROM h WHERE tier = (SELECT min(tier) FROM h)""")
def name_search(spark: SparkSession, sf: str) -> DataFrame:
    return G.name_search(read_table(spark, sf, "part"), "p_name", "Ring")


@query("""WITH RECURSIVE o AS (SELECT event_id AS id, CASE WHEN event_id % 40 = 7 THEN -event_id WHEN event_id % 10 <> 0 AND event_id > 0 THEN CASE WHEN event_id % 4 = 1 THEN event_id // 3 ELSE event_id - 1 END END AS up, ts AS t0 FROM events),
b AS (SELECT o.id, p.id AS up, o.t0 FROM o LEFT JOIN o p ON p.id = o.up AND o.up <> o.id),
t AS (SELECT id, id AS root, 0 AS depth, t0 AS r0, t0 FROM b WHERE up IS NULL UNION ALL SELECT b.id, t.root, t.depth + 1, t.r0, b.t0 FROM b JOIN t ON b.up = t.id)
SELECT id, root, CAST(depth AS INTEGER) AS depth, CAST(floor((epoch_us(t0) - epoch_us(r0)) / 1000.0) AS BIGINT) AS offset_ms FROM t""")
def trace_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """All events; some have no parent, some one that is unknown."""
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    parent = F.when(i % 40 == 7, -i).when((i % 10 != 0) & (i > 0), F.when(i % 4 == 1, F.floor(i / 3)).otherwise(i - 1))
    return G.forest(e.select(F.col("event_id").alias("id"), parent.alias("parent"), F.col("ts").alias("at")))
