"""Vector queries over ``embeddings``: the label is the cluster, label 0 stands for noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import density as D
from veinstone.operators import vectors as V
from veinstone.operators.windows import numbered
from veinstone.plans.registry import query
from veinstone.session import read_table

_CENT = """i AS (SELECT vec_id, CAST(label AS INTEGER) - 1 AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM i WHERE label >= 0),
c AS (SELECT label, list(x ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("label"), F.col("embedding").alias("v"))


@query(f"WITH {_CENT} SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM c")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return V.centroids(items(spark, sf), "label", "v").select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {_CENT}, d AS (SELECT i.label, vec_id, round(list_distance(v, centroid), 9) AS distance FROM i JOIN c ON c.label = i.label),
m AS (SELECT label, arg_min(vec_id, (distance, vec_id)) AS medoid, round(min(distance), 6) AS distance, count(*) AS size, sha256(array_to_string(list_sort(list(CAST(vec_id AS VARCHAR))), chr(10))) AS digest FROM d GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY size DESC, medoid, digest) AS INTEGER) AS display_id FROM m""")
def cluster_medoids(spark: SparkSession, sf: str) -> DataFrame:
    return V.canonical_order(V.medoids(items(spark, sf), "label", "vec_id", "v"), "label")


@query(f"""WITH {_CENT}, d AS (SELECT a.label, b.label AS other, round(list_distance(a.centroid, b.centroid), 6) AS distance FROM c a JOIN c b ON a.label <> b.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, other) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 3""")
def nearest_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return V.nearest_clusters(V.centroids(items(spark, sf), "label", "v"), "label")


@query(f"""WITH {_CENT}, d AS (SELECT i.label, vec_id, round(list_distance(v, centroid), 6) AS distance FROM i JOIN c ON c.label = i.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS near, row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS far FROM d)
SELECT label, vec_id, distance, CASE WHEN near <= 3 THEN 'representative' ELSE 'boundary' END AS role FROM r WHERE near <= 3 OR far <= 3""")
def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return V.representatives(items(spark, sf), "label", "vec_id", "v")


_KNN = """i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), j AS (SELECT q.vec_id AS qid, i.vec_id, round(list_distance(i.v, q.v), 6) AS distance FROM i JOIN i q ON q.vec_id % 100 = 0)"""


@query(f"""WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS INTEGER) AS rank FROM j) SELECT *, round(1.0 / (1.0 + distance), 6) AS score FROM r WHERE rank <= 10""")
def knn_search(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return V.knn(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), "vec_id", "embedding", 10)


@query("""SELECT doc_id // 4 AS parent, max(n_chars % 1000 / 1000.0) AS score FROM documents GROUP BY 1 ORDER BY score DESC, parent LIMIT 20""")
def collapsed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("parent"), (F.col("n_chars") % 1000 / 1000).alias("score"))
    return V.collapse_chunks(d, "parent", "score", 20)


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0""")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).union(e.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return V.upsert(e, new, "vec_id")


@query("""WITH a AS (SELECT doc_id AS id, lang AS revision, 'm' || doc_id % 2 AS model FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'x' ELSE lang END AS revision, 'm' || doc_id % 2 AS model FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'delete' WHEN a.revision = b.revision AND a.model = b.model AND b.revision <> '' THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id""")
def index_revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    model = F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model")
    a = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("revision"), model)
    rev = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("lang"))
    return V.revision_diff(a, d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), rev.alias("revision"), model))


@query("""WITH r AS (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / 1500.0)) AS INTEGER) AS chunks FROM documents), x AS (SELECT *, unnest(range(0, chunks)) AS i FROM r)
SELECT CASE WHEN chunks = 1 THEN 'trajectory:' || doc_id ELSE 'trajectory:' || doc_id || ':chunk:' || lpad(CAST(i AS VARCHAR), 3, '0') END AS row_id, doc_id, CAST(i AS INTEGER) AS chunk_index, chunks AS chunk_count, substring(text, CAST(i * 1500 + 1 AS INTEGER), 1500) AS chunk FROM x""")
def chunk_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunk_rows(read_table(spark, sf, "documents"), "doc_id", "text", 1500)


@query("""WITH t AS (SELECT count(*) AS n, max(len(embedding)) AS w FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT CAST(least(d, n - 1, w) AS INTEGER) AS dims, m AS min_size, least(s, m) AS min_samples, k AS method FROM t, (SELECT unnest([8, 16, 32]) AS d), (SELECT unnest([5, 10, 15, 25]) AS m), (SELECT unnest([1, 5, 10]) AS s), (SELECT unnest(['eom', 'leaf']) AS k) WHERE n > 1)
SELECT DISTINCT dims, min_size, min_samples, method FROM g""")
def sweep_grid(spark: SparkSession, sf: str) -> DataFrame:
    return V.sweep_grid(read_table(spark, sf, "embeddings"), "embedding")


@query()
def hdbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings by their first eight principal coordinates, clusters of ten at least."""
    e = V.project(read_table(spark, sf, "embeddings"), "embedding", 8)
    return D.hdbscan(e, "vec_id", "projected", min_size=10, min_samples=5).withColumn("strength", F.round("strength", 9))


@query()
def sweep_results(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of the grid by what they make of all embeddings; the winner has rank 1."""
    e = read_table(spark, sf, "embeddings")
    results, _ = D.sweep(e, "vec_id", "embedding", V.sweep_grid(e, "embedding"))
    return numbered(results.withColumn("score", F.round("score", 9)), [F.desc("score"), F.asc("dims"), F.asc("min_size"), F.asc("min_samples"), F.asc("method")])


@query("""WITH p AS (SELECT source AS profile, count(*) AS n, count(DISTINCT lang) AS k, max(n_chars) AS longest FROM documents GROUP BY 1),
s AS (SELECT *, round(CAST(n AS DOUBLE) / max(n) OVER () * CAST(0.5 AS DOUBLE) + CAST(k AS DOUBLE) / max(k) OVER () * CAST(0.3 AS DOUBLE) + CAST(longest AS DOUBLE) / max(longest) OVER () * CAST(0.2 AS DOUBLE), 6) AS score FROM p) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, profile) AS INTEGER) AS rank FROM s""")
def profile_ranking(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "documents").groupBy(F.col("source").alias("profile")).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("k"), F.max("n_chars").alias("longest"))
    return V.profile_rank(p, {"n": 0.5, "k": 0.3, "longest": 0.2})


_SUMMARIES = """a AS (SELECT vec_id AS item, CAST(label AS INTEGER) - 1 AS label, CASE WHEN vec_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN vec_id % 19 = 0 THEN NULL ELSE 1.0 / (1 + vec_id) END AS strength FROM embeddings
  UNION ALL SELECT vec_id, CAST(label AS INTEGER) - 1, 1.0 FROM embeddings WHERE vec_id % 23 = 0),
s AS (SELECT label + (label % 5 = 4)::INTEGER * 1000 AS label, CASE WHEN label % 3 = 1 THEN 'stale' ELSE sha256(array_to_string(list_sort(list(CAST(item AS VARCHAR))), chr(10))) END AS digest FROM a WHERE label >= 0 GROUP BY a.label)"""


@query(f"""WITH {_SUMMARIES}, o AS (SELECT label, count(*) AS n, sha256(array_to_string(list_sort(list(CAST(item AS VARCHAR))), chr(10))) AS d FROM a WHERE label >= 0 GROUP BY 1),
j AS (SELECT o.n, o.d, s.digest FROM o FULL JOIN s ON s.label = o.label), i AS (SELECT item, count(*) AS n, count(*) FILTER (strength IS NULL OR isnan(strength)) AS odd FROM a GROUP BY 1),
c AS (SELECT 'coverage' AS failed, count(*) FILTER (n > 1) AS n FROM i UNION ALL SELECT 'finite', CAST(sum(odd) AS BIGINT) FROM i UNION ALL SELECT 'least_size', count(*) FILTER (n < 10) FROM j
  UNION ALL SELECT 'membership_digest', count(*) FILTER (d <> digest) FROM j UNION ALL SELECT 'summary_links', count(*) FILTER (n IS NULL OR digest IS NULL) FROM j)
SELECT * FROM c WHERE n > 0""")
def partition_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Some strengths are missing, some items stand twice, some summaries are stale or of another label."""
    from veinstone.functions.scalars import membership_digest

    i = F.col("item")
    e = items(spark, sf).select(F.col("vec_id").alias("item"), "label")
    strength = F.when(i % 17 == 0, F.lit(float("nan"))).when(i % 19 == 0, F.lit(None)).otherwise(F.lit(1.0) / (1 + i))
    a = e.withColumn("strength", strength).unionByName(e.where("item % 23 = 0").withColumn("strength", F.lit(1.0)))
    s = a.where("label >= 0").groupBy("label").agg(membership_digest(F.collect_list(i.cast("string"))).alias("digest"))
    s = s.select((F.col("label") + F.when(F.col("label") % 5 == 4, 1000).otherwise(0)).alias("label"), F.when(F.col("label") % 3 == 1, "stale").otherwise(F.col("digest")).alias("digest"))
    return V.partition_validity(a, s, 10)


@query("""WITH RECURSIVE i AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT a.id, b.id AS id2 FROM i a JOIN i b ON list_distance(a.v, b.v) <= 1.0),
c AS (SELECT id FROM n GROUP BY id HAVING count(*) >= 4), e AS (SELECT n.id, n.id2 FROM n WHERE id IN (SELECT id FROM c) AND id2 IN (SELECT id FROM c)),
r(o, x) AS (SELECT id, id2 FROM e UNION SELECT r.o, e.id2 FROM r JOIN e ON e.id = r.x), k AS (SELECT o, min(x) AS cluster FROM r GROUP BY o), b AS (SELECT n.id, min(k.cluster) AS cluster FROM n JOIN k ON k.o = n.id2 GROUP BY n.id)
SELECT i.id, b.cluster FROM i LEFT JOIN b ON b.id = i.id""")
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return V.density_clusters(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 1.0, 4)
