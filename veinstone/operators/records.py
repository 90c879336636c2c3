"""Record texts, scans of logs, jobs and checks of stored vectors (2.1, 2.11, 2.12, 2.13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions.scalars import query_tokens, token_estimate

#: 2.11.17: fields whose empty list says that there are none; the caller names them.
MISSING, EMPTY, CONFIRMED = "unknown", "empty collection", "none (confirmed empty)"


def search_text(fields: list[Column], subjects: Column, payload: Column) -> Column:
    """2.11.5: the fields, the subjects (array of kind and key, with forward slashes) and the
    payload's keys and values by key (a map), trimmed and joined by one space."""
    named = F.flatten(F.transform(subjects, lambda s: F.array(s["kind"], F.translate(s["key"], "\\", "/"))))
    pairs = F.flatten(F.transform(F.array_sort(F.map_entries(payload)), lambda e: F.array(e["key"], e["value"])))
    every = F.concat(F.array(*fields), F.coalesce(named, F.array().cast("array<string>")), F.coalesce(pairs, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")


def like_matches(docs: DataFrame, ident: str, blob: Column, query: str, every: bool = False) -> DataFrame:
    """2.11.4: documents whose lower-cased text holds any or all of the query's tokens as they
    are written; none for a query without tokens."""
    tokens = query_tokens(F.lit(query))
    low = F.lower(F.coalesce(blob, F.lit("")))
    hit = F.forall if every else F.exists
    return docs.where(F.coalesce(F.size(tokens) > 0, F.lit(False)) & hit(tokens, lambda t: F.contains(low, t))).select(ident)


def payload_estimate(payload: Column) -> Column:
    """2.11.7: tokens of the canonical JSON of a struct (keys in the order given), by characters."""
    return token_estimate(F.to_json(payload, {"ignoreNullFields": "false"}))


def content_digest(payload: Column) -> Column:
    """2.11.10: SHA-256 of the canonical JSON of a struct whose fields are sorted."""
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def run_matches(stored: Column, wanted: Column) -> Column:
    """2.11.12: a stored run id that is the wanted one or begins it."""
    return F.coalesce((F.length(stored) > 0) & ((stored == wanted) | wanted.startswith(stored)), F.lit(False))


def metadata_display(payload: Column, field: str, confirmed: bool = False) -> Column:
    """2.11.17: a JSON field as shown: missing, empty, the sorted distinct items of a list, or
    the value."""
    raw = F.get_json_object(payload, f"$.{field}")
    items = F.from_json(raw, "array<string>")
    shown = F.array_join(F.array_sort(F.array_distinct(items)), ", ")
    return F.when(raw.isNull(), MISSING).when(raw == "[]", CONFIRMED if confirmed else EMPTY).when(raw.startswith("["), shown).otherwise(raw)


def finding_key(qualname: Column, signature: Column) -> Column:
    """2.11.26."""
    return F.sha1(F.concat(F.lit("duplicated_branches|qualname="), qualname, F.lit("|sig="), signature))


def as_int(value: Column, default: int = 0) -> Column:
    """2.11.27: a text as a whole number, blanks around it allowed, else the default."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.coalesce(F.expr("1") * F.replace(text, F.lit("_"), F.lit("")).try_cast("long"), F.lit(default))).otherwise(F.lit(default)).cast("long")


def audit_scan(events: DataFrame, repo: str, workflow: str | None = None) -> DataFrame:
    """2.1.22: events of a repository that have a workflow, a core and its digest, by workflow and id."""
    rows = events.where((F.col("repo") == repo) & (F.coalesce("workflow_id", F.lit("")) != "") & F.col("core_json").isNotNull() & F.col("core_sha").isNotNull())
    rows = rows.where(F.col("workflow_id") == workflow) if workflow is not None else rows
    return rows.orderBy("workflow_id", "id")


def select_operations(ops: DataFrame, operation=None, correlation=None, session=None, last: int = 20) -> DataFrame:
    """2.1.24: operations (id, parent, correlation, session, started) of one operation's
    correlation, of a correlation, of a session, or of the correlations of the last roots."""
    if session is not None and operation is None and correlation is None:
        return ops.where(F.col("session") == session)
    if correlation is not None and operation is None:
        return ops.where(F.col("correlation") == correlation)
    if operation is not None:
        wanted = ops.where(F.col("id") == operation)
    else:
        wanted = ops.where(F.col("parent").isNull()).orderBy(F.desc("started"), F.desc("id")).limit(last)
    return ops.join(F.broadcast(wanted.select("correlation").distinct()), "correlation", "left_semi")  # one, or at most ``last``


def public_surfaces(api: DataFrame, tools: DataFrame) -> DataFrame:
    """2.1.17: a record for each public symbol (qualname, kind, params) and each tool (name)."""
    a = api.select(F.lit("public_surface").alias("type"), F.lit("symbol").alias("subject_kind"), F.col("qualname").alias("subject"), F.concat(F.col("kind"), F.lit("("), F.array_join("params", ", "), F.lit(")")).alias("statement"))
    b = tools.select(F.lit("public_surface"), F.lit("tool"), F.col("name"), F.concat(F.lit("tool "), F.col("name")))
    return a.union(b)


def claim_next(jobs: DataFrame, by: str, now: Column, timeout: str = "1 hour") -> DataFrame:
    """2.13.16: jobs (project, id, status, requested, started, claimed_by, attempt) after each
    project claims its next one: running jobs over the timeout are pending again, and where
    none runs the first pending one by (requested, id) starts."""
    stale = (F.col("status") == "running") & (F.col("started") + F.expr(f"interval {timeout}") <= now)
    rows = jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))
    next_ = F.min(F.when(F.col("status") == "pending", F.struct("requested", "id")))
    each = rows.groupBy("project").agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("_busy"), next_.alias("_next"))
    j = rows.join(each.withColumnRenamed("project", "_p"), F.col("project") == F.col("_p"))
    mine = ~F.col("_busy") & (F.col("status") == "pending") & (F.col("id") == F.col("_next.id"))
    return j.select(
        "project", "id", F.when(mine, "running").otherwise(F.col("status")).alias("status"), "requested", F.when(mine, now).otherwise(F.col("started")).alias("started"),
        F.when(mine, by).otherwise(F.col("claimed_by")).alias("claimed_by"), (F.col("attempt") + F.when(mine, 1).otherwise(0)).alias("attempt"),
    )


def vector_faults(metadata: DataFrame, rows: DataFrame, dims: int) -> DataFrame:
    """2.12.10: (id, fault) of stored vectors (id, vector, digest) against their metadata (id,
    digest): missing, foreign, of other dimensions, not finite, or of another digest."""
    m = metadata.select(F.col("id").alias("a"), F.col("digest").alias("da"))
    r = rows.select(F.col("id").alias("b"), "vector", F.col("digest").alias("db"))
    j = m.join(r, F.col("a") == F.col("b"), "full_outer")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fault = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "foreign").when(F.size("vector") != dims, "dimensions").when(odd, "not_finite").when(~F.col("da").eqNullSafe(F.col("db")), "digest")
    )
    return j.select(F.coalesce("a", "b").alias("id"), fault.alias("fault")).where("fault IS NOT NULL")


def sweep_winner(results: DataFrame) -> DataFrame:
    """2.12.5: the best score, ties to the smaller parameters."""
    return results.orderBy(F.desc("score"), "dims", "min_size", "min_samples", "method").limit(1)


def cluster_diagnostics(items: DataFrame, label: str, by: list[str], k: int = 3) -> DataFrame:
    """2.12.8: (label, field, value, n, share): the k first values of each field in each
    cluster and in the noise (label < 0)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by]))
    g = items.select(label, pairs.alias("p")).groupBy(label, "p.field", "p.value").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(label, "field")
    g = g.withColumn("share", F.bround(F.col("n") / F.sum("n").over(whole), 4)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("n"), F.col("value").asc_nulls_last())))
    return g.where(F.col("rank") <= k)


def projection_probe(texts: DataFrame, lane: str, text: str, limit: int, size: int) -> DataFrame:
    """2.12.17: per lane documents, units of ``size`` characters, documents of several units,
    tokens of the largest unit, and units over ``limit`` tokens."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size)).cast("int"))
    rows = texts.select(lane, F.col(text).alias("_t"), n.alias("_n"))
    units = rows.select(lane, F.when(F.col("_n") > 1, 1).otherwise(0).alias("_many"), F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring("_t", i * size + 1, F.lit(size)))).alias("_i", "_u"))
    tokens = token_estimate(F.col("_u"))
    return units.groupBy(lane).agg(
        F.count_if(F.col("_i") == 0).alias("documents"), F.count("*").alias("units"), F.sum(F.when(F.col("_i") == 0, F.col("_many")).otherwise(0)).alias("multi_unit"),
        F.max(tokens).alias("largest"), F.count_if(tokens > limit).alias("overflow"),
    )


def semantic_search(found: DataFrame, sources: dict[str, DataFrame], k: int) -> DataFrame:
    """2.12.13: the k best hits (source, id, score) with the text of their own source; hits
    whose row is gone are left out before they count."""
    parts = [found.where(F.col("source") == name).join(rows.select("id", "text"), "id") for name, rows in sorted(sources.items())]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "source", "id").limit(k)


def without_place(rows: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """2.14.13: records whose subject is neither a path (path) nor a folder above one nor a
    qualified name (qualname). Each path gives its folders, so the anti-join is on equal keys."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = paths.where("path IS NOT NULL").select(F.explode(above).alias("_s")).union(names.where("qualname IS NOT NULL").select("qualname")).distinct()
    return rows.join(known, F.rtrim(F.col("subject"), F.lit("/")) == F.col("_s"), "left_anti")


def subject_coverage(rows: DataFrame, paths: DataFrame, scope: list[str]) -> DataFrame:
    """2.14.13: one row: the total of distinct paths in the scope (all of ``paths`` without one),
    those covered by a record of their own or of a folder above them, and percent (whole, 100 for none)."""
    asked = rows.sparkSession.createDataFrame([(p.rstrip("/"),) for p in scope], "path string") if scope else paths
    wanted = asked.where("path IS NOT NULL").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = wanted.select("path", F.explode(above).alias("_a")).join(rows.select(F.rtrim(F.col("subject"), F.lit("/")).alias("_s")).distinct(), F.col("_a") == F.col("_s"), "left_semi")
    both = wanted.join(hit.select("path").distinct().withColumn("_hit", F.lit(1)), "path", "left").agg(F.count("*").alias("total"), F.count("_hit").alias("covered"))
    share = F.when(F.col("total") == 0, 100).otherwise(F.bround(100 * F.col("covered") / F.col("total"), 0).cast("int"))
    return both.withColumn("percent", share)
