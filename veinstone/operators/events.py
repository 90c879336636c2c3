"""Event log to per-workflow state (2.13) and its scores (2.11.22 to 2.11.25)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types with a meaning for outcomes and labels; fixed values.
VIOLATED = ("baseline_abuse.detected", "claim_validation.violated", "patch_contract.violated", "intent.violated")
EXPIRED = ("patch_contract.expired", "intent.expired")
BLOCKED = ("intent.queue_blocked", "workspace.conflict_detected")
VERIFIED = "patch_contract.verified"
CHANGE_CONTROL = (
    "intent.declared intent.checked intent.expanded intent.queued intent.promoted intent.queue_blocked intent.violated intent.expired "
    "patch_contract.verified patch_contract.violated patch_contract.expired patch_trail.computed claim_validation.completed "
    "claim_validation.violated review_receipt.created"
).split()
#: Labels that one event type alone gives.
TYPE_LABELS = {
    "scope_expanded": "intent.expanded", "queue_used": "intent.queued", "patch_trail_recorded": "patch_trail.computed", "receipt_issued": "review_receipt.created",
    "claim_validated": "claim_validation.completed", "claim_guard_failed": "claim_validation.violated", "foreign_conflict_seen": "workspace.conflict_detected",
    "recovered": "intent.promoted", "baseline_abuse_detected": "baseline_abuse.detected",
}
OUTCOME_SCORES = {"accepted": 100, "accepted_with_external_changes": 85, "partial": 55, "abandoned": 40, "blocked": 30, "violated": 20}
TIER_SCORES = {"verified": 100, "corrected": 90, "routine": 85, "partial": 60, "incident": 45}


def workflow_id(intent: Column, run: Column, explicit: Column, event: Column) -> Column:
    """2.13.1: the first that is there: intent:, run:, the explicit id, event:."""

    def tagged(tag: str, c: Column) -> Column:
        return F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(tag), c.cast("string")))

    return F.coalesce(tagged("intent:", intent), tagged("run:", run), F.when(F.coalesce(explicit, F.lit("")) != "", explicit), tagged("event:", event))


def event_core(family: Column, kind: Column, status: Column, facts: Column) -> Column:
    """2.13.2: canonical JSON of an event's bounded facts."""
    return F.to_json(F.struct(F.lit(1).alias("core_schema_version"), family.alias("event_family"), kind.alias("event_type"), status.alias("status"), facts.alias("facts")))


def _any(types: Column, wanted) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(w) for w in wanted]))


def outcome(types: Column, statuses: Column) -> Column:
    """2.13.4."""
    verified = F.array_contains(types, VERIFIED)
    return (
        F.when(_any(types, VIOLATED), "violated")
        .when(verified & F.array_contains(statuses, "accepted_with_external_changes"), "accepted_with_external_changes")
        .when(verified & F.array_contains(statuses, "accepted"), "accepted")
        .when(_any(types, EXPIRED), "abandoned")
        .when(_any(types, BLOCKED), "blocked")
        .otherwise("partial")
    )


def labels(types: Column, statuses: Column, result: Column, scope_clean: Column, hook: Column, memory: Column) -> Column:
    """2.13.5: sorted labels."""
    rules = {
        "change_control_workflow": _any(types, CHANGE_CONTROL),
        "analysis_observed": ~_any(types, CHANGE_CONTROL) & F.array_contains(types, "analysis.completed"),
        "verified_finish": result.startswith("accepted") & F.array_contains(types, VERIFIED),
        "scope_clean": scope_clean, "hook_blocked": hook, "memory_used": memory,
        "external_changes_accepted": F.array_contains(statuses, "accepted_with_external_changes"),
        **{label: F.array_contains(types, t) for label, t in TYPE_LABELS.items()},
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, label) for label, c in rules.items()])))


def tier(result: Column, found: Column, types: Column) -> Column:
    """2.13.6."""
    incident = (result == "violated") | _any(found, ("baseline_abuse_detected", "claim_guard_failed", "hook_blocked"))
    return (
        F.when(incident, "incident")
        .when(result == "partial", "partial")
        .when(result.startswith("accepted"), F.when(_any(types, ("patch_contract.violated", "intent.violated")), "corrected").otherwise("verified"))
        .otherwise("routine")
    )


def trajectories(events: DataFrame) -> DataFrame:
    """2.13.3 to 2.13.6: events (workflow_id, seq, event_type, status, severity, surface, tool,
    core, core_sha) folded to one row a workflow. Sets and counts are aggregated before
    the shuffle; hash mismatches are counted, not raised."""
    e = events.where("workflow_id IS NOT NULL")
    clean = (F.col("event_type") == "intent.checked") & F.col("status").isin("clean", "expanded")
    g = e.groupBy("workflow_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("types"), F.collect_set("status").alias("statuses"), F.count("*").alias("event_count"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_or(F.coalesce(clean, F.lit(False))).alias("_clean"),
        F.bool_or((F.col("surface") == "hook") & F.col("severity").isin("warn", "error")).alias("_hook"),
        F.bool_or(F.col("tool").startswith("manage_engineering_memory")).alias("_memory"),
        F.count_if(F.col("severity").isin("warn", "error")).alias("incidents"), F.count_if(F.sha2("core", 256) != F.col("core_sha")).alias("hash_errors"),
    )
    g = g.withColumn("outcome", outcome(F.col("types"), F.col("statuses")))
    flags = [F.coalesce(c, F.lit(False)) for c in ("_clean", "_hook", "_memory")]
    g = g.withColumn("labels", labels(F.col("types"), F.col("statuses"), F.col("outcome"), *flags))
    return g.withColumn("tier", tier(F.col("outcome"), F.col("labels"), F.col("types"))).drop("_clean", "_hook", "_memory", "statuses")


def anomalies(t: DataFrame, elevated: int = 3) -> Column:
    """2.11.25 without a patch trail: array of (kind, severity)."""

    def tag(kind: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))

    o, ls, ts = F.col("outcome"), F.col("labels"), F.col("types")
    rules = [tag(f"outcome_{k}", s, o == k) for k, s in (("violated", "error"), ("blocked", "error"), ("abandoned", "warn"))]
    rules += [tag("quality_incident", "error", F.col("tier") == "incident"), tag("elevated_incidents", "warn", F.col("incidents") >= elevated)]
    rules += [tag(f"label_{k}", s, F.array_contains(ls, k)) for k, s in (("baseline_abuse_detected", "error"), ("claim_guard_failed", "error"), ("foreign_conflict_seen", "warn"), ("hook_blocked", "warn"))]
    rules.append(tag("incomplete_change_cycle", "warn", F.array_contains(ls, "change_control_workflow") & ~F.array_contains(ls, "verified_finish") & ~o.startswith("accepted")))
    rules.append(tag("missing_intent_clear", "warn", ~F.array_contains(ts, "intent.cleared") & F.array_contains(ts, VERIFIED)))
    return F.array_compact(F.array(*rules))


def scored(values: dict[str, int], key: Column, last: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(last))


def quality(t: DataFrame) -> DataFrame:
    """2.11.23: least of the outcome, tier, incident, anomaly and receipt scores."""
    t = t.withColumn("anomalies", anomalies(t))
    hits = F.aggregate("anomalies", F.lit(0), lambda s, a: s + F.when(a["severity"] == "error", 12).otherwise(5))
    receipt = F.when(F.array_contains("labels", "change_control_workflow") & ~F.array_contains("labels", "receipt_issued"), 85).otherwise(100)
    parts = [
        scored(OUTCOME_SCORES, F.col("outcome"), 50), scored(TIER_SCORES, F.col("tier"), 70), F.greatest(F.lit(0), F.lit(100) - F.col("incidents") * 10),
        F.greatest(F.lit(0), F.lit(100) - hits), receipt,
    ]
    return t.withColumn("quality_score", F.least(*parts).cast("int"))


def changed_workflows(events: DataFrame, watermark: int) -> DataFrame:
    """2.1.23, 2.13.8: all events of the workflows with one after the watermark."""
    ids = events.where(F.col("seq") > watermark).select(F.col("workflow_id").alias("_w")).distinct()
    return events.join(ids, F.col("workflow_id") == F.col("_w"), "left_semi")


def keep_latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """2.13.9, 2.9.10, 2.9.11: the last row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def patch_trails(events: DataFrame) -> DataFrame:
    """2.13.10: ordered fold of each workflow's events: files declared, files changed, and
    the scope status: changed files that were declared, unexpected ones, and the last
    verdict. The fold runs over the sorted events of one workflow."""
    item = F.struct("seq", "event_type", "path", "status")
    g = events.groupBy("workflow_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    zero = F.struct(F.array().cast("array<string>").alias("declared"), F.array().cast("array<string>").alias("changed"), F.lit("not_reached").alias("verify"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            F.when(x["event_type"].isin("intent.declared", "intent.expanded"), F.array_union(s["declared"], F.array(x["path"]))).otherwise(s["declared"]).alias("declared"),
            F.when(x["event_type"] == "intent.checked", F.array_union(s["changed"], F.array(x["path"]))).otherwise(s["changed"]).alias("changed"),
            F.when(x["event_type"] == VERIFIED, F.coalesce(x["status"], F.lit("unverified"))).otherwise(s["verify"]).alias("verify"),
        )

    g = g.select("workflow_id", F.aggregate("e", zero, step).alias("s"))
    return trail_sets(g.select("workflow_id", F.col("s.declared").alias("declared"), F.col("s.changed").alias("changed"), F.col("s.verify").alias("verify")))


def trail_sets(rows: DataFrame, cap: int = 20) -> DataFrame:
    """2.10.6: set algebra of declared and changed files, capped lists and a digest."""
    unexpected, untouched = F.array_sort(F.array_except("changed", "declared")), F.array_sort(F.array_except("declared", "changed"))
    return rows.select(
        "workflow_id", F.slice(F.array_sort(F.array_intersect("declared", "changed")), 1, cap).alias("in_scope"), F.slice(unexpected, 1, cap).alias("unexpected"),
        F.slice(untouched, 1, cap).alias("untouched"), "verify", F.when(F.size(unexpected) > 0, "violated").otherwise("clean").alias("scope_status"),
        F.sha2(F.concat_ws("|", F.array_join(F.array_sort("declared"), ","), F.array_join(F.array_sort("changed"), ","), "verify"), 256).alias("digest"),
    )


def staleness(records: DataFrame, batch: DataFrame, files: DataFrame) -> DataFrame:
    """2.13.11: records (key, path, fingerprint, status) against a new batch (key, fingerprint)
    and the files that exist: stale for the first reason that holds, else active; records
    the batch no longer has are historical."""
    b = batch.select(F.col("key").alias("bk"), F.col("fingerprint").alias("bf"))
    f = files.select(F.col("path").alias("fp")).distinct()
    j = records.join(b, F.col("key") == F.col("bk"), "left").join(f, F.col("path") == F.col("fp"), "left")
    reason = F.coalesce(F.when(F.col("fp").isNull(), "file_missing"), F.when(F.col("bk").isNotNull() & (F.col("bf") != F.col("fingerprint")), "fingerprint_changed"))
    new = F.when(reason.isNotNull(), "stale").when(F.col("bk").isNull(), "historical").otherwise("active")
    return j.select("key", F.col("status").alias("before"), new.alias("after"), F.coalesce(reason, F.lit("")).alias("reason"))


def vacuum(records: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    """2.13.13: records without those whose status has a retention that has passed."""
    expired = F.lit(False)
    for status, keep in days.items():
        expired = expired | ((F.col("status") == status) & (F.col("updated") < now - F.make_interval(days=F.lit(keep))))
    return records.where(~F.coalesce(expired, F.lit(False)))


def first_per_key(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """2.13.14: the smallest id of each key."""
    return rows.groupBy(*keys).agg(F.min(ident).alias(ident))


def flush_due(window: Column, forced: Column, last: Column, delta: Column, least: int, now: Column) -> Column:
    """2.13.15: at once if there is no window, if forced, at first or for a large delta; else
    when the fixed window after the last run is over."""
    return (window <= 0) | forced | last.isNull() | (delta >= least) | (now >= last + F.make_interval(secs=F.greatest(F.lit(1), window)))


def diff_rows(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """2.13.17: (key, action) insert, delete, replace or keep by digest."""
    o, n = old.select(F.col(key).alias("a"), F.col(digest).alias("da")), new.select(F.col(key).alias("b"), F.col(digest).alias("db"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("da") == F.col("db"), "keep").otherwise("replace")
    return o.join(n, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), action.alias("action"))


def context_coverage(scope: DataFrame, **sources: DataFrame) -> DataFrame:
    """2.13.19: share of scope paths (path) with rows in each source (path), half-even."""
    j = scope.select("path").distinct()
    for name, rows in sources.items():
        j = j.join(rows.select(F.col("path").alias(f"_{name}")).distinct(), F.col("path") == F.col(f"_{name}"), "left")
    return j.agg(F.count("*").alias("paths"), *[F.bround(F.count(f"_{n}") * F.lit(100.0) / F.count("*"), 2).alias(n) for n in sources])


def adaptive_batches(items: DataFrame, by: str, ident: str, tokens: str, max_items: int, max_padded: int) -> DataFrame:
    """2.9.19: items in order of (tokens, id) packed greedily: at most ``max_items`` and
    items times longest at most ``max_padded`` a batch. Each ``by`` group is one stream
    of rows; the fold keeps two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, longest, no = object(), 0, 0, 0
        for batch in batches:
            out = []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group:
                    group, n, longest, no = g, 0, 0, 0
                if n and (n + 1 > max_items or (n + 1) * max(longest, t) > max_padded):
                    n, longest, no = 0, 0, no + 1
                n, longest = n + 1, max(longest, t)
                out.append(no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[by, ident, tokens, "batch"])

    rows = items.select(by, ident, F.col(tokens).cast("long").alias(tokens)).repartition(by).sortWithinPartitions(by, tokens, ident)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"{by} {kinds[by]}, {ident} {kinds[ident]}, {tokens} long, batch int")


def export_lines(rows: DataFrame, shard: str, order: list[str], size: str, cap: int, record_cap: int) -> DataFrame:
    """2.2.8: greedy export: a record over the record cap is truncated away, one that would
    overflow the file is skipped while later smaller ones may still fit."""
    item = F.struct(*order, F.col(size).alias("size"))
    g = rows.groupBy(shard).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("truncated"), F.lit(0).cast("long").alias("skipped"))

    def step(s: Column, r: Column) -> Column:
        z = r["size"].cast("long")
        over, full = z > record_cap, s["used"] + z > cap
        return F.struct(
            F.when(~over & ~full, s["used"] + z).otherwise(s["used"]).alias("used"), (s["kept"] + F.when(~over & ~full, 1).otherwise(0)).alias("kept"),
            (s["truncated"] + F.when(over, 1).otherwise(0)).alias("truncated"), (s["skipped"] + F.when(~over & full, 1).otherwise(0)).alias("skipped"),
        )

    return g.select(shard, F.aggregate("_items", zero, step).alias("_sum")).select(shard, "_sum.used", "_sum.kept", "_sum.truncated", "_sum.skipped")
