"""Quality gates, policy predicates and structural findings (2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2.10.3: gates in the order of their reasons: (name, state column, how it fails).
GATES = (
    ("complexity_threshold", "complexity_max", "above"), ("coupling_threshold", "coupling_max", "above"), ("cohesion_threshold", "cohesion_max", "above"),
    ("health_threshold", "health_score", "below"), ("dependency_cycles", "dependency_cycles", "any"), ("dead_code_high_confidence", "dead_high_confidence", "any"),
    ("new_high_risk_functions", "new_high_risk_functions", "any"), ("new_high_coupling_classes", "new_high_coupling_classes", "any"),
    ("new_dependency_cycles", "new_cycles", "any"), ("new_dead_code", "new_dead_code", "any"), ("health_regression", "health_delta", "negative"),
    ("typing_coverage_threshold", "typing_permille", "below"), ("docstring_coverage_threshold", "docstring_permille", "below"),
    ("typing_regression", "typing_delta", "negative"), ("docstring_regression", "docstring_delta", "negative"),
    ("api_breaking_changes", "api_breaking_changes", "any"), ("coverage_hotspots", "coverage_hotspots", "any"),
)


def evaluate(state: DataFrame, config: dict[str, float | bool]) -> DataFrame:
    """2.10.1 to 2.10.3: reasons of the configured gates that fail, then the clone gates, and
    the exit code 3 if there are any, else 0. State columns that are missing are 0."""

    def value(c: str) -> Column:
        return F.col(c) if c in state.columns else F.lit(0)

    reasons = []
    for name, column, how in GATES:
        if name in config:
            limit = config[name]
            failed = {"above": value(column) > limit, "below": value(column) < limit, "any": value(column) > 0, "negative": value(column) < 0}[how]
            reasons.append(F.when(failed, F.concat_ws(":", F.lit("metric"), F.lit(name))))
    if config.get("clone_new"):
        reasons.append(F.when(value("clone_new_count") > 0, "clone:new"))
    if "clone_threshold" in config:
        reasons.append(F.when(value("clone_total") > config["clone_threshold"], "clone:threshold"))
    out = state.withColumn("reasons", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"))
    return out.withColumn("exit_code", F.when(F.size("reasons") > 0, 3).otherwise(0))


#: 2.10.4: allowed growth by strictness; -1 is unlimited.
BUDGETS = {"strict": {"new_clones": 0, "new_cycles": 0, "complexity_growth": 0}, "relaxed": {"new_clones": 2, "new_cycles": 0, "complexity_growth": -1}}


def over_budget(strictness: str) -> Column:
    """2.10.4: names of the budgets that a change breaks."""
    return F.array_compact(F.array(*[F.when((F.lit(limit) >= 0) & (F.col(c) > limit), c) for c, limit in BUDGETS[strictness].items()]))


def baseline_abuse() -> Column:
    """2.10.5 over (before_fails, after_fails, updated, regressions, changed, intent)."""
    u, reg = F.col("updated"), F.col("regressions") > 0
    rules = {
        "baseline_changed_with_functional_code": u & (reg | (F.col("changed") > 0)), "baseline_updated_while_regressions_present": u & reg,
        "baseline_updated_without_intent": u & ~F.col("intent"), "ci_greened_by_accepting_debt": u & F.col("before_fails") & ~F.col("after_fails"),
    }
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


def drift(manifest: DataFrame, current: DataFrame, dirty: DataFrame) -> DataFrame:
    """2.10.8: (path, state): deleted, added, drifted (stat differs or newly dirty) or fresh."""
    m, c = manifest.select(F.col("path").alias("a"), F.col("stat").alias("sa")), current.select(F.col("path").alias("b"), F.col("stat").alias("sb"))
    d = dirty.select(F.col("path").alias("d")).distinct()
    j = m.join(c, F.col("a") == F.col("b"), "full_outer").join(d, F.coalesce("a", "b") == F.col("d"), "left")
    state = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when((F.col("sa") != F.col("sb")) | F.col("d").isNotNull(), "drifted").otherwise("fresh")
    return j.select(F.coalesce("a", "b").alias("path"), state.alias("state"))


def ownership(own: Column, now: Column) -> Column:
    """2.10.10 over (expires, lease, alive): six states."""
    lease = F.coalesce(F.col("lease") > now, F.lit(False))
    return (
        F.when(F.col("expires").isNull() | (F.col("expires") <= now), "expired")
        .when(own, F.when(lease, "own_active").otherwise("own_stale"))
        .when(~F.col("alive"), "recoverable")
        .otherwise(F.when(lease, "foreign_active").otherwise("foreign_stale"))
    )


def edit_allowed(intents: DataFrame) -> DataFrame:
    """2.10.9: whether an active, authorised intent of one's own exists, by repository."""
    return intents.groupBy("repo").agg(F.bool_or((F.col("state") == "own_active") & F.col("authorised")).alias("allowed"))


def dirty_class(in_scope: Column, evidence: Column, at_start: Column) -> Column:
    """2.10.7: attribution of a dirty path."""
    return F.when(at_start & ~evidence, "preexisting").when(in_scope & evidence, "own").when(in_scope, "unattributed_in_scope").when(evidence, "own_out_of_scope").otherwise("foreign")


def claim_flags(text: Column, negations: str = r"\b(?:no|not|never|without)\b[^.\n]{0,40}$") -> Column:
    """2.10.11: claims about structure that no negation just before takes back."""
    claims = {"claims_safe": "safe to (?:merge|delete)", "claims_tested": "(?:fully|all) tested", "claims_no_regression": "no regressions?"}
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p) & ~F.regexp_extract(low, f"^((?s).*?)(?:{p})", 1).rlike(negations), name) for name, p in claims.items()]))


def suitability(limits: dict[str, float]) -> Column:
    """2.10.12: sorted reasons against a profile (clusters, noise_ratio, dominant_ratio, items)."""
    rules = {
        "too_few_items": F.col("items") < limits["items"], "no_clusters": F.col("clusters") < 1, "too_noisy": F.col("noise_ratio") > limits["noise"],
        "one_dominates": F.col("dominant_ratio") > limits["dominant"], "too_many_clusters": F.col("clusters") > limits["clusters"],
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()])))


def without_reviewed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """2.10.19."""
    return findings.join(marks, ["run_id", "finding_id"], "left_anti")


def duplicate_branches(branches: DataFrame) -> DataFrame:
    """2.5.1, 2.5.3: signatures with two distinct spans at least in one function, most first."""
    distinct = branches.select("qualname", "signature", "start", "end").distinct()
    return distinct.groupBy("qualname", "signature").agg(F.count("*").alias("n"), F.min("start").alias("first_start")).where("n >= 2")


def cohort_drift(members: DataFrame, cohort: str, ident: str, profiles: list[str], least: int = 3) -> DataFrame:
    """2.5.4 to 2.5.7: members of cohorts of ``least`` that differ from the majority (ties
    to the smallest value) in a profile that has several values."""
    w = Window.partitionBy(cohort)
    r = members.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    fields = []
    for p in profiles:
        r = r.withColumn(f"_m_{p}", F.mode(p, True).over(w)).withColumn(f"_d_{p}", F.size(F.collect_set(p).over(w)))
        fields.append(F.when((F.col(f"_d_{p}") > 1) & (F.col(p) != F.col(f"_m_{p}")), F.lit(p)))
    return r.withColumn("drift_fields", F.array_sort(F.array_compact(F.array(*fields)))).where(F.size("drift_fields") > 0).select(cohort, ident, "drift_fields")


def structural_severity(kind: Column, n: Column, functions: Column) -> Column:
    """2.5.8."""
    cohort = kind.isin("guard_exit_divergence", "cohort_drift")
    return F.when(cohort, F.when((n >= 3) | (functions > 1), "critical").otherwise("warning")).otherwise(F.when((n >= 4) | (functions > 1), "warning").otherwise("info"))


def design_groups(units: DataFrame, classes: DataFrame, cycles: DataFrame) -> DataFrame:
    """2.5.10: complexity, coupling, cohesion and cycle findings in one table."""
    a = units.where("cc > 20").select(F.lit("complexity").alias("category"), F.col("qualname").alias("subject"), F.when(F.col("cc") > 40, "critical").otherwise("warning").alias("severity"))
    b = classes.where("cbo > 10").select(F.lit("coupling"), "qualname", F.lit("warning"))
    c = classes.where("lcom4 >= 4").select(F.lit("cohesion"), "qualname", F.lit("warning"))
    return a.union(b).union(c).union(cycles.select(F.lit("dependency"), "component", F.lit("critical")))


def instance_methods(methods: DataFrame) -> DataFrame:
    """2.5.11: by (path, class): methods and how many never use their instance, by reason."""
    kinds = ("candidate", "noop_stub", "dunder", "override")
    return methods.groupBy("path", "class").agg(F.count("*").alias("methods"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]).where("candidate > 0")


def findings_summary(findings: DataFrame) -> DataFrame:
    """2.5.12: total and zero-filled counts by family, severity and novelty."""
    sets = {"family": ("clone", "structural", "dead_code", "design"), "severity": ("critical", "warning", "info"), "novelty": ("new", "known")}
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, vs in sets.items() for v in vs])
