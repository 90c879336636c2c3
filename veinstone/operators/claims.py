"""Claims of a text against a stored run (2.10.11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text must not say next to a citation, by pattern; fixed values.
OVERCLAIMS = {
    "security_overclaim": ("vulnerab", "exploit", "attack", "cve", "threat", "security flaw", "security bug", "security issue"),
    "gate_overclaim": ("fail", "block", "gate", "ci ", "ci-", "pipeline", "break build", "must fix", "blocking"),
    "regression_overclaim": ("new ", "regress", "introduc", "just appeared", "added", "caused by", "broke"),
    "dead_code_certainty": ("dead", "unused", "unreachable", "remove", "delete", "safe to remove", "definitely dead"),
    "fix_overclaim": ("fixed", "resolved", "eliminated", "removed the", "cleaned up", "refactored away", "no longer"),
}
SCOPE = (
    "no structural regression", "no regressions", "regression-free", "structural verification", "structurally verified", "all checks passed", "code quality verified",
)
#: Words that take a claim back if at most four words stand between.
NEGATION = r"(?:cannot|can't|can not|does not|doesn't|do not|don't|never|not)\s+(?:\w+\s+){0,4}$"
RADIUS = 80


def says(window: Column, words: tuple[str, ...]) -> Column:
    """The first of some words that a lower-case window holds without a negation before it."""
    hits = [F.when(F.contains(window, F.lit(w)) & ~F.regexp_like(F.substring_index(window, w, 1), F.lit(NEGATION)), F.lit(w)) for w in words]
    return F.coalesce(*hits)


def citations(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """(text_id, id, family, at, window): places of finding ids in texts (text_id, text), with the
    sentence around each, at most 80 characters to either side.

    Ids are cut out of the text as runs of id characters and joined, so that no text is
    compared with all findings."""
    token = r"[A-Za-z0-9_:][A-Za-z0-9_:./-]*[A-Za-z0-9_:]"
    pieces = F.split("text", token, -1)
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(F.regexp_extract_all("text", F.lit(token), F.lit(0)))).alias("gap"), F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("id"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<id:string,at:int>>").alias("found"))
    placed = F.aggregate(
        steps, start,
        lambda acc, x: F.struct(
            (acc["end"] + F.length(x["gap"]) + F.length(x["id"])).alias("end"), F.array_append(acc["found"], F.struct(x["id"].alias("id"), (acc["end"] + F.length(x["gap"])).alias("at"))).alias("found")
        ),
        lambda acc: acc["found"],
    )
    each = texts.select("text_id", "text", F.explode(placed).alias("c")).select("text_id", "text", "c.id", "c.at")
    before = F.element_at(F.split(F.substring("text", F.greatest(F.lit(1), F.col("at") - RADIUS + 1), F.least(F.lit(RADIUS), F.col("at"))), r"[.!?\n]"), -1)
    after = F.element_at(F.split(F.substring("text", F.col("at") + F.length("id") + 1, F.lit(RADIUS)), r"[.!?\n]"), 1)
    found = each.join(findings.select("id", "family"), "id")
    return found.select("text_id", "id", "family", "at", F.lower(F.concat(before, F.col("id"), after)).alias("window"))


def violations(cited: DataFrame, findings: DataFrame, compared: bool) -> DataFrame:
    """(text_id, id, pattern, word): what is said of a finding (id, family, confidence, novelty,
    reachable, report_only) beyond what the run shows: a security surface called a flaw, a
    report-only family called a gate, a known one called new, a dead symbol of less than
    high confidence or that a framework reaches called dead, and one that is still there
    called fixed."""
    f = findings.select("id", *[c for c in ("confidence", "novelty", "reachable", "report_only")])
    j = cited.join(f, "id")
    rules = {
        "security_overclaim": F.col("family") == "security_surfaces", "gate_overclaim": F.col("report_only"),
        "regression_overclaim": (F.col("novelty") == "known") | F.lit(not compared), "dead_code_certainty": (F.col("family") == "dead_code") & ((F.col("confidence") != "high") | F.col("reachable")),
        "fix_overclaim": F.lit(True),
    }
    found = [F.struct(F.lit(p).alias("pattern"), F.when(rules[p], says(F.col("window"), OVERCLAIMS[p])).alias("word")) for p in OVERCLAIMS]
    return j.select("text_id", "id", F.explode(F.array(*found)).alias("v")).where("v.word IS NOT NULL").select("text_id", "id", "v.pattern", "v.word").distinct()


def text_violations(texts: DataFrame, structural: bool, health_delta: int | None) -> DataFrame:
    """(text_id, pattern, word): claims about the whole change: verified structure without such a
    verification, or while health fell."""
    word = says(F.lower(F.coalesce("text", F.lit(""))), SCOPE)
    wrong = not structural or (health_delta is not None and health_delta < 0)
    return texts.select("text_id", F.lit("structural_scope").alias("pattern"), word.alias("word")).where(F.col("word").isNotNull() & F.lit(wrong))


def warnings(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """(text_id, warning): texts without a citation, and short ids of no finding."""
    none = texts.join(cited.select("text_id").distinct(), "text_id", "left_anti").select("text_id", F.lit("no_citations").alias("warning"))
    short = texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([Ff]-[0-9]+)\b"), F.lit(1))).alias("id"))
    short = short.join(cited.select("text_id", "id"), ["text_id", "id"], "left_anti").select("text_id", F.concat(F.lit("unknown_id:"), F.col("id")).alias("warning")).distinct()
    return none.unionByName(short)
