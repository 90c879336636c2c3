"""Command line: ``python -m veinstone.cli ROOT [options]``; see ``--help``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from veinstone.engine import Analysis, analyze
from veinstone.functions.scalars import below
from veinstone.operators import joins
from veinstone.session import build_session
from veinstone.sinks import report
from veinstone.sources import readers

FORMATS = {"json": report.to_json, "text": report.to_text, "markdown": report.to_markdown, "html": report.to_html}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinstone", description="Structural analysis of a source tree")
    p.add_argument("root")
    p.add_argument("--format", choices=[*sorted(FORMATS), "sarif"], default="text")
    p.add_argument("--output", help="file for the report, else standard output")
    p.add_argument("--sections", help="folder for the report's sections as JSON lines, of any size")
    p.add_argument("--cache", help="folder of facts; only new and changed files are read again")
    p.add_argument("--min-loc", type=int, default=10)
    p.add_argument("--min-stmt", type=int, default=6)
    p.add_argument("--entrypoints", help="project file whose scripts are reachable")
    p.add_argument("--coverage", help="coverage XML to join")
    p.add_argument("--baseline", help="folder of known clone groups")
    p.add_argument("--update-baseline", action="store_true", help="write the baseline folder")
    p.add_argument("--changed", action="append", default=[], metavar="PATH", help="report findings under these paths only")
    p.add_argument("--diff", help="file with one changed path a line, as --changed")
    p.add_argument("--fail-complexity", type=int)
    p.add_argument("--fail-coupling", type=int)
    p.add_argument("--fail-cohesion", type=int)
    p.add_argument("--fail-cycles", action="store_true")
    p.add_argument("--fail-dead-code", action="store_true")
    p.add_argument("--fail-threshold", type=int, help="most clone groups")
    p.add_argument("--fail-on-new", action="store_true", help="fail on clone groups that the baseline lacks")
    p.add_argument("--fail-coverage-hotspots", action="store_true", help="fail on risky functions that tests hardly reach")
    return p


def clone_news(run: Analysis, folder: str | None):
    """Clone groups with their novelty against a trusted baseline; all new without one."""
    groups = run.function_clones()
    if not folder or not Path(folder).exists():
        return groups.withColumn("novelty", F.lit("new"))
    saved = run.spark.read.parquet(folder)
    if not report.trusted(saved):
        raise ValueError(f"the baseline in {folder} was changed by hand")
    known = saved.select(F.explode("ids").alias("_id"))
    return groups.join(known, F.col("group_id") == F.col("_id"), "left").withColumn("novelty", F.when(F.col("_id").isNotNull(), "known").otherwise("new")).drop("_id")


def sarif_rows(run: Analysis, folder: str | None):
    """Findings with a place, in the columns that :func:`report.sarif` takes."""
    where = run.units.select("path", "qualname", "start").unionByName(run.classes().select("path", "qualname", "start"))
    where = where.groupBy(F.col("qualname").alias("subject")).agg(F.min(F.struct("path", "start")).alias("at"))
    f = run.findings().where(~F.col("family").isin("clone", "cycle")).join(where, "subject")
    level = F.when(F.col("family") == "dead_code", "note").otherwise("warning")
    a = f.select(F.col("family").alias("rule"), level.alias("level"), F.concat_ws(" ", "subject", F.col("value").cast("string")).alias("message"), below(F.col("at.path"), run.top).alias("path"), F.col("at.start").alias("line"), F.concat_ws(":", "family", "subject").alias("key"), F.lit("new").alias("novelty"))
    c = run.clone_members().join(clone_news(run, folder).select("group_id", "items", "novelty"), "group_id")
    b = c.select(F.lit("clone"), F.lit("warning"), F.concat_ws(" ", "qualname", F.lit("is one of"), F.col("items").cast("string")), below(F.col("path"), run.top), "start", F.concat_ws(":", "group_id", "qualname"), "novelty")
    return a.union(b)


def main(argv: list[str] | None = None) -> int:
    """Exit code 3 if a gate fails, 2 if the baseline is not to be trusted."""
    a = parser().parse_args(argv)
    spark = build_session("veinstone")
    entry = readers.entrypoint_refs(spark, Path(a.entrypoints).read_text(encoding="utf-8")) if a.entrypoints else None
    run = analyze(spark, a.root, min_loc=a.min_loc, min_stmt=a.min_stmt, entrypoints=entry, cache=a.cache)
    try:
        news = clone_news(run, a.baseline)
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    changed = [*a.changed, *(r.path for r in readers.changed_paths(spark, Path(a.diff).read_text(encoding="utf-8")).collect())] if a.diff else a.changed
    if a.format == "sarif":
        rows = sarif_rows(run, a.baseline)
        if changed:
            rows = joins.under_paths(rows, "path", spark.createDataFrame([(p.strip("/"),) for p in changed], "p string"), "p")
        text = report.sarif(rows).collect()[0].sarif
    else:
        text = FORMATS[a.format](run.report(changed))
    if a.sections:
        report.save_sections(run.sections(), a.sections)
    if a.output:
        Path(a.output).write_text(text, encoding="utf-8")
    else:
        print(text)
    limits = {"complexity_threshold": a.fail_complexity, "coupling_threshold": a.fail_coupling, "cohesion_threshold": a.fail_cohesion, "clone_threshold": a.fail_threshold}
    config: dict = {k: v for k, v in limits.items() if v is not None}
    config |= {k: True for k, on in (("dependency_cycles", a.fail_cycles), ("dead_code_high_confidence", a.fail_dead_code), ("clone_new", a.fail_on_new), ("coverage_hotspots", a.fail_coverage_hotspots)) if on}
    state = run.state().join(news.agg(F.count_if(F.col("novelty") == "new").alias("clone_new_count")))
    if a.coverage:
        state = state.join(run.coverage(readers.cobertura(spark, a.coverage)).agg(F.count_if(joins.is_coverage_hotspot()).alias("coverage_hotspots")))
    code = 0
    if config:
        from veinstone.operators import gates

        gate = gates.evaluate(state, config).collect()[0]
        for reason in gate.reasons:
            print(reason, file=sys.stderr)
        code = int(gate.exit_code)
    if a.update_baseline and a.baseline:
        report.baseline(run.function_clones(), "group_id").write.mode("overwrite").parquet(a.baseline)
    return code


if __name__ == "__main__":
    sys.exit(main())
