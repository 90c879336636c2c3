"""Report documents and renderers (2.2). Tables stay distributed until they are rendered;
a rendered report is for people and small by nature."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row: all rows of a table as an ordered array of structs with sorted keys."""
    cols = sorted(df.columns)
    item = F.struct(*[F.col(c).alias(c) for c in order], F.struct(*cols).alias("_row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_row"]).alias(name))


def document(sections: dict[str, tuple[DataFrame, list[str]]], meta: dict[str, str]) -> DataFrame:
    """2.2.1, 2.2.2: one row with the canonical JSON and its SHA-256; keys are sorted."""
    out = None
    for name in sorted(sections):
        df, order = sections[name]
        s = section(df, name, order)
        out = s if out is None else out.join(s)
    body = F.to_json(F.struct(*sorted(sections)), {"ignoreNullFields": "false"})
    info = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(meta.items()) for x in kv]))
    return out.select(F.concat(F.lit('{"meta":'), info, F.lit(',"sections":'), body, F.lit("}")).alias("document"), F.sha2(body, 256).alias("digest"))


def save_sections(sections: dict[str, tuple[DataFrame, list[str]]], folder: str) -> None:
    """2.2.3 for any size: each section as JSON lines in order, written by the executors; the
    one-row document above is for reports that people read."""
    for name, (df, order) in sections.items():
        df.select(*sorted(df.columns)).orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder.rstrip('/')}/{name}")


def to_json(doc: DataFrame) -> str:
    """2.2.3."""
    row = doc.collect()[0]
    return json.dumps(json.loads(row.document) | {"digest": row.digest}, indent=2, sort_keys=True, ensure_ascii=False)


def to_text(doc: DataFrame) -> str:
    """2.2.4."""
    body = json.loads(doc.collect()[0].document)
    out = []
    for name, rows in body["sections"].items():
        out += [f"{name} ({len(rows)})", *[f"  - {', '.join(f'{k}={v}' for k, v in r.items())}" for r in rows], ""]
    return "\n".join(out)


def to_markdown(doc: DataFrame) -> str:
    """2.2.5: a table for each section, with anchors."""
    body = json.loads(doc.collect()[0].document)
    out = []
    for name, rows in body["sections"].items():
        out.append(f'## {name} <a id="{name}"></a>\n')
        if rows:
            keys = list(rows[0])
            out += ["| " + " | ".join(keys) + " |", "|" + " --- |" * len(keys)]
            out += ["| " + " | ".join(str(r[k]).replace("|", "\\|") for k in keys) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def to_html(doc: DataFrame) -> str:
    """2.2.7: one file, without scripts."""
    body = json.loads(doc.collect()[0].document)
    parts = []
    for name, rows in body["sections"].items():
        keys = list(rows[0]) if rows else []
        head = "".join(f"<th>{html.escape(k)}</th>" for k in keys)
        rest = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[k]))}</td>" for k in keys) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rest}</table>")
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>" + "".join(parts) + "</body></html>"


def sarif(findings: DataFrame) -> DataFrame:
    """2.2.6: one row with a SARIF 2.1.0 log of (rule, level, message, path, line, key, novelty):
    rules and artifacts are numbered by rank, results ordered by rule, path and line."""
    rules = F.array_sort(F.collect_set("rule"))
    paths = F.array_sort(F.collect_set("path"))
    item = F.struct("rule", "path", "line", "level", "message", "key", "novelty")
    g = findings.agg(rules.alias("rules"), paths.alias("paths"), F.array_sort(F.collect_list(item)).alias("items"))
    result = lambda x: F.struct(
        x["rule"].alias("ruleId"), (F.array_position(F.col("rules"), x["rule"]) - 1).alias("ruleIndex"), x["level"].alias("level"), F.struct(x["message"].alias("text")).alias("message"),
        F.when(x["novelty"] == "new", "new").otherwise("unchanged").alias("baselineState"), F.struct(x["key"].alias("primary")).alias("partialFingerprints"),
        F.array(F.struct(F.struct(F.struct(x["path"].alias("uri"), (F.array_position(F.col("paths"), x["path"]) - 1).alias("index")).alias("artifactLocation"), F.struct(x["line"].alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    driver = F.struct(F.lit("veinstone").alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"), F.transform("paths", lambda p: F.struct(F.struct(p.alias("uri")).alias("location"))).alias("artifacts"), F.transform("items", result).alias("results")
    )
    return g.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def baseline(groups: DataFrame, key: str) -> DataFrame:
    """2.2.10, 2.2.11: sorted unique keys and their digest, one row."""
    ids = F.array_sort(F.collect_set(key))
    return groups.agg(ids.alias("ids")).select("ids", F.sha2(F.array_join("ids", "\n"), 256).alias("digest"))


def trusted(saved: DataFrame) -> bool:
    """Whether a saved baseline still has its digest."""
    row = saved.select((F.sha2(F.array_join("ids", "\n"), 256) == F.col("digest")).alias("ok")).first()
    return bool(row and row.ok)


def append_events(events: DataFrame, folder: str) -> None:
    """2.2.13, 2.2.14: append by day; retention drops whole partitions."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)
