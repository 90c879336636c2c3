"""The Python extractor as one Arrow stage, and the fact tables it fans out to (2.1, 2.3)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.functions.scalars import below, is_test_path, loc_bucket, module_key

#: Families and the fields of their rows.
FAMILIES = {
    "units": "qualname string, start int, end int, loc int, stmt_count int, fingerprint string, cc int, nesting int, raw_hash string, guards int, guard_profile string, guard_after_effect boolean, terminal string",
    "stmts": "qualname string, at int, start int, end int, hash string, is_assert boolean",
    "deps": "source string, target string, kind string, line int",
    "classes": "qualname string, start int, end int, cbo int, lcom4 int, methods int",
    "candidates": "qualname string, local_name string, kind string, start int, end int",
    "branches": "qualname string, signature string, start int, end int",
    "suppressions": "line int, rule string",
    "surfaces": "category string, name string, line int, qualname string, symbol string",
    "api": "qualname string, kind string, params array<string>",
    "calls": "caller string, callee string, resolved boolean, line int",
    "methods": "qualname string, class string, why string",
    "reach": "qualname string, framework string, edge_kind string, confidence string",
}
#: The other facts of a file: lists of names, and counts.
_NAMES = ("names", "qualnames")
_COUNTS = {"stats": "lines functions methods classes".split(), "adoption": "params annotated returns returns_annotated public documented".split()}
MAX_BYTES = 10 << 20
#: Files whose facts a worker holds at once.
FILES = 128


def _schema(wanted: frozenset[str]) -> str:
    names = [f"{k} array<string>" for k in _NAMES if k in wanted]
    counts = [f"{k} struct<{', '.join(f'{f}:int' for f in v)}>" for k, v in _COUNTS.items() if k in wanted]
    fields = [f"{k} array<struct<{', '.join(f'{f.split()[0]}:{f.split()[1]}' for f in v.split(', '))}>>" for k, v in FAMILIES.items() if k in wanted]
    return ", ".join(["path string, module string, ok boolean, error_kind string, error string", *names, *counts, *fields])


def extract(files: DataFrame, root: str, seconds: float = 30.0, families: tuple[str, ...] | None = None) -> DataFrame:
    """2.1.3, 2.1.4, 2.3.1: files (path, content) to one row each with all facts as arrays, or
    with those of some families (of ``FAMILIES``, names, qualnames, stats and adoption) alone.

    Files over 10 MiB, undecodable and unparsable ones, and those that take more than
    ``seconds`` of CPU time, become rows with an error kind.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    wanted = frozenset((*FAMILIES, *_NAMES, *_COUNTS) if families is None else families)
    schema: StructType = _parse_datatype_string(_schema(wanted))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in arrow]
    keys = {k: [f.split()[0] for f in v.split(", ")] for k, v in FAMILIES.items() if k in wanted}
    count_keys = {k: v for k, v in _COUNTS.items() if k in wanted}
    limit = FILES

    def one(path: str, module: str, content: bytes | None, test: bool) -> dict:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # long chains of operators nest deep
        from veinstone.functions.python_facts import facts, time_limit

        row = {"path": path, "module": module, "ok": False, "error_kind": None, "error": None}
        if content is None or len(content) > MAX_BYTES:
            return row | {"error_kind": "file_too_large" if content else "source_read_error"}
        try:
            with time_limit(seconds):
                found = facts(content.decode("utf-8"), module, test, wanted)
        except UnicodeDecodeError as e:
            return row | {"error_kind": "source_read_error", "error": str(e)[:200]}
        except (SyntaxError, ValueError, RecursionError, TimeoutError) as e:
            return row | {"error_kind": "parse_error", "error": str(e)[:200]}
        row |= {k: [dict(zip(keys[k], r, strict=True)) for r in found[k]] for k in keys}
        row |= {k: dict(zip(v, found[k], strict=True)) for k, v in count_keys.items()}
        return row | {"ok": True, **{k: list(found[k]) for k in _NAMES if k in wanted}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, limit) for b in batches for at in range(0, b.num_rows, limit)):
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(names, arrow, strict=True)], names=names)

    path = F.col("path")
    return files.select("path", module_key(path, root).alias("module"), "content", is_test_path(below(path, root)).alias("test")).mapInArrow(run, schema)


def family(facts: DataFrame, name: str) -> DataFrame:
    """One fact table: path and the fields of a family."""
    rows = facts.where("ok").select("path", F.explode(name).alias("f")).select("path", "f.*")
    return rows.withColumn("loc_bucket", loc_bucket(F.col("loc"))) if name == "units" else rows


def referenced(facts: DataFrame, name: str) -> DataFrame:
    """Distinct ``names`` or ``qualnames``."""
    return facts.where("ok").select(F.explode(name).alias("name")).distinct()


def statement_windows(facts: DataFrame, size: int, most: int, min_stmts: int) -> DataFrame:
    """2.3.11 to 2.3.13: windows of statement hashes of the functions that are long enough."""
    s = family(facts, "stmts").groupBy("path", "qualname").agg(F.array_sort(F.collect_list(F.struct("at", "start", "end", "hash"))).alias("s"))
    s = s.where((F.size("s") >= F.greatest(F.lit(size), F.lit(min_stmts))) & ~F.col("qualname").endswith("__init__"))
    w = s.select("path", "qualname", F.col("s"), F.explode(F.sequence(F.lit(1), F.least(F.size("s") - size + 1, F.lit(most)))).alias("i"))
    part = F.slice("s", F.col("i"), F.lit(size))
    hashes = F.transform(part, lambda x: x["hash"])
    return w.select(
        "path", "qualname", F.element_at(part, 1)["start"].alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"),
        F.array_join(hashes, "|").alias("block_hash"), F.sha1(F.array_join(hashes, "|")).alias("segment_hash"), F.sha1(F.array_join(F.array_sort(hashes), "|")).alias("segment_sig"),
    )


def suppressed(candidates: DataFrame, suppressions: DataFrame, rule: str = "dead-code") -> DataFrame:
    """2.3.29, 2.3.30: candidates with the flag ``suppressed``: a directive of the rule on
    their first line, or leading it."""
    s = suppressions.where(F.col("rule") == rule).select(F.col("path").alias("_p"), F.col("line").alias("_l")).distinct()
    j = candidates.join(s, (F.col("path") == F.col("_p")) & (F.col("start") == F.col("_l")), "left")
    return j.withColumn("suppressed", F.col("_l").isNotNull()).drop("_p", "_l")
