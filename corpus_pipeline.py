"""The corpus pipeline: operators of ``veinstone.llm`` one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs; all but the last return the columns of
``documents``. In every stage other columns are kept as they are, repeated rows are
rows of their own, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm import minhash, mixing, packing, quality, secrets
from veinstone.llm.queries import tokenizer_path
from veinstone.session import cut_lineage, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that lose too much are rejected, and so are null,
    empty and short texts."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five words, 80 %); texts without
    words and rows without a doc_id stay, rows that repeat a doc_id stay or go together."""
    return minhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; null and empty texts stay as they are."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, taken once or left out, by their source's target; a null source
    is one of its own, texts without words are never taken."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; null and empty texts are their end token alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Tokenisation has no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the lineage cut between them. A stage's rows go once
    the next one's are written."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
