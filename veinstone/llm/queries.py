"""The registered training-data queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm import chat, contamination, html, langid, minhash, mixing, packing, quality, repair, secrets, substrings, topk, variants
from veinstone.session import read_table

#: The SQL of the queries that SQL can express; filled below.
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens. The other two capacities are
    set where they cannot bind, so that they only steer the choice."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.assess(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages that a smaller doc_id has."""
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(read_table(spark, sf_dir, "pages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 best neighbours of every 20th vector."""
    q = topk.quantize(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(q, q.where("vec_id % 20 = 0"), 20)


ORACLES["op8_exact_top_k"] = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

ORACLES["op2_quality_rules"] = quality.ORACLE
ORACLES["op4_substring_dedup"] = substrings.oracle()
ORACLES["op5_chat_formatting"] = chat.ORACLE
ORACLES["op7_secret_scans"] = secrets.ORACLE
ORACLES["op9_minhash_dedup"] = minhash.oracle()
ORACLES["op10_source_mixing"] = mixing.ORACLE


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles are 85 % alike."""
    return minhash.link(read_table(spark, sf_dir, "documents"), minhash.Linking(words=3, percent=85))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3."""
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


#: The variants of the query are made by the contract's own slips, one occurrence in 31.
SPELLING = variants.Spelling(slip_every=31)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return variants.group_variants(read_table(spark, sf_dir, "documents"), SPELLING)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items of which it holds ten words in a row."""
    return contamination.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage, with its faults and its cheapest repair."""
    return repair.repair(repair.damage(read_table(spark, sf_dir, "conversations")))


ORACLES["op11_spelling_variants"] = variants.oracle(SPELLING)
ORACLES["op12_benchmark_decontamination"] = contamination.oracle()
ORACLES["op13_conversation_repair"] = repair.ORACLE

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_language_id, op4_substring_dedup, op5_chat_formatting, op6_html_extraction, op7_secret_scans, op8_exact_top_k, op9_minhash_dedup, op10_source_mixing, op11_spelling_variants, op12_benchmark_decontamination, op13_conversation_repair)}
