"""Chat formatting with cumulative-snapshot collapse.

Logging systems store a conversation again after every turn, so shorter logged
conversations are prefixes of longer ones. Each turn's hash depends on its
position; a conversation's rolling prefix hash after turn t is the sum of its first
t turn hashes (four running 32-bit sums, 128 bits together). A conversation
whose whole hash is a prefix hash of a longer one is dropped by anti-join; of
equal conversations the smallest conv_id stays. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut_lineage

_SUMS = ["a", "b", "c", "d"]


def _half_sums(seed: int) -> list:
    """Low and high halves of a 64-bit hash of (position, role, text), nulls told apart."""
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    h = F.xxhash64(F.lit(seed), F.col("pos"), *parts)
    return [h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(h, 32)]


def conversations_with_prefixes(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, prefixes (pos, a, b, c, d) and turns in order."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")).withColumn("pos", F.row_number().over(order))
    halves = dict(zip(_SUMS, _half_sums(1) + _half_sums(2), strict=True))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns(halves).withColumns({c: F.sum(c).over(running) for c in _SUMS})
    one = F.struct("pos", *_SUMS, "role", "text")
    return t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(one)).alias("turns"))


def render(turns_col: str = "turns"):
    """<|im_start|>role, newline, text, <|im_end|>, newline for each turn. A null role
    is written as ``unknown``, a null text as empty; the two markers inside a text
    are opened by a space so that a text cannot end its turn."""
    return F.array_join(
        F.transform(
            turns_col,
            lambda t: F.concat(
                F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"),
                F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|im_"), F.lit("<| im_")), F.lit("<|im_end|>\n"),
            ),
        ),
        "",
    )


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of every maximal conversation.

    Turns are ordered by (turn, role, text), null first; repeated rows are turns
    of their own; null conv_id is one conversation; n_copies counts the equal
    conversations that the row stands for. An empty table gives no rows. Other
    columns are ignored.
    """
    convs = cut_lineage(conversations_with_prefixes(turns))
    key = ["pos", *_SUMS]
    last = F.element_at("turns", -1)
    shorter = (
        convs.select(F.explode(F.expr("slice(turns, 1, size(turns) - 1)")).alias("t")).select(*[F.col(f"t.{k}") for k in key]).distinct()
    )
    whole = (
        convs.select("conv_id", *[last[k].alias(k) for k in key])
        .groupBy(*key)
        .agg(F.min("conv_id").alias("keep"), F.count("*").alias("n_copies"))
        .join(shorter, key, "left_anti")
        .select("keep", "n_copies")
    )
    return convs.join(whole, F.col("conv_id").eqNullSafe(F.col("keep"))).select("conv_id", "n_turns", "n_copies", render().alias("rendered"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS x,
    CAST(count(*) AS BIGINT) AS n_turns
  FROM conversations GROUP BY conv_id
), p AS (
  SELECT DISTINCT x[1:i] AS px FROM (SELECT x, unnest(range(1, n_turns)) AS i FROM c)
), k AS (
  SELECT min(conv_id) AS conv_id, n_turns, CAST(count(*) AS BIGINT) AS n_copies, x FROM c GROUP BY x, n_turns
)
SELECT conv_id, n_turns, n_copies,
  array_to_string(list_transform(x, lambda e: '<|im_start|>' || coalesce(e.r, 'unknown') || chr(10) || replace(coalesce(e.t, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM k ANTI JOIN p ON k.x = p.px
"""
