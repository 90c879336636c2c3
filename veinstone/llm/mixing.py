"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Only DataFrame functions. Each document draws an exponential key ``-ln(u) / w`` (u a
hash of its id in (0, 1), w its quality weight); within a source, documents are taken
by rising key, which is sampling by weight without replacement. A source first gives
as many complete epochs as its target holds, then documents by rising key until the
rest of the target is used up; the last of them is taken in part.

Prefix sums within a source are made digit by digit, so that a source with a third of
all rows never meets in one task, whatever the weights: the sums of a source's rows by
the key's first digit (4 096 values, aggregated before the shuffle) give the one digit
in which the target falls, the rows of that digit are split by the next one, and so
on, until a source has at most ``few`` rows left to sort. Documents with one key (a
repeated or missing id) are split by size, by text and at last by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.text import WORD_PATTERN
from veinstone.operators.windows import numbered, running_totals
from veinstone.session import cut_lineage, written

#: A table of sources or of boundary rows up to this many rows is broadcast.
BROADCAST_ROWS = 50_000
#: Rows of a source that are sorted at once.
FEW = 1000
#: Characters that prose has little of, and the marks that end its sentences.
NOISE, MARKS = "#*$%&|<>{}[]^~_=@0123456789", ".!?"
_KEYS = ("_k0", "_k1", "_k2", "_k3")
_SHIFTS = (48, 36, 24, 12, 0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.05 and 1: the product of the share of characters that are not noise (three
    times the noise counts), of lines that are no repeats, of sentence marks (one for 30
    words at least) and of length (60 words at least). 0.05 without text."""
    one, chars = F.lit(1.0), F.length(text)
    lines = F.split(text, "\n", -1)
    noise = one - F.least(one, F.lit(3.0) * (chars - F.length(F.translate(text, NOISE, ""))) / chars)
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    marks = F.least(one, (F.lit(30.0) * (chars - F.length(F.translate(text, MARKS, ""))) + F.lit(1.0)) / (size + F.lit(1.0)))
    length = F.least(one, (size + F.lit(10.0)) / F.lit(70.0))
    return F.when(chars > 0, F.greatest(F.lit(0.05), noise * fresh * marks * length)).otherwise(F.lit(0.05))


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """The exponential key in steps of 2**-50, below 2**60."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.floor(-F.log(u) / weight * F.lit(float(2**50)))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size -> and target: the total shared by the weights 1, 2, 3
    repeating over the sources by code point (null last), each stopping at
    ``most`` times its size, the excess reshared until none is above.

    Sorted by size per weight, the sources that stop are the first ones; the
    first source that fits its share at its place ends them.
    """
    big = "decimal(38,0)"
    t = numbered(sizes, [F.col("source").asc_nulls_last()], "place", "long")
    t = t.withColumn("w", ((F.col("place") - 1) % 3 + 1).cast(big)).withColumn("cap", (F.col("source_size") * most).cast(big))
    order = [(F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    t = running_totals(t, order, {"caps": F.col("cap"), "ws": F.col("w")})
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast(big).alias("all_size"), F.sum("w").cast(big).alias("all_w"))
    t = (
        t.join(F.broadcast(total))
        .withColumn("num", F.col("all_size") - F.col("caps").cast(big))
        .withColumn("den", F.col("all_w") - F.col("ws").cast(big))
        .withColumn("stops", F.col("num").cast("double") * F.col("w").cast("double") > F.col("cap").cast("double") * F.col("den").cast("double"))
    )
    t = cut_lineage(t)
    first = t.agg(F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("num"), F.col("den")))).alias("first"))
    share = F.col("first.num").cast("double") * F.col("w").cast("double") / F.col("first.den").cast("double")
    target = F.when(F.col("stops") | F.col("first").isNull(), F.col("cap").cast("double")).otherwise(share)
    return t.join(F.broadcast(first)).select("source", "source_size", target.alias("target"))


def with_keys(rows: DataFrame, text: Column, weight: Column | None = None) -> DataFrame:
    """rows (doc_id, source and more) and _size, the sort keys and _uid. ``weight``: a
    quality weight (above 0) in place of :func:`quality_weight`."""
    sized = rows.withColumn("_size", word_count(text))
    w = F.coalesce(weight, F.lit(0.05)) if weight is not None else quality_weight(text, F.col("_size"))
    return sized.withColumns(
        {
            "_k0": sampling_key(F.col("doc_id"), w), "_k1": F.col("_size"), "_k2": F.xxhash64(text).bitwiseAND(F.lit(2**60 - 1)),
            "_uid": F.monotonically_increasing_id(),
        }
    ).withColumn("_k3", F.col("_uid"))


def _digit(i: int) -> Column:
    return F.shiftright(F.col(_KEYS[i // len(_SHIFTS)]), _SHIFTS[i % len(_SHIFTS)]).bitwiseAND(F.lit(4095).cast("long"))


def _path(n: int | None = None) -> Column:
    """The first n digits of a row (all, if not given)."""
    return F.array(*[_digit(i) for i in range(len(_KEYS) * len(_SHIFTS) if n is None else n)]).cast("array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def plan_sources(light: DataFrame, most: int, few: int) -> DataFrame:
    """Per source (_src): source_size, target, epochs, rest, and the place where the rest
    falls: the digits ``edge`` (none if the rest is nothing or everything) under which at
    most ``few`` rows are left, and the sizes ``before`` them."""
    sums = cut_lineage(light.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"), F.count("*").alias("n")))
    targets = source_targets(sums.select("source", "source_size"), most)
    targets = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    ).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long"))
    counts = sums.select(F.col("source").alias("_s"), "n")
    state = targets.join(counts, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_src"), "source_size", "target", "epochs", "rest", "n", F.lit(0).cast("long").alias("before"),
        F.when((F.col("rest") > 0) & (F.col("rest") < F.col("source_size")), F.array().cast("array<long>")).alias("edge"),
    )
    state = cut_lineage(state)
    for depth in range(len(_KEYS) * len(_SHIFTS)):
        wide = (F.col("edge").isNotNull()) & (F.col("n") > few)
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        rows = light.join(_small(open_.select("_src", "edge")), F.col("source").eqNullSafe(F.col("_src")) & (_path(depth) == F.col("edge")))
        by_digit = rows.groupBy(F.col("_src").alias("_s"), _digit(depth).alias("digit")).agg(F.sum("_size").alias("s"), F.count("*").alias("rows"))
        upto = Window.partitionBy("_s").orderBy("digit")
        found = by_digit.withColumn("after", F.sum("s").over(upto)).join(open_.select("_src", F.col("before").alias("b"), F.col("rest").alias("r")), F.col("_s").eqNullSafe(F.col("_src")))
        found = found.where(F.col("b") + F.col("after") > F.col("r")).groupBy("_s").agg(F.min(F.struct("digit", (F.col("b") + F.col("after") - F.col("s")).alias("before"), "rows")).alias("x"))
        deeper = open_.join(found, F.col("_src").eqNullSafe(F.col("_s"))).select(
            "_src", "source_size", "target", "epochs", "rest", F.col("x.rows").alias("n"), F.col("x.before").alias("before"), F.array_append("edge", F.col("x.digit")).alias("edge")
        )
        state = cut_lineage(state.where(~wide).unionByName(deeper), state)
    return state


def take(keyed: DataFrame, most: int = 3, few: int = FEW) -> DataFrame:
    """Rows of :func:`with_keys` (written) and source_size, target, taken (all prefixed by _):
    rows before their source's edge are taken once more than the complete epochs, rows
    after it are not, rows under it by their running sum."""
    light = keyed.select("source", "_size", "_uid", *_KEYS)
    plan = plan_sources(light, most, few)
    small_plan = _small(plan)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(small_plan, F.col("source").eqNullSafe(F.col("_src"))).withColumn("_here", F.slice(_path(), 1, F.greatest(F.lit(0), F.size("edge"))))

    order = Window.partitionBy("_src").orderBy(*_KEYS).rowsBetween(Window.unboundedPreceding, -1)
    close = placed(light).where(F.col("_here") == F.col("edge"))
    running = F.col("before") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    close = cut_lineage(close.select(F.col("_uid").alias("_u"), F.least(F.col("_size"), F.greatest(F.lit(0), F.col("rest") - running)).alias("_part")))
    rows = placed(keyed)
    at_edge = F.coalesce(F.col("_here") == F.col("edge"), F.lit(False))
    whole = (F.col("edge").isNull() & (F.col("rest") > 0)) | F.coalesce(F.col("_here") < F.col("edge"), F.lit(False))
    plain = rows.where(~at_edge).withColumn("_more", F.when(whole, F.col("_size")).otherwise(F.lit(0)))
    under = rows.where(at_edge).join(_small(close), F.col("_uid") == F.col("_u")).withColumn("_more", F.col("_part")).drop("_u", "_part")
    return (
        plain.unionByName(under)
        .withColumn("_taken", F.col("epochs") * F.col("_size") + F.col("_more").cast("long"))
        .withColumnsRenamed({"source_size": "_source_size", "target": "_target", "epochs": "_epochs"})
        .drop("_src", "edge", "before", "rest", "n", "_here", "_uid", *_KEYS)
    )


def mix_sizes(docs: DataFrame, few: int = FEW) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Null text has size 0; null source is a source of its own, ordered last; null
    doc_id draws one fixed key; repeated rows are sampled each; a source without
    words has target 0; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "source")
    keyed = written(with_keys(rows, F.col("text")).drop("text"))
    return take(keyed, few=few).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
    )


def mix_documents(docs: DataFrame, few: int = FEW) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: one row for each whole copy that
    is taken and, for a document taken in part, one row with its first words
    (n_chars follows, if there is such a column).

    Nulls, repeated rows and empty tables as in :func:`mix_sizes`; texts without words are
    never taken; other columns are kept. The texts are read twice: once for sizes and
    keys, and once, from the table written then, for the rows that are taken.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source")  # so that no column name clashes
    rows = take(written(with_keys(packed, F.col("_row.text").cast("string"))), few=few)
    split = F.col("_more").between(F.lit(1), F.col("_size") - 1)
    copies = F.col("_epochs") + F.when((F.col("_size") > 0) & (F.col("_more") == F.col("_size")), 1).otherwise(0)
    words = F.regexp_extract_all("_row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD_PATTERN}"), F.lit(0))
    text = F.array_join(F.slice(words, F.lit(1), F.col("_more").cast("int")), "")
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    whole = F.when(F.col("_size") > 0, F.array_repeat(F.col("_row"), copies.cast("int"))).otherwise(F.array().cast(f"array<{dict(rows.dtypes)['_row']}>"))
    return rows.select(F.explode(F.when(split, F.array_append(whole, row)).otherwise(whole)).alias("_row")).select("_row.*")


ORACLE = r"""
WITH c AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST(length(text) AS DOUBLE) AS chars,
    CAST(length(translate(text, '#*$%&|<>{}[]^~_=@0123456789', '')) AS DOUBLE) AS clean, CAST(length(translate(text, '.!?', '')) AS DOUBLE) AS unmarked, string_split(text, chr(10)) AS lines
  FROM documents
), g AS (
  SELECT doc_id, source, size, CASE WHEN chars > 0 THEN greatest(0.05::DOUBLE, (1::DOUBLE - least(1::DOUBLE, 3::DOUBLE * (chars - clean) / chars)) * (CAST(len(list_distinct(lines)) AS DOUBLE) / len(lines))
    * least(1::DOUBLE, (30::DOUBLE * (chars - unmarked) + 1::DOUBLE) / (size + 1::DOUBLE)) * least(1::DOUBLE, (size + 10::DOUBLE) / 70::DOUBLE)) ELSE 0.05::DOUBLE END AS weight
  FROM c
), d AS (
  SELECT doc_id, source, size, floor(-ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight * 1125899906842624::DOUBLE) AS k
  FROM g
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s
), p AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS den
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT *, CAST(num AS DOUBLE) * w > CAST(cap AS DOUBLE) * den AS stops FROM p
), f AS (
  SELECT num, den FROM q WHERE NOT stops ORDER BY cap / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN stops OR (SELECT count(*) FROM f) = 0 THEN CAST(cap AS DOUBLE)
         ELSE CAST((SELECT num FROM f) AS DOUBLE) * w / CAST((SELECT den FROM f) AS DOUBLE) END AS target
  FROM q
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t
), x AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    CAST(floor(e.target - e.epochs * e.source_size + 0.5) AS BIGINT) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken
FROM x
"""
