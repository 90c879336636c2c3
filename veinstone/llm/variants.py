"""Spelling variants by a symmetric-delete join.

Every word emits itself and its single deletions. Two words at distance one meet
under a shared key: a word that is another one's deletion (one letter inserted), or two
words with the same deletion. The latter differ by one replaced letter exactly if the
deletion is at the same place, so a deletion is keyed by its text and its place (a
deletion inside a run of equal letters has several places, one text). All words of one
(text, place) differ by that letter alone: such a group has at most one word a letter of
the alphabet, its members' counts are the group's size less one, and the two most
frequent members answer for all. No pairs are ever made.

Keys of over ``LONGEST`` code points are replaced by a 128-bit sum of hashed letters and
places, from which a letter is taken out in one step; so a word of any length emits rows
of bounded size, in time that grows with its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.text import give_back, mixed, sliced_by_bytes
from veinstone.session import cut_lineage, drop_checkpoint, small

#: Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. In Latin-1, all other
#: characters become spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
LONGEST = 200
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Words that a task counts before it hands its counts on.
HELD = 400_000


@dataclass(frozen=True)
class Spelling:
    """Which words are grouped: least length and occurrences, and how many times as frequent a
    form is. ``slip_every``: an occurrence whose hash it divides loses a letter (0: none)."""

    least_chars: int = 7
    least_n: int = 2
    ratio: int = 10
    slip_every: int = 0


def _occurrences(doc_id: str | None, text: str, how: Spelling) -> Iterator[tuple[bytes, int]]:
    """The words of one text in Latin-1, with counts, after slips."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        if len(run) < how.least_chars:
            continue
        if how.slip_every:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
            if h % how.slip_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < how.least_chars:
                    continue
        yield run, n


def word_counts(docs: DataFrame, how: Spelling) -> DataFrame:
    """(word, n) of whole texts: every task adds up what it has read, then Spark adds these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in sliced_by_bytes(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    for word, n in _occurrences(doc_id, text.as_py(), how):
                        held[word] += n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        yield out()
        held.clear()
        give_back()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= how.least_n)


def _sums(word: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both seeds: sums of the letters before each place, and of those after it moved down."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    at = np.arange(len(letters), dtype=np.uint64)
    found = []
    for seed in SEEDS:
        here = mixed((letters << np.uint64(40)) + at + seed)
        moved = mixed((letters << np.uint64(40)) + at - np.uint64(1) + seed)
        before = np.concatenate([[np.uint64(0)], np.cumsum(here)])
        found.append((before, np.concatenate([np.cumsum(moved[::-1])[::-1], [np.uint64(0)]])))
    return found


def named(word: str) -> str:
    """The word, or its 128-bit name if it is long."""
    if len(word) <= LONGEST:
        return word
    return "\0" + "".join(f"{int(before[-1]):016x}" for before, _ in _sums(word))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([named(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(0)], names=["name", "full"])


def deletions(word: str) -> tuple[list[str], list[bool]]:
    """The name of the word without each letter, and whether it is the first place with that text."""
    n = len(word)
    first = [i == 0 or word[i] != word[i - 1] for i in range(n)]
    if n - 1 <= LONGEST:
        return [word[:i] + word[i + 1 :] for i in range(n)], first
    halves = [before[:-1] + after[1:] for before, after in _sums(word)]
    return [f"\0{a:016x}{b:016x}" for a, b in zip(*(h.tolist() for h in halves), strict=True)], first


KEYS = "key string, place int, first boolean, word string, n long"


def _keys(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    key: list[str] = []
    place: list[np.ndarray] = []
    first: list[bool] = []
    word: list[str] = []
    n: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        arrays = [pa.array(key, pa.string()), pa.array(np.concatenate(place)), pa.array(first), pa.array(word, pa.string()), pa.array(np.concatenate(n))]
        for x in (key, place, first, word, n):
            x.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["key", "place", "first", "word", "n"])

    for batch in batches:
        for w, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name, (less, starts) = named(w), deletions(w)
            key += [name, *less]
            place.append(np.arange(-1, len(less), dtype=np.int32))
            first += [False, *starts]
            word += [name] * (len(less) + 1)
            n.append(np.full(len(less) + 1, count, np.int64))
            if len(key) > rows:
                yield out()
    if key:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): how many words are at distance one, and the most frequent of
    them as (-n, word), ties to the smaller word. Long words appear by :func:`named`.

    A row is a word itself (place -1) or one of its deletions. Rows of one key and place lie
    together, by falling n; a deletion's key may also be a word."""
    rows = words.mapInArrow(_keys, KEYS).repartition("key")  # serves both windows
    one = F.struct((-F.col("n")).alias("minus"), "word")
    group, key = Window.partitionBy("key", "place"), Window.partitionBy("key")
    ordered = group.orderBy(F.desc("n"), "word")
    top = F.first(one).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select(
        "key", "place", "first", "word", "n",
        F.count("*").over(group).alias("alike"), F.when(F.row_number().over(ordered) > 1, top).otherwise(F.lead(one).over(ordered)).alias("other"),
    )
    own = F.col("place") == -1
    rows = rows.select(
        "word", "n", own.alias("own"), "alike", "other",
        F.count_if("first").over(key).alias("longer"), F.min(F.when(F.col("first"), one)).over(key).alias("best_longer"),
        F.max(own).over(key).alias("is_word"), F.min(F.when(own, one)).over(key).alias("shorter"), "first",
    )
    shorter = F.col("first") & F.col("is_word")
    found = rows.select(
        "word", "n", "own",
        F.when(F.col("own"), F.col("longer")).otherwise(F.col("alike") - 1 + shorter.cast("long")).alias("near"),
        F.when(F.col("own"), F.col("best_longer")).otherwise(F.least("other", F.when(shorter, F.col("shorter")))).alias("best"),
    ).where(F.col("own") | (F.col("near") > 0))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form (word, form): the last word that forms lead to.
    A round doubles the steps taken; n rises along them, so they end."""
    r = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not r.where("moved").isEmpty():
        on = r.select(F.col("word").alias("at"), F.col("root").alias("far"))
        step = r.join(on, F.col("root") == F.col("at"), "left")
        r = cut_lineage(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), r)
    return r.drop("moved")


def group_variants(docs: DataFrame, how: Spelling | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Null texts have no words, empty texts neither; a null doc_id counts as an empty one in the
    slips; repeated rows are counted each; among equally frequent near words the smallest in
    code-point order is the form; an empty table gives no rows. Other columns are ignored."""
    how = how or Spelling()
    words = cut_lineage(word_counts(docs, how))
    near = cut_lineage(near_words(words))
    form_n = -F.col("best.minus")
    has_form = F.coalesce(form_n >= how.ratio * F.col("n"), F.lit(False))
    linked = near.select("word", "n", "n_near", F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, form_n).alias("form_n"))
    r = roots(linked.where("form IS NOT NULL").select("word", "form"))
    out = linked.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    names = cut_lineage(words.where(F.length("word") > LONGEST).select("word").mapInArrow(_names, "name string, full string"))
    drop_checkpoint(words)
    names = small(names)
    for c in ("word", "form", "root"):  # long words get their text back
        out = out.join(names, F.col(c) == F.col("name"), "left").withColumn(c, F.coalesce("full", c)).drop("name", "full")
    return out


CRC32 = """
  tab AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
  )
"""


def crc32_of(text: str) -> str:
    """DuckDB expression: the unsigned crc32 of a text's UTF-8, by the table ``tab.t``."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def oracle(how: Spelling) -> str:
    return f"""
WITH RECURSIVE {CRC32}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents
), counted AS (
  SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= {how.least_chars} GROUP BY ALL
), hashed AS (
  SELECT run, n, {crc32_of("(d || ':' || run)")} AS h FROM counted, tab
), slipped AS (
  SELECT CASE WHEN h % {how.slip_every} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {how.least_chars} GROUP BY word HAVING sum(n) >= {how.least_n}
), gone AS (
  SELECT word, n, i, word[: i] || word[i + 2 :] AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.less = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (WHERE other_n = m) AS other
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM pairs) GROUP BY word
), linked AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {how.ratio} * n THEN other END AS form, CASE WHEN top >= {how.ratio} * n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), up AS (
  SELECT word, word AS far, 0 AS steps FROM linked
  UNION ALL SELECT u.word, l.form, u.steps + 1 FROM up u JOIN linked l ON u.far = l.word WHERE l.form IS NOT NULL
)
SELECT l.word, l.form, r.root, l.n, CAST(l.n_near AS BIGINT) AS n_near, l.form_n
FROM linked l JOIN (SELECT word, arg_max(far, steps) AS root FROM up GROUP BY word) r ON l.word = r.word
"""
