"""Substring dedup by prefix-partitioned suffix trees.

A passage counts as repeated when a window of ``width`` words also starts in a
document with a smaller id: two suffixes whose first ``width`` words are the same meet
in an internal node of that depth, and maximal repeats are the unions of neighbouring
suffixes that sit in such nodes. So trees are built to that depth.

1. Suffixes are partitioned by their first words: by the smallest hashed ``gram``-word
   string in the first ``width`` words (the anchor). Equal prefixes have equal anchors,
   and neighbouring suffixes mostly share theirs, so that a run of about twenty
   suffixes travels as one piece of text and not as twenty of ``width`` words each.
   Prefix frequencies are counted first; what only one document has is dropped
   before any suffix is sent, and runs with the same words are one run from then on.
2. Groups of more than ``group`` words are split by longer and longer prefixes of their
   suffixes, until they fit or the prefix is the whole depth, which is one node.
3. Groups are dealt into partitions of about ``partition`` words. In each, suffixes are
   sorted by their words, with the length of the prefix that neighbours share; the
   internal nodes of depth ``width`` follow, and each node's smallest document.

Words are compared as words: a partition numbers its distinct words, and ranks of
prefixes of 1, 2, 4 and so on words are ranks of pairs. Hashes only say where a suffix
goes (64 bits) and which runs have the same text (MD5).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.text import coded_words, mixed, sliced_by_bytes, word_hashes
from veinstone.session import cut_lineage, small, written

_BASE = 0xC6A4A7935BD1E995


@dataclass(frozen=True)
class Repeats:
    """Window in words, anchor in words, most words of a group and of a partition of
    groups (a partition takes about 100 bytes a word), and prefixes that split groups."""

    width: int = 50
    gram: int = 8
    group: int = 100_000
    partition: int = 500_000
    prefixes: tuple[int, ...] = (16, 32)


def anchored(texts: pa.Array, how: Repeats) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, how many each text has, and the runs of suffixes with one anchor: text
    number, anchor, first word, suffixes."""
    coded, groups = coded_words(texts)
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy()]
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < how.width:
        return coded, groups, none, none.view(np.uint64), none, none
    ends = np.cumsum(groups)
    owner = np.repeat(np.arange(len(groups)), groups)
    gram = np.zeros(n - how.gram + 1, dtype=np.uint64)
    for k in range(how.gram):
        gram = gram * np.uint64(_BASE) + h[k : k + len(gram)]
    low, span, have = mixed(gram), how.width - how.gram + 1, 1
    while have * 2 <= span:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if span > have:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    at = np.flatnonzero(np.arange(n - how.width + 1) + how.width <= ends[owner[: n - how.width + 1]])
    if not len(at):
        return coded, groups, none, none.view(np.uint64), none, none
    anchor, doc = low[at], owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    runs = np.flatnonzero(new)
    first = at[runs] - (ends - groups)[doc[runs]]
    return coded, groups, doc[runs], anchor[runs], first, np.diff(np.append(runs, len(at)))


_SCANNED = "doc_id long, tkey long, n_words long, sha string, anchors array<long>, counts array<int>"


def _scan(docs: DataFrame, how: Repeats) -> DataFrame:
    """Every row's words, their digest as if none were removed, and its anchors (none for a
    null doc_id) with the words that each run would send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 2):
            _, groups, doc, anchor, _, count = anchored(batch.column(2), how)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[doc]
            doc, anchor, count = doc[known], anchor[known], count[known]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32))
            sha = [hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).hexdigest() for t in pc.fill_null(batch.column(2), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(groups), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(anchor.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array((count + how.width - 1).astype(np.int32))),
                ],
                names=[c.split()[0] for c in _SCANNED.split(", ")],
            )

    return docs.mapInArrow(run, _SCANNED)


def _runs(wanted: DataFrame, how: Repeats) -> DataFrame:
    """Rows of (doc_id, tkey, text, wanted anchors) to the runs of those anchors with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 2, 2_000_000):
            coded, groups, doc, anchor, first, count = anchored(batch.column(2), how)
            flat = batch.column(3).flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            hit = np.isin(mixed(anchor + mixed(doc.astype(np.uint64))), mixed(flat + mixed(owner.astype(np.uint64))))
            doc, anchor, first, count = doc[hit], anchor[hit], first[hit], count[hit]
            for at in range(0, len(doc), 20_000):
                d, n = doc[at : at + 20_000], count[at : at + 20_000] + how.width - 1
                begin = (np.cumsum(groups) - groups)[d] + first[at : at + 20_000]
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) + np.repeat(begin - ends + n, n)
                words = coded.take(pa.array(place)).dictionary_decode()
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words)
                rows = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[at : at + 20_000].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array(first[at : at + 20_000].astype(np.int32)), pa.array(count[at : at + 20_000].astype(np.int32)), pc.binary_join(listed, " "),
                    ],
                    names=["anchor", "doc_id", "tkey", "first", "count", "words"],
                )

    return wanted.mapInArrow(run, "anchor long, doc_id long, tkey long, first int, count int, words string")


def suffix_order(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``width`` words (numbers), and for
    each in that order how many words of them it shares with the one before it.

    Ranks of prefixes of 2, 4, 8 ... words are the ranks of pairs of ranks, so that equal
    ranks are equal words.
    """
    n = len(codes)
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while size * 2 <= width:
        r = levels[-1]
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - size)] = r[size:] + 1
        levels.append(np.unique(r * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
        size *= 2
    rank = levels[-1][starts]
    if size < width:
        rank = rank * (n + 1) + levels[-1][starts + width - size]
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(starts), dtype=np.int64)
    a, b = starts[order][:-1], starts[order][1:]
    for level in range(len(levels) - 1, -1, -1):
        for _ in range(2):  # width is below twice the largest size
            at = shared[1:]
            room = at + 2**level <= width
            x, y = np.minimum(a + at, n - 1), np.minimum(b + at, n - 1)
            at[room & (levels[level][x] == levels[level][y])] += 2**level
    return order, shared


_SETTLED = "anchor long, seg binary, place int, lows array<long>"


def _settle(how: Repeats):
    """A partition of groups (anchor, seg, place, count, low, words): sort the suffixes, find
    the internal nodes of depth ``width`` and each one's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got) if (got := list(batches)) else None
        if table is None or not table.num_rows:
            return
        coded, groups = coded_words(table.column("words").combine_chunks())
        count = table.column("count").to_numpy().astype(np.int64)
        begin = np.cumsum(groups) - groups
        offsets = np.concatenate([[0], np.cumsum(count)])
        starts = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], count)
        order, shared = suffix_order(coded.indices.to_numpy().astype(np.int64), starts, how.width)
        low = np.repeat(table.column("low").to_numpy(), count)[order]
        new = np.flatnonzero(shared < how.width)
        least = np.minimum.reduceat(low, new)
        lows = np.empty(len(order), dtype=np.int64)
        lows[order] = np.repeat(least, np.diff(np.append(new, len(order))))
        listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(lows))
        out = pa.table({"anchor": table.column("anchor"), "seg": table.column("seg"), "place": table.column("place"), "lows": listed})
        yield from out.to_batches(max_chunksize=10_000)

    return run


def smallest_documents(distinct: DataFrame, how: Repeats) -> DataFrame:
    """(anchor, seg, lows) for distinct runs (anchor, seg, count, low, words): for each
    suffix of the run the smallest document that has its first ``width`` words."""
    rows = distinct.withColumn("place", F.lit(0)).withColumn("key", F.col("anchor"))
    settled, whole = [], None
    for depth in (*how.prefixes, how.width):
        sizes = cut_lineage(rows.groupBy("key").agg(F.sum(F.col("count") + F.lit(how.width - 1)).alias("n")))
        heavy = sizes.where(F.col("n") > how.group).select("key")
        total = sizes.agg(F.sum(F.when(F.col("n") <= how.group, F.col("n"))).alias("n"), F.count_if(F.col("n") > how.group).alias("heavy")).collect()[0]
        light = rows.join(small(heavy), "key", "left_anti") if total.heavy else rows
        parts = max(1, -(-(total.n or 0) // how.partition))
        settled.append(light.select("anchor", "seg", "place", "count", "low", "words", "key").repartition(parts, "key").drop("key").mapInArrow(_settle(how), _SETTLED))
        if not total.heavy:
            break
        words = F.split("words", " ")
        each = rows.join(small(heavy), "key", "left_semi").select("anchor", "seg", "low", "place", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
        each = each.select("anchor", "seg", "low", (F.col("place") + F.col("i")).alias("place"), F.lit(1).alias("count"), F.slice("w", F.col("i") + 1, F.lit(how.width)).alias("w"))
        rows = each.select("*", F.array_join("w", " ").alias("words"), F.xxhash64(F.slice("w", 1, min(depth, how.width))).alias("key")).drop("w")
        if depth < how.width:
            rows = cut_lineage(rows)
        else:  # the whole depth is one node
            nodes = rows.groupBy("words").agg(F.min("low").alias("least"))
            whole = rows.select("anchor", "seg", "place", "words").join(nodes, "words").select("anchor", "seg", "place", F.array("least").alias("lows"))
    pieces = settled[1:] + ([whole] if whole is not None else [])
    if not pieces:
        return settled[0].select("anchor", "seg", "lows")
    apart = pieces[0]
    for more in pieces[1:]:
        apart = apart.unionByName(more)
    joined = apart.groupBy("anchor", "seg").agg(F.sort_array(F.collect_list(F.struct("place", F.col("lows")[0].alias("low")))).alias("x"))  # a text's suffixes at most
    return settled[0].select("anchor", "seg", "lows").unionByName(joined.select("anchor", "seg", F.col("x.low").alias("lows")))


_COVERED = "doc_id long, tkey long, first int, last int"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, tkey, first, lows) to the intervals of suffixes that a smaller document has."""
    for batch in batches:
        docs, tkeys, firsts = (batch.column(i).to_numpy() for i in range(3))
        lows = batch.column(3)
        lengths = np.diff(lows.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.flatnonzero(lows.flatten().to_numpy() < docs[row])
        begin = np.ones(len(at), dtype=bool)
        begin[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
        a, b = at[begin], at[np.append(begin[1:], True)] if len(at) else at
        rows = row[a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[rows]), pa.array(tkeys[rows]), pa.array((firsts[rows] + place[a]).astype(np.int32)), pa.array((firsts[rows] + place[b]).astype(np.int32))],
            names=["doc_id", "tkey", "first", "last"],
        )


def covered_windows(scanned: DataFrame, docs: DataFrame, how: Repeats) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, tkey, text) that share an anchor with another document,
    and (doc_id, tkey, first, last): their windows, by first word, that also start in a
    document with a smaller id. ``scanned``: :func:`_scan` of the same rows."""
    each = scanned.select("doc_id", "tkey", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    per_doc = each.join(shared, "anchor").groupBy("doc_id", "tkey").agg(F.collect_set("anchor").alias("wanted"))
    texts = written(docs.join(per_doc, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "wanted"))
    runs = written(_runs(texts, how).withColumn("seg", F.unhex(F.md5("words"))))
    distinct = written(runs.groupBy("anchor", "seg").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("count").alias("count"), F.first("words").alias("words")))
    lows = smallest_documents(distinct.drop("high"), how)
    found = runs.select("anchor", "seg", "doc_id", "tkey", "first").join(lows, ["anchor", "seg"])
    return texts, found.select("doc_id", "tkey", "first", "lows").mapInArrow(_covered, _COVERED)


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, how: Repeats | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text: the kept words, joined by
    one space) of every row.

    Windows are judged on the input: a word goes if any window that covers it also
    starts in a document with a smaller doc_id. Null and empty texts have no words;
    a null doc_id neither loses words nor makes others lose them; rows that repeat a
    doc_id do not make each other lose words; documents under ``width`` words lose
    none; an empty table gives no rows; other columns are ignored.
    """
    how = how or Repeats()
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    scanned = cut_lineage(_scan(docs, how))
    texts, found = covered_windows(scanned, docs.where("doc_id IS NOT NULL"), how)
    spans = cut_lineage(found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    rows = texts.join(spans, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 2):
            out: list[tuple] = []
            for doc_id, text, first, last in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, first or [], 1)
                np.add.at(edge, np.array(last or [], dtype=np.int64) + how.width, -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])

    keys = spans.select("doc_id", "tkey")
    if with_text:  # the texts without repeats are read again, to be joined by one space
        rest = docs.join(keys, ["doc_id", "tkey"], "left_anti").select("doc_id", "tkey", "text", F.array().cast("array<int>").alias("first"), F.array().cast("array<int>").alias("last"))
        return rows.unionByName(rest).mapInArrow(run, _RESULT)
    plain = scanned.join(keys, ["doc_id", "tkey"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return rows.mapInArrow(run, _RESULT).drop("kept_text").unionByName(plain)


def oracle(width: int = 50) -> str:
    """DuckDB SQL with every window as text."""
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)
), c AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lo FROM x) WHERE lo < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM c, (SELECT unnest(range(0, {width})) AS k)
), kept AS (
  SELECT p.doc_id, list(p.word ORDER BY p.i) AS ws
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) p ANTI JOIN gone USING (doc_id, i)
  GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(len(k.ws), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k.ws, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
