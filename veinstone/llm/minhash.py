"""Near-duplicate detection by min-max hashing.

Each permutation is evaluated once and both its minimum and its maximum over a
document's shingles are kept, so 48 hash functions give a signature of 96 values.
Bands of four values find candidates; every link is confirmed on the full shingle
sets.

- Documents with the same words are one class from the start; only the smallest
  document of a class goes on.
- Within a bucket every document is compared with one hub, the member that meets most
  others over all bands, not with all others. Buckets that then still hold documents
  of different components are finished exactly, less the documents that a count of
  unshared shingles rules out: small buckets pair by pair. The documents of large ones are
  dealt anew by their rarest shingles, as many of which as two similar sets must share one
  of; what is then still a large bucket is done in tiles whose full sets are multiplied as
  matrices.
- For the comparison, a hub's text is sent once to each salted slice of its
  partners, which stream past it; memory holds one hub at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.text import coded_words, mixed, sliced_by_bytes, word_hashes
from veinstone.operators.graph import components
from veinstone.session import cut_lineage

_SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


@dataclass(frozen=True)
class Linking:
    """Shingle width in words, similarity in per cent, and the banding. With the
    defaults a pair at 85 % is missed with probability 2e-8, at 80 % 3e-6. Buckets up to ``pairwise`` open
    documents are finished pair by pair, larger ones in tiles of ``slice_size``."""

    words: int = 5
    percent: int = 80
    permutations: int = 48
    band_values: int = 4
    slice_size: int = 256
    pairwise: int = 32


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle, how many each text has, and a second,
    independent hash of each whole word sequence. A text with fewer words has one
    shingle, its whole sequence; a text without words has none."""
    coded, groups = coded_words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes = coded.indices.to_numpy()
    h, g = word_hashes(coded.dictionary, 1)[codes], word_hashes(coded.dictionary, 2)[codes]
    n, ends = len(h), np.cumsum(groups)
    starts = ends - groups
    odd = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    place = np.arange(n) - np.repeat(starts, groups)
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        roll[: n - k] = roll[: n - k] * odd[0] + mixed(h[k:] + np.uint64(k))
    whole = np.repeat(groups, groups)
    windows = np.where(groups >= width, groups - width + 1, np.minimum(groups, 1))
    keep = place < np.repeat(windows, groups)
    short = np.flatnonzero((groups > 0) & (groups < width))
    out = mixed(roll)
    for i in short:  # fewer words than a shingle
        x = np.uint64(groups[i])
        with np.errstate(over="ignore"):
            for w in h[starts[i] : ends[i]]:
                x = x * odd[1] + mixed(np.array([w]))[0]
        out[starts[i]] = mixed(np.array([x]))[0]
    del whole
    seq = np.zeros(len(groups), dtype=np.uint64)
    some = groups > 0
    if some.any():
        tagged = mixed(g + mixed(place.astype(np.uint64) * odd[2]))
        seq[some] = np.add.reduceat(tagged, starts[some])
    return out[keep], windows, seq


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    hashes, counts, _ = shingle_hashes(texts, width)
    at = 0
    for n in counts.tolist():
        yield np.unique(hashes[at : at + n])
        at += n


def signatures(docs: DataFrame, how: Linking) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the words, and the bands."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 2**63, how.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, how.permutations, dtype=np.uint64)
    n_bands = 2 * how.permutations // how.band_values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 1):
            hashes, counts, seq = shingle_hashes(batch.column(1), how.words)
            sets, at = [], 0
            for n in counts.tolist():
                sets.append(np.unique(hashes[at : at + n]))
                at += n
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            values = np.zeros((len(some), 2 * how.permutations), dtype=np.uint64)
            k1 = np.zeros(len(sizes), dtype=np.uint64)
            if len(some):
                for p in range(how.permutations):
                    x = (flat * a[p] + b[p]) >> np.uint64(32)
                    values[:, 2 * p] = np.minimum.reduceat(x, starts)
                    values[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
                k1[some] = np.add.reduceat(mixed(flat), starts)
            bands = np.zeros((len(some), n_bands), dtype=np.uint64)
            for j in range(n_bands):
                x = np.full(len(some), j + 1, dtype=np.uint64)
                for k in range(how.band_values):
                    x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + values[:, j * how.band_values + k])
                bands[:, j] = x
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            offsets[1:] = np.cumsum(np.where(sizes > 0, n_bands, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(seq.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNATURES)


def confirmed(texts: DataFrame, pairs: DataFrame, how: Linking) -> DataFrame:
    """The (a, b) of ``pairs`` (distinct) whose shingle sets reach the similarity; ``texts``
    is (id, text).

    b is the hub: its partners are dealt into slices, each of which gets the hub's
    text first and streams its partners after it.
    """
    per_hub = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(how.slice_size)).alias("slices"))
    dealt = pairs.join(per_hub, "b").withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")))
    hubs = per_hub.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("rank"))
    members = dealt.select(F.col("a").alias("id"), "b", "slice", F.lit(1).alias("rank")).unionByName(hubs)
    rows = texts.join(members, "id").repartition("b", "slice").sortWithinPartitions("b", "slice", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in sliced_by_bytes(batches, 4, 4_000_000):
            ids, hubs, ranks = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out_a, out_b = [], []
            for i, b, r, s in zip(ids, hubs, ranks, sets_of(batch.column(4), how.words), strict=True):
                if r == 0:
                    hub, own = b, s
                elif b == hub:
                    both = len(np.intersect1d(own, s, assume_unique=True)) if len(own) else 0
                    if 100 * both >= how.percent * (len(own) + len(s) - both):
                        out_a.append(i)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.select("id", "b", "slice", "rank", "text").mapInArrow(run, "a long, b long")


def shingles_of(texts: DataFrame, ids: DataFrame, how: Linking) -> DataFrame:
    """(id, h): the distinct shingles of each document of ``ids`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 1, 4_000_000):
            sets = list(sets_of(batch.column(1), how.words))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "hashes"])

    sets = texts.join(ids, "id").select("id", "text").mapInArrow(run, "id long, hashes array<long>")
    return sets.select("id", F.explode("hashes").alias("h"))


def unshared(texts: DataFrame, ids: DataFrame, how: Linking) -> DataFrame:
    """(id, alone): how many shingles of each document no other document of ``ids`` (id) has."""
    each = shingles_of(texts, ids, how).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    return each.where("id = last").groupBy("id").agg(F.count("*").alias("alone"))


def by_rare_shingles(texts: DataFrame, left: DataFrame, how: Linking) -> DataFrame:
    """Rows of :func:`_open_members` dealt into buckets of rare shingles: the same columns, with
    the shingle as the key.

    Two sets of which one has n elements can only reach the similarity if they share one of
    its n - ceil(percent * n / 100) + 1 first elements in any common order, so the rarest
    ones are taken. Buckets of one component are left out, and of those with the same
    documents (by a 128-bit sum of their hashes) one is kept.
    """
    ids = cut_lineage(left.select(F.col("rep").alias("id"), "n", "c", "root").distinct())
    each = cut_lineage(shingles_of(texts, ids.select("id"), how))
    often = each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("times", "h"))
    first = each.join(often, "h").withColumn("place", place).join(ids, "id")
    # the elements that no other set has come before all of these; there are at least n less what is left here
    held = F.count("*").over(Window.partitionBy("id"))
    first = first.withColumn("alone", F.col("n") - held).where(F.col("place") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * how.percent / 100) + 1)
    rows = cut_lineage(first.select(F.col("h").alias("key"), F.col("id").alias("rep"), "n", "c", "root"), each)
    sums = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"), *sums).where("lo < hi")
    keys = keys.groupBy("members", "x1", "x2").agg(F.min("key").alias("key"))  # one of the buckets with the same documents
    return cut_lineage(rows.join(keys.select("key", "members"), "key"), rows)


def _allows(common: Column, n: Column, m: Column, how: Linking) -> Column:
    """Whether sets of n and m elements with ``common`` shared ones reach the similarity."""
    return common * 100 >= (n + m - common) * how.percent


def link(docs: DataFrame, how: Linking | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    component_id is the smallest doc_id reachable over links, the document itself
    included; kept is doc_id = component_id. Null and empty texts have no shingles
    and link to nothing; a null doc_id links to nothing, has a null component and is
    kept; rows that repeat a doc_id share its component; an empty table gives no rows;
    other columns are ignored.
    """
    how = how or Linking()
    signed = cut_lineage(signatures(docs, how))
    words = ["k1", "k2", "n_shingles"]
    classes = cut_lineage(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*words)
        .agg(F.min(F.struct("doc_id", "bands")).alias("least"))
        .select(*words, F.col("least.doc_id").alias("rep"), F.col("least.bands").alias("bands"))
    )
    rows = classes.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = cut_lineage(rows.join(shared, "key"))
    # a document that meets many others is near the middle of its group and makes a good hub
    central = buckets.groupBy("rep").agg(F.sum("members").alias("meets"))
    buckets = cut_lineage(buckets.join(central, "rep").select("key", "rep", "n", "meets"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = cut_lineage(texts.join(central.select(F.col("rep").alias("id")), "id"))
    hubs = buckets.groupBy("key").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"), "n")).alias("hub"))
    first = (
        buckets.join(hubs, "key")
        .select("rep", "n", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("m"))
        .where((F.col("rep") != F.col("hub")) & _allows(F.least("n", "m"), F.col("n"), F.col("m"), how))
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )
    tested = cut_lineage(first)
    edges = cut_lineage(confirmed(texts, tested, how))
    roots = components(edges)
    left = _open_members(texts, buckets, roots, how)
    few = left.where(F.col("members") <= how.pairwise)
    many = left.where(F.col("members") > how.pairwise)
    tiles = None
    if not many.isEmpty():
        rare = by_rare_shingles(texts, many, how).select(*few.columns)
        few = few.unionByName(rare.where(F.col("members") <= how.pairwise))
        tiles = _linked_in_tiles(texts, rare.where(F.col("members") > how.pairwise), how)
    pairs = cut_lineage(_open_pairs(few, tested, how))
    found = confirmed(texts, pairs, how)
    found = cut_lineage(found if tiles is None else found.unionByName(tiles))
    if not found.isEmpty():
        roots = components(edges.unionByName(found))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(*words, F.coalesce("root", "rep").alias("component"))
    own = F.coalesce(F.col("component"), F.col("doc_id"))
    return signed.drop("bands").join(named, words, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == own)).alias("kept"),
    )


def _open_members(texts: DataFrame, buckets: DataFrame, roots: DataFrame, how: Linking) -> DataFrame:
    """(key, rep, n, c, root, members): documents that may still link components.

    They share a bucket with another component and are not ruled out by counting:
    of the documents in such buckets each one's shingles that no other has are
    counted, and c is what is left. Two documents share at most the c of either,
    which bounds their similarity from above; a document whose bound is too low with
    any partner leaves.
    """
    named = buckets.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))

    def unsettled(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
        return rows.join(keys.where("lo < hi").select("key", "members"), "key")

    split = cut_lineage(unsettled(named).drop("members"))
    alone = unshared(texts, split.select(F.col("rep").alias("id")).distinct(), how)
    left = split.join(alone, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"), "root")
    return cut_lineage(unsettled(left.where(_allows(F.col("c"), F.col("n"), F.col("c"), how))))


def _open_pairs(left: DataFrame, tested: DataFrame, how: Linking) -> DataFrame:
    """Pairs (a, b) across components of small buckets, under the bound, not compared yet."""
    other = left.select("key", *[F.col(x).alias(f"{x}2") for x in ("rep", "n", "root", "c")])
    pairs = (
        left.join(other, "key")
        .where((F.col("rep") > F.col("rep2")) & (F.col("root") != F.col("root2")) & _allows(F.least("c", "c2", "n", "n2"), F.col("n"), F.col("n2"), how))
        .select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
        .distinct()
    )
    known = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    ids, inverse, seen = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    number = np.cumsum(seen > 1) - 1  # only elements that occur twice can be shared
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    keep = seen[inverse] > 1
    col, row = number[inverse[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [at, at + step])
        part = np.zeros((len(left) + len(right), step), dtype=np.float32)
        part[row[a:b], col[a:b] - at] = 1.0
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _linked_in_tiles(texts: DataFrame, left: DataFrame, how: Linking) -> DataFrame:
    """Links (a, b) across components of large buckets.

    A bucket's documents are dealt into slots; each pair of slots is a tile whose
    full sets are compared at once as a matrix product. A tile returns only links
    that join components it has not joined yet, so rows grow with the documents and
    not with their pairs.
    """
    slots = F.ceil(F.col("members") / F.lit(how.slice_size))
    placed = left.withColumn("slot", F.pmod(F.xxhash64("rep"), slots)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
    placed = placed.select(F.col("rep").alias("id"), "root", "key", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot")
    rows = placed.join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
        sets = list(sets_of(table.column("text").combine_chunks(), how.words))
        first = np.flatnonzero(table.column("slot").to_numpy() == table.column("i").to_numpy())
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        second = first if same else np.setdiff1d(np.arange(len(ids)), first)
        out: list[tuple[int, int]] = []
        if len(first) and len(second):
            sizes = np.array([len(x) for x in sets])
            both = shared_counts([sets[x] for x in first], [sets[x] for x in second])
            linked = 100 * both >= how.percent * (sizes[first][:, None] + sizes[second][None, :] - both)
            linked &= roots[first][:, None] != roots[second][None, :]
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for x, y in zip(*np.nonzero(linked), strict=True):
                p, q = top(int(roots[first[x]])), top(int(roots[second[y]]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(ids[first[x]]), int(ids[second[y]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, how: Linking | None = None) -> DataFrame:
    """The rows of ``docs`` of which :func:`link` keeps the document.

    Documents without words and rows with a null doc_id stay; rows that repeat a doc_id
    stay or go together; an empty table gives no rows; other columns are kept.
    """
    gone = link(docs, how).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"))  # so that no column name clashes
    return packed.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def oracle(words: int = 3, percent: int = 85) -> str:
    """DuckDB SQL over all pairs that share a shingle."""
    window = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ') ELSE {window} END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {words - 1}) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
