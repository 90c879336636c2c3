"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index holds the postings (term, row, pos) of every token of the training texts that is
a test term at all, written as a table, each document's postings where the document was
read, so that building it shuffles nothing. From it come the terms' counts. A test window
(some consecutive words) then asks for its terms' lists, the rarest first: the postings of
its rarest term, moved back by the term's offset, are the places where the window may
start; these are intersected with the moved list of the second rarest, and what is left
with those of all its terms. What remains are exact matches of the phrase.

Proximity matches start from the rarest term as well: around each of its postings the
window's other terms are gathered, and an interval of a few words more than the window
that holds all of them is a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut_lineage, written

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a window.
WORDS = 10


def terms_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text.cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def bounded(df: DataFrame, rows: int = 500_000, size: int = 32_000_000) -> DataFrame:
    """The same table, to be broadcast if it has at most so many rows and characters; else the
    join is left to Spark."""
    texts = [F.length(F.col(c)) for c, kind in df.dtypes if kind == "string"]
    one = sum(texts, F.lit(0)) + 16
    now = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("size")).collect()[0]
    return F.broadcast(df) if now.n <= rows and now["size"] <= size else df


def windows_of(items: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (w, size, terms) of ``items`` (item_id, text), and the items that have
    each (w, item_id). An item with fewer words, but not none, is one window."""
    size = F.least(F.lit(words), F.size("t"))
    starts = F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t") - size + 1))
    each = items.select("item_id", terms_of(F.col("text")).alias("t")).select("item_id", F.explode(F.transform(starts, lambda s: F.slice("t", s, size))).alias("terms")).distinct()
    each = cut_lineage(each)
    distinct = cut_lineage(each.select("terms").distinct().withColumn("w", F.monotonically_increasing_id()))
    owners = cut_lineage(each.join(distinct, "terms").select("w", "item_id"), each)
    return distinct.select("w", F.size("terms").alias("size"), "terms"), owners


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text) over ``terms`` (term): term, row, pos (from
    1). Each document has one more row with an empty term, its doc_id and its number of words
    (n_words). Rows are numbered as the index is written, so documents may share a doc_id."""
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), terms_of(F.col("text")).alias("t"))
    tokens = read.select("doc_id", "row", F.size("t").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "t")).alias("pos", "term"))
    asked = bounded(terms.select("term").union(terms.sparkSession.range(1).select(F.lit(""))))
    head = F.col("pos") == 0
    kept = tokens.join(asked, "term", "left_semi")
    return written(kept.select("term", "row", "pos", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("n_words")).alias("n_words")))


def postings(stored: DataFrame) -> DataFrame:
    return stored.where("term <> ''").select("term", "row", "pos")


def ranked_terms(windows: DataFrame, stored: DataFrame) -> DataFrame:
    """(w, size, term, offset, rank): the terms of the windows that can match, the rarest in the
    training texts first, ties to the earlier; windows with a term that is nowhere are left out."""
    counts = postings(stored).groupBy("term").agg(F.count("*").alias("n"))
    t = windows.select("w", "size", F.posexplode("terms").alias("offset", "term")).join(bounded(cut_lineage(counts)), "term")
    each = Window.partitionBy("w")
    t = t.withColumns({"found": F.count("*").over(each), "rank": F.row_number().over(each.orderBy("n", "offset"))})
    return cut_lineage(t.where("found = size").select("w", "size", "term", "offset", "rank"))


def starts(ranked: DataFrame, stored: DataFrame) -> DataFrame:
    """(row, w, size, start): the postings of each window's rarest term, moved by its offset."""
    rarest = bounded(ranked.where("rank = 1").select("w", "size", "term", "offset"))
    return postings(stored).join(rarest, "term").select("row", "w", "size", (F.col("pos") - F.col("offset")).alias("start")).where("start > 0")


def intersected(found: DataFrame, ranked: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """The starts that all of the ``most`` rarest lists have. ``lists``: postings among which
    all of these are."""
    asked = found.join(bounded(ranked.where(F.col("rank") <= most).select("w", "term", "offset")), "w")
    asked = asked.select("row", "w", "size", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
    met = asked.join(lists, ["row", "pos", "term"]).groupBy("row", "w", "size", "start").agg(F.count("*").alias("met"))
    return met.where(F.col("met") == F.least("size", F.lit(most))).drop("met")


def phrase_matches(windows: DataFrame, stored: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(row, w, size, start): every exact occurrence of every window."""
    ranked = ranked_terms(windows, stored) if ranked is None else ranked
    found = starts(ranked, stored)
    rare = bounded(ranked.where("rank <= 2").select("term").distinct())
    found = cut_lineage(intersected(found, ranked, postings(stored).join(rare, "term", "left_semi"), 2))
    near = bounded(found.select("row").distinct(), 1_000_000)
    return cut_lineage(intersected(found, ranked, postings(stored).join(near, "row", "left_semi"), WORDS_AT_MOST), found)


#: More than any window has words.
WORDS_AT_MOST = 2**31 - 1


def proximity_matches(windows: DataFrame, stored: DataFrame, slop: int, ranked: DataFrame | None = None) -> DataFrame:
    """(row, w, start, stop): places where all distinct terms of a window stand in any order
    within size + ``slop`` words; of those around one posting of the rarest term the first.

    The two rarest terms are met first, by pieces of the text as long as the interval; only
    around what is left are all terms gathered, at most twice the interval's words a place."""
    ranked = ranked_terms(windows, stored) if ranked is None else ranked
    each = Window.partitionBy("w")
    distinct = ranked.groupBy("w", "size", "term").agg(F.min("rank").alias("rank"))
    distinct = distinct.withColumns({"rank": F.row_number().over(each.orderBy("rank")), "terms": F.count("*").over(each), "span": F.col("size") + slop})
    distinct = cut_lineage(distinct)
    first = bounded(distinct.where("rank = 1").drop("rank"))
    anchors = postings(stored).join(first, "term").select("row", "w", "terms", "span", F.col("pos").alias("anchor"))

    def around(found: DataFrame, asked: DataFrame, lists: DataFrame) -> DataFrame:
        """found, and the postings of each asked term of the window within the span."""
        piece = F.floor(F.col("anchor") / F.col("span"))
        a = found.join(bounded(asked.select("w", "term")), "w").withColumn("piece", F.explode(F.array(piece - 1, piece, piece + 1)))
        a = a.select(*found.columns, "term", "piece", F.col("row").alias("_row"))
        spans = asked.select("term", F.col("span").alias("_span")).distinct()
        p = lists.join(bounded(spans), "term").select(F.col("row").alias("_row"), "term", F.col("_span").alias("span"), F.floor(F.col("pos") / F.col("_span")).alias("piece"), "pos")
        return a.join(p, ["_row", "term", "span", "piece"]).where(F.abs(F.col("pos") - F.col("anchor")) < F.col("span")).drop("_row", "piece")

    some = anchors.where("terms = 1")
    rare = distinct.where("rank = 2")
    met = around(anchors.where("terms > 1"), rare, postings(stored)).select(*anchors.columns).distinct()
    found = cut_lineage(some.union(met))
    rows = bounded(found.select("row").distinct(), 1_000_000)
    near = around(found, distinct, postings(stored).join(rows, "row", "left_semi"))
    near = near.groupBy(*anchors.columns).agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("near"))
    # the first place from which an interval reaches all terms, with the anchor inside
    inside = lambda s: F.filter("near", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("span")))
    whole = F.filter("near", lambda s: (s["pos"] <= F.col("anchor")) & (s["pos"] + F.col("span") > F.col("anchor")) & (F.size(F.array_distinct(F.transform(inside(s), lambda x: x["term"]))) == F.col("terms")))
    return near.select("row", "w", "span", F.get(whole, 0)["pos"].alias("start")).where("start IS NOT NULL").select("row", "w", "start", (F.col("start") + F.col("span") - 1).alias("stop")).distinct()


def find_items(docs: DataFrame, items: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``
    (doc_id, text): how many of its words lie inside an occurrence of a window of ``items``
    (item_id, text), and which items have one.

    Null and empty texts have no words and no hits; an item without words is never found; a
    null item_id counts as one item, written empty; items that share a window are all
    counted; repeated rows are documents of their own; an empty table gives no rows, no items
    give no hits; other columns are ignored."""
    windows, owners = windows_of(items, words)
    stored = index(docs, windows.select(F.explode("terms").alias("term")).distinct())
    hits = phrase_matches(windows, stored)
    places = hits.select("row", "start", "size").distinct()
    places = places.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    covered = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    found = hits.select("row", "w").distinct().join(owners, "w").select("row", named.alias("item")).distinct()
    found = found.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    documents = stored.where("term = ''").select("row", "doc_id", "n_words")
    out = documents.join(covered.join(found, "row"), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def oracle(words: int = WORDS) -> str:
    found = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({found}, []) AS t FROM documents
), b AS (
  SELECT item_id, t, least({words}, len(t)) AS k FROM (SELECT item_id, {found} AS t FROM benchmark) WHERE len(t) > 0
), w AS (
  SELECT DISTINCT item_id, k, array_to_string(t[s : s + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS s FROM b)
), sizes AS (
  SELECT DISTINCT k FROM w
), g AS (
  SELECT row, k, s, array_to_string(t[s : s + k - 1], ' ') AS phrase FROM (SELECT row, t, k, unnest(range(1, len(t) - k + 2)) AS s FROM d JOIN sizes ON len(t) >= k)
), hits AS (
  SELECT DISTINCT g.row, g.s, g.k, coalesce(CAST(w.item_id AS VARCHAR), '') AS item FROM g JOIN w ON g.k = w.k AND g.phrase = w.phrase
), covered AS (
  SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(s, s + k)) AS pos FROM hits) GROUP BY row
), found AS (
  SELECT row, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY row
)
SELECT d.doc_id, CAST(len(d.t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered ON d.row = covered.row LEFT JOIN found ON d.row = found.row
"""
