"""Quality rules, line first.

Every line is judged by itself: punctuation (no sentence mark, unless it is the heading
of the line after it, an item of a list, or in a script that writes none; or too many
symbols or exclamation marks), navigation (separator bars, or mostly menu phrases
outside a sentence) and boilerplate (licence, copyright, cookie and
subscription phrases). Failing lines are removed; a document that loses more than
half of its words with them is rejected, and so is one that fails the base limits on
words and repetition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.text import coded_words, sliced_by_bytes

SYMBOLS = "#*$%&|<>"
#: Marks that end sentences or clauses: Latin, Greek, CJK, Arabic, Urdu, Devanagari, Armenian, Ethiopic, Burmese, Khmer.
SENTENCE_MARKS = r"[.!?:;…。！？؟؛۔।॥։።፧၊။។]"
#: Thai and Lao put no marks: a run of so many of their letters is a sentence.
UNMARKED = r"[\p{Thai}\p{Lao}]{20}"
BARS = "[|»•]"
#: Phrases of fixed wording that pages repeat, in four languages.
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|licensed under|released under the|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie policy"
    r"|(?:uses|accept(?: all)?) cookies|enable javascript|subscribe to our|sign up for our|follow us on|powered by|copyright (?:\(c\)|©|[0-9]{4})"
    r"|tous droits r|politique de confidentialit|utilise des cookies|alle rechte vorbehalten|verwendet cookies|todos los derechos reservados|utiliza cookies)"
)
#: Phrases of menus and link lists; a line of several of them that make up 40 % of its words is navigation.
MENU = (
    r"(?i)\b(?:home|products|about us|contact(?: us)?|sign (?:in|up)|log ?(?:in|out)|register|basket|cart|checkout|my account|menu|search|site ?map|help|faq|next|previous"
    r"|back to top|skip to|read more|click here|share this|newsletter|accueil|panier|connexion|startseite|warenkorb|anmelden|inicio|carrito)\b"
)
#: A heading has at most so many words, first a capital, a letter of a script without capitals or a digit, and no bar.
HEADING_WORDS = 12
HEADING = r"^[\x20\x09]*[\p{Lu}\p{Lt}\p{Lo}0-9][^|»•]*$"
#: An item of a list has a bullet or a number first and at least so many words with it.
ITEM_WORDS = 5
ITEM = r"^[\x20\x09]*(?:[-–—*+•‣▪◦·]|\(?[0-9a-z]{1,3}[.)])[\x20\x09]"
#: A sentence of at least so many words, one capital and one mark is no navigation, whatever its words.
PROSE_WORDS = 8
PROSE = r"^[\x20\x09]*\p{Lu}[^\p{Lu}.!?:;|»•/]*[.!?…][\x20\x09\x0D]*$"
#: A line's limits: symbols in per cent of its word characters, exclamation marks
#: and bars in per cent of its words. A document's: words lost in per cent.
MAX_SYMBOLS, MAX_SHOUTS, MAX_BARS, MAX_LOST = 15, 50, 20, 50
MIN_WORDS, MAX_REPEATED = 50, 50

_SYMBOL, _SPACE = f"[{re.escape(SYMBOLS)}]", r"[\x20\x09-\x0D]"

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_kept_words long"
)


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy().astype(np.int64)


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def failing(lines: pa.Array, owner: np.ndarray, words: np.ndarray, chars: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Whether each line is removed. ``owner``: the text it is of; ``words`` (none: it
    stays) of ``chars`` code points; ``symbols`` in it."""
    marked = _has(lines, SENTENCE_MARKS) | _has(lines, UNMARKED)
    full = np.flatnonzero(words)
    leads = np.zeros(len(lines), dtype=bool)  # the next line with words has a sentence mark
    leads[full[:-1]] = marked[full[1:]] & (owner[full[1:]] == owner[full[:-1]])
    heading = (words <= HEADING_WORDS) & leads & _has(lines, HEADING)
    menu = _count(lines, MENU)
    item = (words >= ITEM_WORDS) & _has(lines, ITEM)
    prose = (words >= PROSE_WORDS) & _has(lines, PROSE)
    out = ~marked & ~heading & ~item
    out |= 100 * symbols > MAX_SYMBOLS * chars
    out |= 100 * pc.count_substring(lines, "!").to_numpy().astype(np.int64) > MAX_SHOUTS * words
    out |= 100 * _count(lines, BARS) > MAX_BARS * words
    out |= _has(lines, BOILERPLATE)
    out |= (menu > 1) & (5 * menu >= 2 * words) & ~prose
    return out & (words > 0)


def line_fails(line: str, words: int, chars: int, after: str = "") -> bool:
    """:func:`failing` for one line with ``words`` words of ``chars`` code points; ``after`` is
    the next line with words."""
    both = pa.array([line, after])
    sizes = np.array([words, len(after.split())])
    return bool(failing(both, np.zeros(2, np.int64), sizes, np.array([chars, len(after)]), _count(both, _SYMBOL))[0])


def repeated_words(codes: np.ndarray, groups: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each group in ``width``-word windows that occur twice or more in it.

    ``codes``: words as numbers below their count; ``groups``: words in each group.
    """
    n, owner = len(codes), np.repeat(np.arange(len(groups)), groups)
    out = np.zeros(len(groups), dtype=np.int64)
    if n < width:
        return out
    at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    if not len(at):
        return out
    _, key = np.unique(codes[at], return_inverse=True)
    for k in range(1, width):  # windows as numbers, one word at a time, so that no product overflows
        _, key = np.unique(key.astype(np.int64) * (int(codes.max()) + 1) + codes[at + k], return_inverse=True)
    key = owner[at] * (int(key.max()) + 1) + key
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(n, dtype=bool)
    often = at[counts[inverse] > 1]
    for k in range(width):
        covered[often + k] = True
    np.add.at(out, owner[covered], 1)
    return out


def judge(texts: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The columns of :data:`COLUMNS` for each text, and the texts without failing lines."""
    n = len(texts)
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, per_text = pc.list_flatten(split), pc.list_value_length(split).to_numpy()
    owner = np.repeat(np.arange(n), per_text)
    coded, words = coded_words(lines)
    chars = pc.utf8_length(lines).to_numpy().astype(np.int64) - _count(lines, _SPACE)
    symbols = _count(lines, _SYMBOL)
    fails = failing(lines, owner, words, chars, symbols)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n).astype(np.int64)

    n_words, lost = total(words), total(words * fails)
    full = words > 0
    kinds = lines.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    first = np.unique(owner[full] * (len(lines) + 1) + kinds) // (len(lines) + 1)
    dups = total(full.astype(np.int64)) - np.bincount(first, minlength=n)
    repeats = repeated_words(coded.indices.to_numpy().astype(np.int64), n_words)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n_words)
    kept = ~failed & (100 * lost <= MAX_LOST * n_words)
    stay = ~fails
    offsets = np.concatenate([[0], np.cumsum(total(stay.astype(np.int64)))]).astype(np.int32)
    cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(stay))), "\n")
    columns = (n_words, total(chars), total(symbols), dups, repeats, failed, kept, n_words - lost)
    return dict(zip((c.split()[0] for c in COLUMNS.split(", ")), columns, strict=True)), pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), cleaned)


_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_kept_words of every row.

    Null and empty texts have no words and fail; repeated rows are judged each; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, 1):
            found, _ = judge(batch.column(1))
            arrays = [pa.array(v, t) for v, t in zip(found.values(), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *found])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, without their failing lines, in the columns of ``docs``
    (n_chars follows the text, if there is such a column).

    Null and empty texts fail and go; repeated rows are judged each and stay or go
    alike; an empty table gives no rows; other columns are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_by_bytes(batches, text_at):
            found, texts = judge(batch.column(text_at))
            new = batch.set_column(text_at, batch.schema.field(text_at), texts)
            yield new.filter(pa.array(found["kept"]))

    text_at = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


_SQL_MARKED = f"(?:{SENTENCE_MARKS}|{UNMARKED})"
_SQL_BOILER, _SQL_MENU = BOILERPLATE.replace("'", "''"), MENU.replace("'", "''")
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT id, CAST(count(DISTINCT i + o) AS BIGINT) AS n FROM p, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY id
), y AS (
  SELECT id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT id, string_split(t, chr(10)) AS ls FROM d))
), l AS (
  SELECT id, line, n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, coalesce(lead(line) OVER (PARTITION BY id ORDER BY i), '') AS after,
    len(regexp_extract_all(line, '{_SQL_MENU}')) AS menu
  FROM y WHERE n > 0
), x AS (
  SELECT id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dups, CAST(sum(CASE WHEN
      (NOT regexp_matches(line, '{_SQL_MARKED}') AND NOT (n <= {HEADING_WORDS} AND regexp_matches(line, '{HEADING}') AND regexp_matches(after, '{_SQL_MARKED}'))
        AND NOT (n >= {ITEM_WORDS} AND regexp_matches(line, '{ITEM}')))
      OR 100 * length(regexp_replace(line, '[^{SYMBOLS}]', '', 'g')) > {MAX_SYMBOLS} * chars
      OR 100 * (length(line) - length(replace(line, '!', ''))) > {MAX_SHOUTS} * n
      OR 100 * length(regexp_replace(line, '[^|»•]', '', 'g')) > {MAX_BARS} * n
      OR regexp_matches(line, '{_SQL_BOILER}') OR (menu > 1 AND 5 * menu >= 2 * n AND NOT (n >= {PROSE_WORDS} AND regexp_matches(line, '{PROSE}'))) THEN n ELSE 0 END) AS BIGINT) AS lost
  FROM l GROUP BY id
), b AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d JOIN w USING (id) LEFT JOIN r USING (id) LEFT JOIN x USING (id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost <= {MAX_LOST} * n_words AS kept,
  n_words - lost AS n_kept_words
FROM b
"""
