"""Secret scans with DataFrame functions only.

Three pattern kinds give the base spans. Spark's regular expressions return no
positions, so they are rebuilt: the pieces between matches (``split`` with the same
pattern) and the matches themselves follow each other, and their lengths add up to
the code-point offsets.

A fourth kind finds what no pattern names: candidate strings (long runs of key
characters with letters and digits) over which a window slides. Counts of the
characters in the window are updated by the one that enters and the one that
leaves, and with them the sum of c * log2(c), from which the window's Shannon
entropy follows. Each character class (hexadecimal or base64) has its own
threshold. An allow-list suppresses known harmless forms of this kind; it never
touches base spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # whole runs, as [0-9a-f]+ with the short ones dropped
}
KINDS = [*BASE, "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, by character class.
HEX_BITS, BASE64_BITS = 3.0, 3.7
#: Forms that are no secrets: UUIDs, placeholders, file and module paths.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}",
    r"^[A-Za-z]*(?:[/_=-][A-Za-z]{2,})++[/_=-]?[0-9]{0,4}$",  # possessive: nothing to give back, and no recursion on long paths
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; Spark repeats what a lambda names twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The values merged (sum or maximum) from the first to each one. Appending copies an
    array, so this is done in blocks of about the square root of the length, and over the
    blocks' last values: for n values some n * sqrt(n) words are moved, not n * n."""

    def inside(block: Column) -> Column:
        def add(acc: Column, v: Column) -> Column:
            return F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(merge(F.element_at(acc, F.greatest(F.lit(1), F.size(acc))), v)))

        return F.aggregate(block, F.array().cast("array<int>"), add)

    def shift(parts: Column, carry: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(_let(F.get(carry, k - 1), lambda c: F.transform(part, lambda v: merge(c, v))))))

    def whole(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        blocks = _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: inside(F.slice(v, k * w + 1, w))))
        return _let(blocks, lambda parts: _let(inside(F.transform(parts, lambda part: F.element_at(part, -1))), lambda carry: shift(parts, carry)))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(whole(v)))


def _placed(text: Column, pattern: str, group: int, kind: int, keep) -> Column:
    """Spans (start, kind, end) of the matches that ``keep`` accepts by (match, group)."""
    p = F.lit(pattern)

    def steps(found: Column) -> Column:
        values = found if group == 0 else F.regexp_extract_all(text, p, group)
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"), values.alias("v"))
        return F.transform(zipped, lambda x: F.struct(keep(x["m"], x["v"]).alias("keep"), F.length(x["m"]).alias("n"), (F.length(x["p"]) + F.length(x["m"])).alias("step")))

    def spans(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda x: x["step"]), lambda a, b: a + b)
        each = F.zip_with(rows, ends, lambda x, e: F.struct(x["keep"].alias("keep"), (e - x["n"]).alias("start"), e.alias("end")))
        return F.transform(F.filter(each, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    none = F.array().cast(_SPANS)
    return F.when(F.regexp_like(text, p), _let(_let(F.regexp_extract_all(text, p, 0), steps), spans)).otherwise(none)


def _uncovered(spans: Column, covers: Column) -> Column:
    """The spans that lie in none of ``covers``: both sorted by start in one array, in which the
    furthest end of a cover so far decides."""

    def marked(of: Column, own: bool) -> Column:
        return F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end")))

    def choose(both: Column) -> Column:
        far = _running(F.transform(both, lambda s: F.when(s["own"], -1).otherwise(s["end"])), lambda a, b: F.greatest(a, b))
        each = F.zip_with(both, far, lambda s, e: F.struct((s["own"] & (s["end"] > e)).alias("keep"), s.alias("s")))
        return F.transform(F.filter(each, lambda x: x["keep"]), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))

    return F.when((F.size(spans) == 0) | (F.size(covers) == 0), spans).otherwise(_let(F.array_sort(F.concat(marked(covers, False), marked(spans, True))), choose))


def base_spans(text: Column) -> list[Column]:
    return [
        _placed(text, pattern, group, kind, lambda m, v, least=least: F.length(v) >= least)
        for kind, (pattern, group, least) in enumerate(BASE.values())
    ]


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(s: Column, width: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of ``width`` characters in a row, by incremental counts.

    The counts are a string with one character for each letter of the alphabet ("A" for 0,
    "B" for 1 and so on), so that a step overwrites two of them and builds nothing else."""
    zero = F.struct(F.lit("A" * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substring(counts, at, F.lit(1))) - 65

    def put(counts: Column, at: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + 65), at, F.lit(1))

    def slide(places: Column, acc: Column, i: Column) -> Column:
        into = F.get(places, i - 1)
        gone = F.when(i > width, F.get(places, i - width - 1)).otherwise(F.lit(0))
        c_in, c_gone = count(acc["n"], into), count(acc["n"], gone)
        same = gone == into
        came = put(acc["n"], into, c_in + 1)
        counts = F.when(same, acc["n"]).when(gone > 0, put(came, gone, c_gone - 1)).otherwise(came)
        change = F.when(same, F.lit(0.0)).otherwise(
            _clog(c_in + 1) - _clog(c_in) + F.when(gone > 0, _clog(c_gone - 1) - _clog(c_gone)).otherwise(F.lit(0.0))
        )
        total = acc["sum"] + change
        bits = F.when(i >= width, F.log2(F.lit(float(width))) - total / F.lit(float(width))).otherwise(F.lit(0.0))
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    letters = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _let(letters, lambda places: F.aggregate(F.sequence(F.lit(1), F.length(s)), zero, lambda acc, i: slide(places, acc, i), lambda a: a["best"]))


def is_secret_like(s: Column) -> Column:
    """Letters and digits, no allow-listed form, and a window over its class's threshold."""
    allowed = F.lit(False)
    for form in ALLOW:
        allowed = allowed | F.regexp_like(s, F.lit(form))
    bits = F.when(F.regexp_like(s, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    return (
        F.regexp_like(s, F.lit("[0-9]")) & F.regexp_like(s, F.lit("[A-Za-z]"))
        & F.when(allowed, False).otherwise(F.round(window_entropy(s), 9) >= bits)
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and _base, _spans: arrays of (start, kind, end), ordered so. Null text has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    possible = F.regexp_like(text, F.lit("[0-9]")) & F.regexp_like(text, F.lit(CANDIDATE))  # implied by is_secret_like: a candidate with a digit
    # a candidate that is one hexadecimal base span would be suppressed, so its windows need no look
    found = F.when(possible, _placed(text, CANDIDATE, 0, len(BASE), lambda m, v: ~F.regexp_like(m, F.lit("^[0-9a-f]{24,}$")) & is_secret_like(m))).otherwise(F.array().cast(_SPANS))
    named = docs.withColumns({f"_k{i}": c for i, c in enumerate(base_spans(text))}).withColumn("_found", found)
    base = F.array_sort(F.concat(*[F.col(f"_k{i}") for i in range(len(BASE))]))
    rows = named.withColumn("_base", base).withColumn("_new", _uncovered(F.col("_found"), F.col("_base")))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", "_new"))).drop("_new")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null and empty texts have no spans; repeated rows are scanned each; spans of
    different kinds may overlap, ties in start follow the order of the kinds; an
    empty table gives no rows; other columns are ignored.
    """
    rows = with_spans(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *[F.size(f"_k{i}").cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(span_text(F.col("_base")), 256).alias("base_sha256"),
        span_text(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by ``mark``; n_chars follows.

    Null texts stay null and empty ones empty; repeated rows are masked each; an empty
    table gives no rows; other columns are kept as they are.
    """
    text = F.col("text")

    def cut(wide: Column, at: Column, n: Column) -> Column:
        """``n`` code points from ``at``, out of four bytes each (a string would be read from its
        start for every cut); the mark in front is the one that decoding takes away."""
        return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, at * 4 + 1, n * 4)), "UTF-32")

    def write(wide: Column, far: Column) -> Column:
        before = F.transform(F.col("_spans"), lambda s, i: F.struct(s["start"].alias("start"), F.when(i == 0, 0).otherwise(F.get(far, i - 1)).alias("at")))
        fresh = F.filter(before, lambda s: s["start"] >= s["at"])
        pieces = F.transform(fresh, lambda s: F.concat(cut(wide, s["at"], s["start"] - s["at"]), F.lit(mark)))
        last = F.element_at(far, -1)
        return F.concat(F.array_join(pieces, ""), cut(wide, last, F.length(text) - last))

    ends = _running(F.transform("_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    new = _let(F.encode(text, "UTF-32"), lambda wide: _let(ends, lambda far: write(wide, far)))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), text.cast("string").alias("text"))  # so that no column name clashes
    rows = with_spans(packed).withColumn("_new", F.when(F.size("_spans") > 0, new).otherwise(text))
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        chars = F.when(F.size("_spans") > 0, F.length("_new")).otherwise(F.col("_row.n_chars"))
        row = row.withField("n_chars", chars.cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(row.alias("_row")).select("_row.*")


def _sql_spans(name: str, pattern: str, group: int, kind: int, condition: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: {condition}), lambda i: struct_pack(
      s := CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT),
      k := {kind},
      e := CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))) AS BIGINT))) AS x
  FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d)
)"""


_ALLOWED = " OR ".join(f"regexp_matches(m[i], '{a.replace('++', '+')}')" for a in ALLOW)
_BITS = f"""list_max(list_transform(range(0, length(m[i]) - {WINDOW} + 1), lambda j: log2({WINDOW}.0) - list_sum(list_transform(
  list_distinct(string_split(m[i][j + 1:j + {WINDOW}], '')), lambda c: len(list_filter(string_split(m[i][j + 1:j + {WINDOW}], ''), lambda z: z = c)) * log2(CAST(len(list_filter(string_split(m[i][j + 1:j + {WINDOW}], ''), lambda z: z = c)) AS DOUBLE)))) / {WINDOW}.0))"""
_NAMES = "['assign', 'access', 'hex', 'entropy']"
_JOIN = f"array_to_string(list_transform({{}}, lambda z: {_NAMES}[z.k + 1] || ':' || z.s || ':' || z.e), ',')"
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        [
            _sql_spans("k0", BASE["assign"][0], 2, 0, "length(v[i]) >= 6"),
            _sql_spans("k1", BASE["access"][0], 0, 1, "length(m[i]) >= 20"),
            _sql_spans("k2", BASE["hex"][0], 0, 2, "length(m[i]) >= 24"),
            _sql_spans(
                "k3", CANDIDATE, 0, 3,
                f"regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]') AND NOT ({_ALLOWED}) AND round({_BITS}, 9) >= "
                f"CASE WHEN regexp_matches(m[i], '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN {HEX_BITS} ELSE {BASE64_BITS} END",
            ),
        ]
    )
    + f"""
, b AS (
  SELECT k0.doc_id, len(k0.x) AS n0, len(k1.x) AS n1, len(k2.x) AS n2, list_sort(list_concat(list_concat(k0.x, k1.x), k2.x)) AS base, k3.x AS more
  FROM k0 JOIN k1 USING (doc_id) JOIN k2 USING (doc_id) JOIN k3 USING (doc_id)
)
SELECT doc_id, CAST(n0 AS BIGINT) AS n_assign, CAST(n1 AS BIGINT) AS n_access, CAST(n2 AS BIGINT) AS n_hex,
  sha256({_JOIN.format('base')}) AS base_sha256,
  {_JOIN.format('list_sort(list_concat(base, list_filter(more, lambda s: len(list_filter(base, lambda q: q.s <= s.s AND s.e <= q.e)) = 0)))')} AS spans
FROM b
"""
)
