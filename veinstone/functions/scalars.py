"""Scalar column functions: buckets, risks, scores, rounding, identifiers, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, *steps: tuple[object, str], last: str) -> Column:
    """The label of the first step whose upper bound is not exceeded, else ``last``."""
    out = F.when(value <= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(value <= bound, label)
    return out.otherwise(last)


def loc_bucket(loc: Column) -> Column:
    """2.3.9: 0-19, 20-49, 50-99, 100+."""
    return ladder(loc, (19, "0-19"), (49, "20-49"), (99, "50-99"), last="100+")


def threshold_risk(value: Column, low: float, medium: float) -> Column:
    """2.3.16: low, medium or high by two inclusive bounds."""
    return ladder(value, (low, "low"), (medium, "medium"), last="high")


def complexity_risk(cc: Column) -> Column:
    """2.3.17."""
    return threshold_risk(cc, 10, 20)


def coupling_risk(cbo: Column) -> Column:
    """2.3.19."""
    return threshold_risk(cbo, 5, 10)


def cohesion_risk(lcom4: Column) -> Column:
    """2.3.21."""
    return threshold_risk(lcom4, 1, 3)


def cyclomatic(edges: Column, nodes: Column) -> Column:
    """2.3.14: max(1, E - N + 2)."""
    return F.greatest(F.lit(1), edges - nodes + 2)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def permille(part: Column, whole: Column) -> Column:
    """2.6.11: 1000 * part / whole rounded half-even, 0 without a whole."""
    return F.when(whole > 0, F.bround(part * F.lit(1000.0) / whole, 0)).otherwise(F.lit(0.0)).cast("int")


def grade(score: Column) -> Column:
    """2.6.10."""
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def clone_density_score(density: Column) -> Column:
    """2.6.8: piecewise linear through (0, 100), (.05, 90), (.20, 50), (.50, 0)."""
    d = F.greatest(F.lit(0.0), density)
    return (
        F.when(d <= 0.05, F.lit(100.0) - d / F.lit(0.05) * 10)
        .when(d <= 0.20, F.lit(90.0) - (d - 0.05) / F.lit(0.15) * 40)
        .when(d <= 0.50, F.lit(50.0) - (d - 0.20) / F.lit(0.30) * 50)
        .otherwise(F.lit(0.0))
    )


def tail_pressure(max_depth: Column, avg_depth: Column, p95: Column) -> Column:
    """2.6.9: depth beyond max(ceil(2 * average), p95 + 1)."""
    return F.greatest(F.lit(0), max_depth - F.greatest(F.ceil(avg_depth * 2), p95 + 1))


def source_kind(path: Column) -> Column:
    """2.3.41: tests, fixtures, production or other by the parts of a path."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "other")
        .when(path.rlike("(^|/)tests/fixtures(/|$)"), "fixtures")
        .when(path.rlike("(^|/)tests(/|$)"), "tests")
        .otherwise("production")
    )


def is_test_path(path: Column) -> Column:
    """2.3.42."""
    return source_kind(path).isin("tests", "fixtures") | path.rlike(r"(^|/)(conftest\.py|test_[^/]*)$")


def below(path: Column, root: str) -> Column:
    """A path relative to the root that it begins with; others stay."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 2**31 - 1)).otherwise(path)


def module_key(path: Column, root: str) -> Column:
    """2.1.2: path below root (its full path, as the files' paths begin) to a dotted module name."""
    name = F.regexp_replace(below(path, root), r"\.py$", "")
    return F.translate(F.regexp_replace(name, "/__init__$", ""), "/", ".")


def normal_line(line: Column) -> Column:
    """2.3.6 for text: lower case, numbers masked, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "0"), "[ \t]+", " ")


def statements(text: Column) -> Column:
    """Lines that are not blank, with their line numbers from 1."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), normal_line(x).alias("norm")))
    return F.filter(lines, lambda s: s["norm"] != "")


def raw_hash(text: Column) -> Column:
    """2.3.10: SHA-1 without white space."""
    return F.sha1(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", ""))


def token_estimate(text: Column) -> Column:
    """2.11.6: ceil(characters / 4)."""
    return F.ceil(F.length(text) / 4)


#: 2.11.1: masks in their fixed order (digest first, so that the UUID mask meets masked
#: groups) and prefixes that are stripped; fixed values.
CORPUS_MASKS = (
    (r"(?i)\b[a-f0-9]{8,64}\b", "<digest>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z\b", "<timestamp>"),
    (r"(?:/[A-Za-z0-9_./-]+|(?:[A-Za-z]:\\)[A-Za-z0-9_\\./-]+)", "<path>"),
)
TEMPLATE_PREFIXES = ("implement ", "fix ", "refactor ", "add ", "update ", "validate ")


def corpus_text(text: Column) -> Column:
    """2.11.1 without NFC (see functions.unicode): line ends, blanks, masks, prefix."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")
    for pattern, mask in CORPUS_MASKS:
        out = F.regexp_replace(out, pattern, mask)
    return F.regexp_replace(out, f"^(?i)(?:{'|'.join(TEMPLATE_PREFIXES)})", "")


def query_tokens(text: Column) -> Column:
    """2.11.2: lower-cased runs of word characters, '.', '/' and '-', edge dots
    stripped, two characters at least, first occurrences in order."""
    parts = F.transform(F.split(F.lower(text), r"[^a-z0-9_À-ɏ./-]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def joined_id(*parts: Column) -> Column:
    """2.11.8: SHA-256 of newline-joined parts."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def membership_digest(ids: Column) -> Column:
    """2.11.9: SHA-256 of the sorted ids."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)


def quoted(text: Column) -> Column:
    """Percent-encoding in which a space is %20."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A")


def identity_key(kind: Column, subject: Column, discriminator: Column) -> Column:
    """2.11.11: kind:subject:discriminator, quoted; null if any part is empty."""
    parts = [kind, quoted(subject), quoted(discriminator)]
    ok = (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(subject, F.lit("")) != "") & (F.coalesce(discriminator, F.lit("")) != "")
    return F.when(ok, F.concat_ws(":", *parts))


def scope_match(subject: Column, scope: Column) -> Column:
    """2.11.13: 1.0 equal, 0.8 one is a path or module prefix of the other, else 0."""
    below = [F.startswith(a, F.concat(b, F.lit(sep))) for a, b in ((subject, scope), (scope, subject)) for sep in ("/", ".")]
    return F.when(subject == scope, F.lit(1.0)).when(below[0] | below[1] | below[2] | below[3], F.lit(0.8)).otherwise(F.lit(0.0))


def first_containing(label: Column, rules: list[tuple[str, str]], last: str = "unknown") -> Column:
    """2.11.14: the family of the first rule whose token the lower-cased label contains."""
    low, out = F.lower(F.coalesce(label, F.lit(""))), None
    for token, family in rules:
        out = F.when(F.contains(low, F.lit(token)), family) if out is None else out.when(F.contains(low, F.lit(token)), family)
    return out.otherwise(last)


def preview(text: Column, limit: int = 240) -> Column:
    """2.11.15."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def noise_flags(text: Column, strength: Column) -> Column:
    """2.11.16."""
    return F.array_compact(
        F.array(
            F.when(F.length(text) < 40, "short"), F.when(F.length(text) > 800, "long"),
            F.when(F.regexp_count(text, F.lit("\n")) >= 2, "multi_paragraph"),
            F.when(F.regexp_count(F.lower(text), F.lit(r"(^|[ \n])(and|or|but|also)[ ,\n]")) >= 4, "compound"),
            F.when(F.startswith(text, F.lit("<")), "markup"), F.when(strength < 0.2, "weak"),
        )
    )


def euclidean(a: Column, b: Column) -> Column:
    """2.11.18."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normal(v: Column) -> Column:
    """2.11.19; a zero vector stays as it is."""
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    return _let(v, lambda w: _let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def round_signed(x: Column, digits: int) -> Column:
    """Halves away from zero over the product with a power of ten, as DuckDB does it; what a
    negative number rounds to keeps its sign, so there is a -0.0."""
    power = 10.0**digits
    size = F.floor(F.abs(x) * power + 0.5).cast("double") / power
    return F.when(x < 0, -size).otherwise(size)


def hash_embedding(text: Column, dims: int = 8) -> Column:
    """2.11.20: 4-byte pieces of SHA-256(text, NUL, counter) as [-1, 1], L2-normalised."""
    blocks = F.concat(*[F.sha2(F.concat(text, F.lit("\0"), F.lit(str(k))), 256) for k in range(-(-dims // 8))])
    word = lambda b, j: F.conv(F.substring(b, 1 + 8 * j, 8), 16, 10).cast("double")
    return l2_normal(_let(blocks, lambda b: F.array(*[word(b, j) / F.lit(4294967295.0) * 2 - 1 for j in range(dims)])))


def sql_fingerprint(sql: Column, limit: int = 200) -> Column:
    """2.11.21: one shape for statements that differ in literals."""
    out = F.trim(F.regexp_replace(F.lower(sql), r"[ \t\r\n]+", " "))
    for pattern, to in ((r"'[^']*'", "?"), ("0x[0-9a-f]+", "?"), (r"[0-9]+(\.[0-9]+)?", "?"), (r"\( ?\?( ?, ?\?)* ?\)", "(?)")):
        out = F.regexp_replace(out, pattern, to)
    return F.substring(out, 1, limit)


def sql_kind(sql: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(sql)), "^([a-z]+)", 1)


def sql_table(sql: Column) -> Column:
    return F.regexp_extract(F.lower(sql), "(?:from|into|update|join) +([a-z_][a-z0-9_.]*)", 1)


def duration_seconds(start: Column, end: Column) -> Column:
    """2.11.22: whole seconds, never negative; 0 for texts that are no timestamps."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(b) - F.unix_timestamp(a)), F.lit(0)).cast("long")


def complexity_score(declared: Column, events: Column, steps: Column) -> Column:
    """2.11.24."""
    return F.least(F.lit(100), F.least(F.lit(40), declared * 2) + F.least(F.lit(30), events * 3) + F.least(F.lit(20), steps * 2))


def as_int(value: Column, default: int = 0) -> Column:
    """2.11.27: integer value of a text, else the default."""
    return F.coalesce(F.expr("null") if value is None else F.try_to_number(value, F.lit("S999999999")).cast("int"), F.lit(default))
