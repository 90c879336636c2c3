"""Spelling variants, benchmark decontamination and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veinstone.llm import contamination, repair, variants


def table(df, cols=None) -> list[tuple]:
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# spelling variants


def plain_variants(rows, how: variants.Spelling) -> list[tuple]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if how.slip_every and h % how.slip_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= how.least_chars
    n = {w: c for w, c in count.items() if c >= how.least_n}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w in n:
        close = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(close, key=lambda v: (-n[v], v)) if close else None
        found[w] = (best if best and n[best] >= how.ratio * n[w] else None, len(close))
    out = []
    for w in n:
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, found[w][0], root, n[w], found[w][1], n.get(found[w][0])))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["aaaaaaa", "aaaaaaab", "Straßen", "STRAßEN", "naïve×÷ness"]
    long = "".join(rng.choice("abcdef") for _ in range(230))
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "en", "s", 0) for i in range(12)]
    rows += [(20, " ".join(["commonly"] * 60 + ["commanly"] * 4 + ["communly"] * 4 + ["ccommonly"] * 4 + ["cammanly"] * 2), None, None, None), (21, None, None, None, None), (None, "common naïve", None, None, None), (22, "", None, None, None)]
    rows += [(23, f"{long} {long} {long[:100] + long[101:]} {long[:100]}x{long[101:]} " * 12, None, None, None), (24, "x" * 300 + " " + "x" * 301 + " 日本x語 k", None, None, None)]
    rows += [(25, f"{long[:201]} {long[:200]} {long[:199]}! {long[:201]} " * 3, None, None, None), rows[3]]
    return rows


@pytest.mark.parametrize("how", [variants.Spelling(least_chars=4), variants.Spelling(least_chars=3, least_n=1, ratio=2, slip_every=7), variants.Spelling(slip_every=31)])
def test_variants(spark, spelled, how):
    docs = spark.createDataFrame(spelled, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    got = table(variants.group_variants(docs, how), cols)
    assert got == plain_variants(spelled, how)
    assert any(r[1] for r in got)


def test_long_words_have_names_that_tell_them_apart():
    w = "".join(random.Random(1).choice("abcd") for _ in range(500))
    less, first = variants.deletions(w)
    assert len(set(less)) == sum(first)
    assert all(variants.named(w[:i] + w[i + 1 :]) == less[i] for i in range(0, 500, 7))


# benchmark decontamination


def plain_hits(rows, items, words=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item_id, text in items:
        t = split(text)
        k = min(words, len(t))
        for i in range(len(t) - k + 1 if t else 0):
            windows[tuple(t[i : i + k])].add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text, *_ in rows:
        t, hit, found = split(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(t) - k + 1):
                if tuple(t[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(t[i : i + k])]
        out.append((doc_id, len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaked(rows):
    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "Delta", "the", "of", "日本", "x1", "dolor"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25]))) for i in range(15)]
    items += [(20, "the " * 12), (21, "of"), (22, None), (23, ""), (24, "!?"), (None, say(12)), (3, say(14)), (30, items[2][1]), (100, rows[3][1]), (101, rows[70][1])]
    texts = [say(40) + " " + items[i % 15][1].upper() + ". " + say(20) for i in range(20)] + ["the " * 40, "of", items[25 - 10][1].replace(" ", "-")]
    return [*rows, *[(1000 + i, t, None, None, None) for i, t in enumerate(texts)], (1000, texts[0], None, None, None)], items


HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_decontamination(spark, leaked, clashing, empty):
    rows, items = leaked
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert table(contamination.find_items(docs, bench), HITS) == plain_hits(rows, items)
    names = [F.lit(1).alias(c) for c in "term row pos w size terms start item offset rank n_words".split()]
    assert table(contamination.find_items(docs.select("*", *names), bench.select("*", *names)), HITS) == plain_hits(rows, items)
    assert contamination.find_items(empty, bench).count() == 0
    assert not any(r.contaminated for r in contamination.find_items(docs, bench.limit(0)).collect())


def test_proximity(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(3)] + [(7, "a a b"), (8, "g")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(25)]
    windows, owners = contamination.windows_of(spark.createDataFrame(items, "item_id long, text string"))
    stored = contamination.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame([(w,) for w in words], "term string"))
    heads = stored.where("term = ''").select("row", "doc_id")
    got = contamination.proximity_matches(windows, stored, 2).join(owners, "w").join(heads, "row").select("doc_id", "item_id", "start", "stop").collect()
    text = {d: t.split() for d, t in rows}
    for r in got:
        want = dict(items)[r.item_id].split()
        assert set(want) <= set(text[r.doc_id][r.start - 1 : r.stop]) and r.stop - r.start + 1 == len(want) + 2
    plain = {(d, i) for d, t in text.items() for i, s in items for k in range(len(t)) if set(s.split()) <= set(t[k : k + len(s.split()) + 2])}
    assert {(r.doc_id, r.item_id) for r in got} == plain


# conversation repair


def plain_repair(rows: list[tuple]) -> tuple:
    """The least (cost, audit) and the turns of one conversation's rows, by trying all edits of each
    row and up to two inserted turns before it."""
    shape = re.compile(r"(s?(ua)+)?")
    seen, best = set(), {"": (0, "", [])}
    turns = [t for t, _, _ in rows if t is not None]
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, 0, 0, 0, 0]
    counts[4] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    def prefix(roles: str) -> bool:  # of a legal sequence
        return any(shape.fullmatch(roles + more) for more in ("", "a", "ua"))

    def inserted(states: dict) -> dict:
        out = dict(states)
        for roles, (cost, audit, made) in states.items():
            for more in ("u", "a", "ua", "au"):
                if prefix(roles + more):
                    new = (cost + 3 * len(more), audit + "I" * len(more), made + [({"u": "user", "a": "assistant"}[m], "") for m in more])
                    out[roles + more] = min(out.get(roles + more, new), new, key=lambda v: v[:2])
        return out

    def merged(states: dict) -> dict:  # roles matter by their first and last letter alone
        out: dict = {}
        for roles, v in states.items():
            key = roles if len(roles) < 4 else roles[: 1 + (roles[0] == "s")] + roles[len(roles) - 2 :]
            key = ("s" if roles[:1] == "s" else "") + ("" if roles in ("", "s") else "u" if roles[-1] == "u" else "ua")
            out[key] = min(out.get(key, v), v, key=lambda x: x[:2])
        return out

    for _, role, text in rows:
        white = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not white else 2 if (role, text) in seen else 3 if white[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += fault > 0
        new: dict = {}
        for roles, (cost, audit, made) in inserted(best).items():
            options = [(roles, (cost + 4, audit + "D", made))]
            if fault in (0, 3):
                options += [(roles + role[:1], (cost + fault, audit + "K", [*made, (role, text)]))] if role else []
                options += [(roles + r[0], (cost + fault + 3, audit + "R", [*made, (r, text)])) for r in ("user", "assistant")]
            for to, v in options:
                if prefix(to):
                    new[to] = min(new.get(to, v), v, key=lambda x: x[:2])
        best = merged(new)
    cost, audit, made = min((v for k, v in inserted(best).items() if shape.fullmatch(k)), key=lambda v: v[:2])
    return counts, cost, audit, made


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Well", "Why?", " ", "", "One. \n", "\x0b\x0c", "日本。", "ok. ", None]
    rows = [
        (c, rng.choice([None, *range(8)]) if c % 7 == 0 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "USER"] if c % 3 == 0 else ["user", "assistant"]), rng.choice(texts) if c % 2 else f"Text {t} {c}.")
        for c in range(60)
        for t in range(rng.randint(1, 14))
    ]
    rows += [(None, t, "user", "Hm.") for t in range(3)] + [(100, t, ["system", "user", "assistant"][t] if t < 3 else ["user", "assistant"][(t + 1) % 2], f"Turn {t}.") for t in range(700)]
    rows += [(101, t, "user" if t % 3 else "system", f"t {t}!") for t in range(600)] + [(102, None, "user", "Q?"), (102, None, "assistant", "A."), (103, 1, "user", "Same."), (103, 1, "user", "Same.")]
    return rows


SHOWN = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows, ids) -> list[tuple]:
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv_id in ids:
        own = sorted(by[conv_id], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, cost, audit, made = plain_repair(own) if own else ([0] * 5, 0, "", [])
        out.append((conv_id, *counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair(spark, talks):
    turns = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    want = expected(talks, {r[0] for r in talks})
    assert table(repair.repair(turns), SHOWN) == want
    more = turns.select("*", *[F.lit(1).alias(c) for c in "cost audit fault hit copy again last k place".split()])
    assert table(repair.repair(more), SHOWN) == want
    assert repair.repair(turns.limit(0)).count() == 0
    made = defaultdict(list)
    for r in repair.repaired_turns(turns).orderBy("conv_id", "place").collect():
        made[r.conv_id].append((r.role, r.text))
    digests = {r[0]: r[-1] for r in want}
    assert all(hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made[c]).encode()).hexdigest() == d for c, d in digests.items())


def test_damage(spark, talks):
    turns = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    rows = []
    for conv_id, turn, role, text in talks:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(conv_id, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert table(repair.repair(repair.damage(turns)), SHOWN) == expected(rows, {r[0] for r in talks})


def test_grammar_must_be_left_linear():
    with pytest.raises(ValueError):
        repair.Grammar(rules=(("S", ("u", "S")), ("S", ("a",))), start="S", roles=())
    pairs = repair.Grammar(rules=(("S", ()), ("S", ("S", "u"))), start="S", roles=(("u", "user"),))
    chart = repair.Chart(pairs)
    for role in ("user", "tool", "user"):
        chart.read(role, "x", 0)
    assert chart.end()[:2] == (3, "KRK")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_benchmark_decontamination", "op13_conversation_repair"])
def test_new_queries_against_their_sql(spark, name):
    import os

    import duckdb

    from veinstone.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    run = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in run.description]
    assert table(queries.QUERIES[name](spark, folder), cols) == sorted(run.fetchall(), key=repr)
