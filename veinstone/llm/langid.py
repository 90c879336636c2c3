"""Language identification with a linear-chain conditional random field.

Words are labelled one by one, so text that switches languages is scored by its
parts. A word's evidence is the sum of learned weights of its affixes, its
character n-grams (hashed) and its entries in per-language lexicons; learned
transition weights tie neighbouring words together, and forward-backward gives
every word's posterior. A document's language is the one with the largest sum of
posteriors, its score that sum's share.

Training needs a bounded sample: ``Training.per_language`` labelled documents a
language, and of each ``spans`` runs of ``span_words`` words spread over its whole
text. Prediction covers whole texts: words are cut into chunks of 64, the chunks'
transfer matrices are multiplied side by side, a scan over chunks gives the exact
messages at their borders, and then all chunks are finished side by side. So the
cost of numpy calls depends on the chunk, not on the longest text.

:func:`label_words` returns where a text switches: runs of words with one language.
:func:`identify` sums the same posteriors up for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.text import coded_words, mixed, sliced_by_bytes

HASHED = 1 << 15
CHUNK = 64


@dataclass(frozen=True)
class Training:
    """The bound of the sample: ``per_language`` documents a language at most, ``spans`` runs of
    ``span_words`` words of each; and how the weights are learned."""

    per_language: int = 300
    spans: int = 6
    span_words: int = 32
    lexicon: int = 1500
    rounds: int = 40
    rate: float = 0.25
    decay: float = 1e-4
    switch: float = 0.5


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (HASHED + lexicon words, languages)
    lexicon: dict[str, int]
    transitions: np.ndarray
    start: np.ndarray


def letters_only(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}]+", ""))


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, word after word, and how many each has."""
    n = len(words)
    marked = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts, owner = ends - lengths, np.repeat(np.arange(n), lengths)
    place = np.arange(len(cp))
    ids, of = [], []
    roll = np.zeros(len(cp), dtype=np.uint64)
    for size in (1, 2, 3, 4):  # n-grams, whole ones only; longest ones only at the borders (affixes)
        roll[: len(cp) - size + 1] = roll[: len(cp) - size + 1] * np.uint64(0x100000001B3) + cp[size - 1 :] + np.uint64(size)
        ok = place + size <= ends[owner]
        if size == 1:
            continue
        if size == 4:
            ok &= (place == starts[owner]) | (place + size == ends[owner])
        ids.append((mixed(roll[ok]) % np.uint64(HASHED)).astype(np.int64))
        of.append(owner[ok])
    known = np.array([lexicon.get(w, -1) for w in words], dtype=np.int64)
    ids.append(HASHED + known[known >= 0])
    of.append(np.flatnonzero(known >= 0))
    ids_all, of_all = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return ids_all[order], np.bincount(of_all, minlength=n)


def evidence(model: Model, words: pa.Array, step: int = 60_000) -> np.ndarray:
    """Summed weights of each word; zero for words without letters."""
    out = np.zeros((len(words), len(model.languages)))
    listed = words.to_pylist()
    some = np.array([i for i, w in enumerate(listed) if w], dtype=np.int64)
    for at in range(0, len(some), step):
        part = some[at : at + step]
        ids, counts = features([listed[i] for i in part], model.lexicon)
        out[part] = np.add.reduceat(model.weights[ids], np.cumsum(counts) - counts, axis=0)
    return out


def messages(emission: np.ndarray, groups: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of every word (each scaled to sum 1) and the scaled
    evidence; ``groups``: words of each document."""
    n_labels = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True, initial=-np.inf)) if len(emission) else emission
    t, pi = np.exp(model.transitions - model.transitions.max()), np.exp(model.start - model.start.max())
    docs = np.flatnonzero(groups)
    sizes = groups[docs]
    chunks = -(-sizes // CHUNK)
    doc_of = np.repeat(np.arange(len(docs)), chunks)
    index = np.arange(len(doc_of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = np.repeat(np.cumsum(sizes) - sizes, chunks) + index * CHUNK
    length = np.minimum(CHUNK, np.repeat(sizes, chunks) - index * CHUNK)
    order = np.argsort(-length, kind="stable")  # at each step, the chunks that still run are the first ones
    begin, length, index, doc_of = begin[order], length[order], index[order], doc_of[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    live = [int(np.searchsorted(-length, -k, side="left")) for k in range(CHUNK)]  # chunks longer than k
    first = index == 0
    # transfer matrices of the chunks
    m = np.einsum("ij,nj->nij", t, e[begin]) if len(begin) else np.zeros((0, n_labels, n_labels))
    m[first] = np.einsum("ij,nj->nij", np.eye(n_labels), e[begin[first]])
    for k in range(1, CHUNK):
        c = live[k]
        if not c:
            break
        x = (m[:c].reshape(-1, n_labels) @ t).reshape(c, n_labels, n_labels) * e[begin[:c] + k][:, None, :]
        m[:c] = x / x.sum(axis=(1, 2), keepdims=True)
    # messages at the chunks' borders
    head, tail = np.empty((len(order), n_labels)), np.empty((len(order), n_labels))
    where = np.cumsum(chunks) - chunks
    by_chunks = np.argsort(-chunks, kind="stable")
    many = chunks[by_chunks]
    f = np.tile(pi / pi.sum(), (len(docs), 1))
    for k in range(int(many[0]) if len(many) else 0):
        c = int(np.searchsorted(-many, -k, side="left"))
        at = place[where[by_chunks[:c]] + k]
        head[at] = f[:c]
        x = np.einsum("ni,nij->nj", f[:c], m[at])
        f[:c] = x / x.sum(axis=1, keepdims=True)
    b = np.ones((len(docs), n_labels))
    for k in range(int(many[0]) - 1 if len(many) else -1, -1, -1):
        c = int(np.searchsorted(-many, -k, side="left"))
        at = place[where[by_chunks[:c]] + k]
        tail[at] = b[:c]
        x = np.einsum("nij,nj->ni", m[at], b[:c])
        b[:c] = x / x.sum(axis=1, keepdims=True)
    # inside the chunks
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    a = head
    for k in range(CHUNK):
        c = live[k]
        if not c:
            break
        x = (a[:c] if k == 0 else a[:c] @ t) * e[begin[:c] + k]
        if k == 0:
            rest = ~first[:c]
            x[rest] = (a[:c][rest] @ t) * e[begin[:c][rest]]
        a[:c] = x / x.sum(axis=1, keepdims=True)
        forward[begin[:c] + k] = a[:c]
    b = tail
    for k in range(CHUNK - 1, -1, -1):
        c = live[k]
        if not c:
            continue
        at = begin[:c] + k
        backward[at] = b[:c]
        x = (e[at] * b[:c]) @ t.T
        b[:c] = x / x.sum(axis=1, keepdims=True)
    return forward, backward, e


def posteriors(emission: np.ndarray, groups: np.ndarray, model: Model) -> np.ndarray:
    """Posterior of every label for every word; ``groups``: words of each document."""
    forward, backward, _ = messages(emission, groups, model)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, list[list[str]]]], how: Training) -> Model | None:
    """Train on (language, spans of letters-only words); None without samples.

    Sequences join spans of different documents (with probability ``switch``) so
    that the transitions see switches. Full-batch Adam on the conditional
    likelihood; everything is seeded, so equal samples give equal models.
    """
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    rng = np.random.default_rng(7)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in languages}
    for lang, spans in samples:
        for w in {w for s in spans for w in s}:
            counts[lang][w] = counts[lang].get(w, 0) + 1
    listed = {w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: how.lexicon] if n > 2}
    lexicon = {w: i for i, w in enumerate(sorted(listed))}
    vocabulary: dict[str, int] = {}
    flat = [(languages.index(lang), [vocabulary.setdefault(w, len(vocabulary)) for w in s]) for lang, spans in samples for s in spans if s]
    if not flat:
        return None
    order = rng.permutation(len(flat))
    codes, labels, groups, size, last = [], [], [], 0, rng.random(len(flat))
    for i, at in enumerate(order):
        lang, words = flat[at]
        codes += words
        labels += [lang] * len(words)
        size += len(words)
        if last[i] > how.switch or i == len(flat) - 1:
            groups.append(size)
            size = 0
    code, label, group = np.array(codes), np.array(labels), np.array(groups)
    ids, n_ids = features(list(vocabulary), lexicon)
    at = np.cumsum(n_ids) - n_ids
    k, n_words = len(languages), len(vocabulary)
    model = Model(languages, np.zeros((HASHED + len(lexicon), k)), lexicon, np.zeros((k, k)), np.zeros(k))
    starts = np.cumsum(group) - group
    inside = np.ones(len(code), dtype=bool)
    inside[starts] = False
    nxt = np.flatnonzero(inside)
    balance = (len(label) / (k * np.maximum(1, np.bincount(label, minlength=k))))[label]
    params = [model.weights, model.transitions, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, how.rounds + 1):
        words = np.add.reduceat(model.weights[ids], at, axis=0)
        e = words[code]
        forward, backward, scaled = messages(e, group, model)
        gamma = forward * backward
        gamma /= gamma.sum(axis=1, keepdims=True)
        residual = (np.eye(k)[label] - gamma) * balance[:, None]
        by_word = np.stack([np.bincount(code, residual[:, j], n_words) for j in range(k)], axis=1)
        per_id = np.repeat(by_word, n_ids, axis=0)
        g_w = np.stack([np.bincount(ids, per_id[:, j], len(model.weights)) for j in range(k)], axis=1)
        pair = forward[nxt - 1][:, :, None] * np.exp(model.transitions) * (scaled * backward)[nxt][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        g_t = np.bincount(label[nxt - 1] * k + label[nxt], minlength=k * k).reshape(k, k) - pair.sum(axis=0)
        g_s = np.bincount(label[starts], minlength=k) - gamma[starts].sum(axis=0)
        for p, g, (m1, m2) in zip(params, (g_w / len(code), g_t / len(code), g_s / len(code)), moments, strict=True):
            g = g - how.decay * p
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += how.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
    return model


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, how: Training) -> list[tuple[str, list[list[str]]]]:
    """At most ``per_language`` documents of each label, chosen by a hash of their id, and of
    each the spans; the only rows that reach the driver.

    The labels' counts (a row a language) become a threshold each, so that the draw is a
    filter next to the scan and only about twice the sample is ever shuffled."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))
    limits = F.create_map(*[F.lit(x) for r in sorted(counts) for x in (r.lang, min(1.0, 2.0 * how.per_language / r.n + 20.0 / r.n))])
    light = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), draw.alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    chosen = light.where(F.col("draw") < F.element_at(limits, F.col("lang"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= how.per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, spans = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in letters_only(pa.array(text.split(), pa.string())).to_pylist() if w]
                starts = np.unique(np.linspace(0, max(0, len(words) - how.span_words), how.spans).astype(int))
                if len(words) <= how.spans * how.span_words:
                    starts = range(0, len(words), how.span_words)
                langs.append(lang)
                spans.append([words[s : s + how.span_words] for s in starts])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.string())))], names=["lang", "spans"])

    found = chosen.select("lang", "text").mapInArrow(run, "lang string, spans array<array<string>>").collect()
    return sorted((r.lang, r.spans) for r in found)


def _word_posteriors(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word with a letter: its text, its place among the text's words, and the
    posterior of each language."""
    coded, groups = coded_words(texts)
    words = letters_only(coded.dictionary)
    lettered = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    use = lettered[codes]
    owner = np.repeat(np.arange(len(texts)), groups)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(groups) - groups, groups)
    owner, place = owner[use], place[use]
    return owner, place, posteriors(evidence(model, words)[codes[use]], np.bincount(owner, minlength=len(texts)), model)


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, first, last, lang: runs of neighbouring words (numbered from 0; words without a
    letter between two others go with the first) whose most probable language is the same.

    Null texts, texts without a letter and a missing model give no rows; repeated rows
    give theirs each; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced_by_bytes(batches, 1) if model is not None else ():
            owner, place, gamma = _word_posteriors(batch.column(1), model)
            label = gamma.argmax(axis=1)
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            same = np.append(owner[at[1:]] == owner[at[:-1]], False) if len(at) else np.zeros(0, bool)
            ends = np.append(at[1:], len(owner)) - 1 if len(at) else at
            last = place[ends]
            last[same] = place[at[1:][same[:-1]]] - 1 if len(at) else last[same]
            lang = pa.array([model.languages[x] for x in label[at].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner[at])), pa.array(place[at].astype(np.int64)), pa.array(last.astype(np.int64)), lang], names=["doc_id", "first", "last", "lang"]
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, first long, last long, lang string")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; ``und`` and 0 for texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced_by_bytes(batches, 2):
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if model is not None:
                owner, _, gamma = _word_posteriors(batch.column(2), model)
                total = np.stack([np.bincount(owner, gamma[:, j], n) for j in range(gamma.shape[1])], axis=1)
                some = np.flatnonzero(total.sum(axis=1))
                best = total.argmax(axis=1)
                scores[some] = np.clip(total[some, best[some]] / total[some].sum(axis=1), 0.0, 1.0)
                for i in some.tolist():
                    names[i] = model.languages[best[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def train(docs: DataFrame, how: Training | None = None) -> Model | None:
    """The model of the labelled documents that are not held out; None without any."""
    how = how or Training()
    return fit(training_sample(docs, how), how)


def identify(docs: DataFrame, how: Training | None = None) -> DataFrame:
    """Train on the labelled documents that are not held out and label every row.

    Null text and text without letters: ``und``. A null doc_id is not held out and
    never trains; a null lang never trains; without labelled rows everything is
    ``und``; repeated rows are labelled each; an empty table gives no rows; other
    columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    return predict(docs, train(docs, how))
