"""Best-fit packing of tokenised documents into fixed-length sequences.

Vector best-fit, decreasing: every piece demands tokens, one document slot and
attention cost (its length squared); every open sequence has a residual of
each. Among the sequences that can take a piece under every constraint, the one
with the best weighted score is chosen: the largest dot product of demand and
residual, or the smallest norm of what would be left.

Pieces are numbered by falling length and dealt in turn into blocks of about ``block``
pieces, so that every block has all lengths in the same proportion and repeated
documents part; each block is packed by itself, so memory is bounded by a block whatever the corpus; a block
wastes at most its last open sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.text import sliced_by_bytes
from veinstone.operators.windows import numbered
from veinstone.session import batch_bytes, cut_lineage

#: Bytes of texts that a worker holds and splits at once.
BYTES = 4_000_000
#: Words whose ids are laid out at once; a longer text's are as many as it has.
WORDS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Words of these characters need no Unicode tables to be split and lower-cased.
_PLAIN = r"^[\x21-\x7E\x{C0}-\x{FF}]+$"
#: The pre-tokens of such a word, lower-cased.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[0-9]|[^a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}\s]+"


class Ragged:
    """Rows of ids in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def pick(self, rows: np.ndarray) -> Ragged:
        """The given rows, in the given order."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - ends + lengths, lengths)
        return Ragged(self.flat[at], lengths)

    def joined(self, groups: np.ndarray) -> Ragged:
        """Consecutive rows joined: groups[i] rows make row i."""
        ends = np.concatenate([[0], np.cumsum(groups)])
        total = np.concatenate([[0], np.cumsum(self.lengths)])
        return Ragged(self.flat, total[ends[1:]] - total[ends[:-1]])


class WordEncoder:
    """Token ids of texts, with each distinct word of a batch encoded once.

    Valid for tokenizers that drop white space and end every pre-token with an
    end-of-word token, so that a text's ids are its words' ids in a row. Words of
    plain Latin letters, digits and punctuation are split into pre-tokens by Arrow,
    whose ids are kept in two generations of ``limit`` pieces; all other words are given to the
    tokenizer as they are.
    """

    def __init__(self, path: str, limit: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.limit = limit

    def _learn(self, pieces: list[str]) -> None:
        """One call for many pieces; the end-of-word ids say where each ends."""
        for at in range(0, len(pieces), 5_000):
            part = pieces[at : at + 5_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer does not end every pre-token with an end-of-word token")
            raw, begin = ids.tobytes(), 0
            for p, stop in zip(part, (stops * 4).tolist(), strict=True):
                self.pieces[p] = raw[begin:stop]
                begin = stop

    def _rows(self, found: list[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64))

    def _pieces(self, pieces: list[str]) -> Ragged:
        if len(self.pieces) > self.limit:  # what the last generation used is carried over piece by piece
            self.before, self.pieces = self.pieces, {"": b""}
        found = [self.pieces.get(p) for p in pieces]
        if None in found:
            missing = [p for p, x in zip(pieces, found, strict=True) if x is None]
            kept = {p: x for p in missing if (x := self.before.get(p)) is not None}
            self.pieces |= kept
            self._learn([p for p in missing if p not in kept])
            found = [self.pieces[p] for p in pieces]
        return self._rows(found)

    def _words(self, words: pa.Array) -> Ragged:
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
        spaced = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _PIECE, r"\0 ")
        split = pc.ascii_split_whitespace(spaced)
        coded = pc.list_flatten(split).dictionary_encode()
        ids = self._pieces(coded.dictionary.to_pylist()).pick(coded.indices.to_numpy())
        ids = ids.joined(pc.list_value_length(split).to_numpy())
        odd = [
            np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for w in words.filter(pc.invert(plain)).to_pylist()
        ]
        other = self._rows(odd)
        both = Ragged(np.concatenate([ids.flat, other.flat]), np.concatenate([ids.lengths, other.lengths]))
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(mask), dtype=np.int64)
        place[mask], place[~mask] = np.arange(len(ids.lengths)), len(ids.lengths) + np.arange(len(odd))
        return both.pick(place)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.list_flatten(split).dictionary_encode()
        words, places = self._words(coded.dictionary), coded.indices.to_numpy()
        groups = pc.list_value_length(split).to_numpy()
        upto = np.concatenate([[0], np.cumsum(groups, dtype=np.int64)])
        at = 0
        while at < len(groups):  # a few texts at once: an id takes 4 bytes, its place among all words' ids 8 and more
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + WORDS, side="right")) - 1)
            rows = words.pick(places[upto[at] : upto[stop]]).joined(groups[at:stop])
            for start, length in zip(rows.starts.tolist(), rows.lengths.tolist(), strict=True):
                yield rows.flat[start : start + length].tobytes()
            at = stop


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document's ids are its text's ids and then ``end_id``. A null or empty text
    gives the end id alone. Repeated rows give repeated pieces.
    """
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced_by_bytes(batches, 1, BYTES):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1)), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold. A limit of None never binds."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    score: str = "norm"  # or "dot"


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece: vector best-fit over falling lengths.

    Ties go to the sequence opened first. A piece that breaks a limit by itself
    gets a sequence of its own; tokens never exceed the capacity.
    """
    n = len(lengths)
    documents = cap.documents or cap.tokens
    attention = cap.attention or cap.tokens**2
    full = np.array([cap.tokens, documents, attention], dtype=np.float64)
    weights = np.array(cap.weights) / full**2
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    smallest = int(lengths.min()) if n else 0
    residual = np.zeros((n, 3))
    open_ids = np.zeros(n, dtype=np.int64)
    count = opened = 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        at = -1
        if count:
            left = residual[:count]
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                if cap.score == "dot":
                    at = fits[np.argmax((left[fits] * need * weights).sum(axis=1))]
                else:
                    at = fits[np.argmin((((left[fits] - need) ** 2) * weights).sum(axis=1))]
        if at < 0:
            at = count
            residual[at], open_ids[at] = full, opened
            count, opened = count + 1, opened + 1
        sequence[i], offset[i] = open_ids[at], cap.tokens - int(residual[at, 0])
        residual[at] -= need
        if residual[at, 0] < smallest or residual[at, 1] < 1 or residual[at, 2] < smallest**2:
            count -= 1  # closed: nothing left can enter
            residual[at], open_ids[at] = residual[count], open_ids[count]
    return sequence, offset


def pack_pieces(pieces: DataFrame, cap: Capacity, block: int = 4096) -> DataFrame:
    """sequence_id and offset for every piece; needs doc_id, piece, start, length, ids_crc32.
    Pieces without a doc_id are packed like others, and repeated rows each; an empty table
    gives no rows."""
    total = pieces.count()
    blocks = max(1, -(-total // block))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        keys = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").to_numpy(), table.column("ids_crc32").to_numpy()))
        sequence, offset = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        sequence[keys], offset[keys] = best_fit(lengths[keys], cap)
        first = int(table.column("_block")[0].as_py()) << 32
        return (
            table.drop_columns(["_block"])
            .append_column("sequence_id", pa.array(sequence + first, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
        )

    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece"), F.asc("ids_crc32")]
    dealt = numbered(pieces, order, "_place", "long").withColumn("_block", F.col("_place") % blocks).drop("_place")
    return dealt.groupBy("_block").applyInArrow(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity | None = None, block: int = 4096) -> DataFrame:
    """Documents to packed pieces. See :func:`tokenize_pieces` and :func:`best_fit`.

    Null text counts as empty, null doc_id stays null, repeated rows are packed
    each, an empty table gives no rows, other columns are ignored. The pieces
    (five numbers each) are checkpointed once, because their number sets the
    number of blocks.
    """
    cap = cap or Capacity()
    with batch_bytes(docs.sparkSession, BYTES):
        pieces = cut_lineage(tokenize_pieces(docs, tokenizer, cap.tokens))
    return pack_pieces(pieces, cap, block)
