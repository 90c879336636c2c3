"""Word splitting shared by the operators.

A word is ``[^\\x20\\x09-\\x0D]+``. ``bytes.split`` splits at exactly those six
ASCII characters, unlike ``str.split``, which also splits at Unicode spaces.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def coded_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch in order, dictionary-encoded, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.list_flatten(split)
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty words
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    groups = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(full).dictionary_encode(), groups.astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over a 64-bit hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Returns memory that was freed but is still held, as workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced_by_bytes(batches: Iterable[pa.RecordBatch], col: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column ``col``) have about ``size`` bytes; one
    row at least. Memory is given back after each incoming batch."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            base = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, base + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        give_back()
