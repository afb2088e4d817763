"""Vectorised text primitives on UTF-8 buffers, shared by the corpus operators.

Texts are handled as one byte buffer per chunk with document offsets, so that
tokenising and hashing are a few numpy passes and never a Python loop over words.
Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; word
fingerprints fold ``A-Z`` to lower case. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_CODE = BYTE_CODE[LOWER]
ODD = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * U64(2) + U64(1)

_powers: dict[str, np.ndarray] = {}


def powers(name: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base (``base``) or of its inverse (``inverse``)."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), BASE if name == "base" else BASE_INV, U64)
        step[0] = 1
        have = np.cumprod(step, dtype=U64)
        if n <= CHUNK_BYTES + 1:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Splits items into runs of at most ``most`` bytes by their offsets, a longer item alone: (first, end)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits documents into such runs: (first, end, bytes, offsets)."""
    for i, j in slices(off, most):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each document's first word (with a closing one)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_prefix(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Prefix sums from which ``hash_spans`` takes the polynomial hash of any span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(code[data] * powers("base", len(data)), dtype=U64, out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers("inverse", len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U64) * ODD[0])


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words (``A-Z`` folded), and the first word of each document (with a closing one)."""
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, U64), first
    return hash_spans(hash_prefix(data, LOWER_CODE), starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``k`` words and the first one of each document (with a closing one).

    A document of 1 to ``k - 1`` words has one shingle, of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), n)
    pos = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    size = np.minimum(counts, k)[doc]
    out = size.astype(U64) * ODD[1]
    if len(words):
        for i in range(k):
            part = words[np.minimum(pos + i, len(words) - 1)] * ODD[2 + i]
            if i and len(size) and size.min() <= i:
                part = np.where(i < size, part, U64(0))
            out = out + part
    return mix(out), at


def occurrence_labels(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints that also hold how many equal ones came before in the same document."""
    if not len(x):
        return x
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((x, doc))
    same = np.zeros(len(x), bool)
    same[1:] = (x[order[1:]] == x[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    if not same.any():
        return x
    run = np.arange(len(x))
    start = np.maximum.accumulate(np.where(same, 0, run))
    count = np.empty(len(x), np.int64)
    count[order] = run - start
    return np.where(count > 0, mix(x + count.astype(U64) * ODD[40]), x)
