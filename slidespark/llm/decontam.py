"""Benchmark decontamination: item-sized windows by SimHash, verified by weighted shingles.

A window has as many shingles (five words, ``A-Z`` folded) as a benchmark item, or all of a shorter
document. Shingles weigh as often as they occur; the similarity of window and item is the sum of
smaller weights over the sum of larger ones, and 0.8 or more is a leak.

Windows that hold a shingle of an item of their size get a 256-bit SimHash fingerprint from prefix
sums (a window without one has similarity 0). A multi-index over the fingerprints of the items of
each size gives the candidates: 8 blocks of 32 bits, of which two fingerprints within ``RADIUS`` have one
that differs in at most ``RADIUS // 8`` bits, so that all items within the radius are found; unlike ones
share such a block with chance 0.03 and are then told apart by the whole distance. Candidates,
and nothing else, are verified exactly. Two sets of similarity 0.8 have 8/9 of each in common, so a bit
differs with chance 0.151, 38.7 of 256 on average with deviation 5.7: beyond the radius of 71 with chance 1e-7.
Repeated shingles bend that angle, so windows and items in which shingles repeat are verified without it.

The benchmark is read in blocks of at most ``block_bytes`` of text, each one pass over the
documents with its index in the tasks; every document is searched whole. Results: null,
empty and wordless texts and items never match; items under five words match equal runs of
words only; documents shorter than an item are one window; repeated rows and items give
repeated results; a null item id stays null; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

THRESHOLD = 0.8
SHINGLE = 5
RADIUS = 71
BLOCK_BYTES = 16 << 20
#: Fingerprints are so many words of 64 bits, and twice as many blocks of the multi-index.
PARTS = 4
#: Windows that are fingerprinted at once.
AT_ONCE = 4096
U64 = np.uint64
_BITS = np.arange(64, dtype=U64)


def signs(x: np.ndarray) -> np.ndarray:
    """A row of 256 signs for each shingle."""
    words = np.stack([T.mix(x ^ T.ODD[80 + i]) for i in range(PARTS)], axis=1)
    return (((words[:, :, None] >> _BITS) & U64(1)).astype(np.int8) * 2 - 1).reshape(len(x), 64 * PARTS)


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of sums of signs, as rows of 32-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint32)


class MultiIndex:
    """Fingerprints by their blocks."""

    def __init__(self, prints: np.ndarray):
        self.blocks = np.ascontiguousarray(prints.T)  # one row for each block

    def within(self, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, indexed fingerprint) of all pairs within the radius."""
        each = radius // len(self.blocks)
        maybe = np.zeros((len(prints), self.blocks.shape[1]), bool)
        for block, ours in zip(self.blocks, prints.T, strict=True):
            maybe |= np.bitwise_count(ours[:, None] ^ block[None, :]) <= each
        row, item = np.nonzero(maybe)
        near = np.bitwise_count(prints[row] ^ self.blocks.T[item]).sum(axis=1) <= radius
        return row[near], item[near]


@dataclass
class Item:
    shingles: np.ndarray
    counts: np.ndarray
    words: int


class Index:
    """All items of one block of the benchmark."""

    def __init__(self, texts: list[str | None], threshold: float = THRESHOLD):
        self.threshold = threshold
        data, off = T.buffer(pa.array(texts, pa.string()))
        words, first = T.word_hashes(data, off)
        x, at = T.shingle_hashes(words, first, SHINGLE)
        self.items, keys, owners = [], [], []
        by_size: dict[int, list[int]] = {}
        for i in range(len(texts)):
            s, n = x[at[i] : at[i + 1]], int(first[i + 1] - first[i])
            u, c = np.unique(s, return_counts=True)
            self.items.append(Item(u, c, n))
            keys.append(u)
            owners.append(np.full(len(u), i))
            if n >= SHINGLE:
                by_size.setdefault(len(s), []).append(i)
        self.classes = {n: (np.array(of), MultiIndex(np.concatenate([pack(signs(x[at[i] : at[i + 1]]).sum(axis=0, dtype=np.int32)[None]) for i in of])), np.array([len(self.items[i].shingles) < n for i in of])) for n, of in by_size.items()}
        self.size = np.diff(at)
        key, owner = np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(owners or [np.zeros(0, int)])
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        self.keys, self.at, self.times = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = max(16, int(4 * max(1, len(self.keys))).bit_length() + 4)
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._low(self.keys)] = True
        self.short = sorted({t.words for t in self.items if 0 < t.words < SHINGLE})

    def _low(self, x: np.ndarray) -> np.ndarray:
        return (x & U64((1 << self.bits) - 1)).astype(np.int64)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) for every shingle that an item has."""
        pos = np.flatnonzero(self.maybe[self._low(x)])
        k = np.minimum(np.searchsorted(self.keys, x[pos]), max(0, len(self.keys) - 1))
        same = self.keys[k] == x[pos] if len(self.keys) else np.zeros(0, bool)
        pos, k = pos[same], k[same]
        times = self.times[k]
        into = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(pos, times), self.owner[np.repeat(self.at[k], times) + into]

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(document, item, similarity, first word of the best window) of all leaks."""
        words, first = T.word_hashes(data, off)
        x, at = T.shingle_hashes(words, first, SHINGLE)
        out = []
        pos, item = self.hits(x)
        if len(pos):
            doc = np.searchsorted(at, pos, "right") - 1
            touched = np.unique(np.stack([doc, self.size[item], pos], axis=1), axis=0)
            edges = np.flatnonzero(np.concatenate([[True], (touched[1:, :2] != touched[:-1, :2]).any(axis=1), [True]]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d, n = int(touched[i, 0]), int(touched[i, 1])
                if n in self.classes:
                    out += [(d, *found) for found in self._best(x, touched[i:j, 2], n, int(at[d]), int(at[d + 1]))]
        for m in self.short:
            y, start = T.shingle_hashes(words, first, m)
            pos, item = self.hits(y)
            enough = np.diff(first) >= m
            doc = np.searchsorted(start, pos, "right") - 1
            seen = set()
            for d, i, p in zip(doc.tolist(), item.tolist(), pos.tolist(), strict=True):
                if self.items[i].words == m and enough[d] and (d, i) not in seen:
                    seen.add((d, i))
                    out.append((d, i, 1.0, p - int(start[d])))
        return out

    def _best(self, x: np.ndarray, pos: np.ndarray, size: int, lo: int, hi: int) -> list[tuple[int, float, int]]:
        """(item, similarity, start) of the best window of each item of a size, from the places of the shingles that such items have."""
        n = min(size, hi - lo)
        if n < self.threshold * size - 1e-9:
            return []
        items, index, bent = self.classes[size]
        best: dict[int, tuple[float, int]] = {}
        first, last = np.maximum(lo, pos - n + 1), np.minimum(pos, hi - n)
        new = np.flatnonzero(np.concatenate([[True], first[1:] > np.maximum.accumulate(last)[:-1] + 1]))
        for s, e in zip(first[new].tolist(), np.maximum.accumulate(last)[np.concatenate([new[1:], [len(last)]]) - 1].tolist(), strict=True):
            for u in range(s, e + 1, AT_ONCE):
                v = min(e, u + AT_ONCE - 1)
                for w, i in self._candidates(x[u : v + n], n, index, bent):
                    k = int(items[i])
                    if best.get(k, (0.0, 0))[0] < 1 and (score := self._similarity(x[u + w : u + w + n], k, size)) >= self.threshold - 1e-12 and score > best.get(k, (0.0, 0))[0]:
                        best[k] = (score, u + w - lo)
        return [(k, score, start) for k, (score, start) in best.items()]

    def _candidates(self, x: np.ndarray, n: int, index: MultiIndex, bent: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) in order of the window: those near by fingerprint, and all where shingles repeat."""
        sums = np.zeros((len(x) + 1, 64 * PARTS), np.int32)
        np.cumsum(signs(x), axis=0, out=sums[1:])
        order = np.argsort(x, kind="stable")
        back = np.full(len(x), n)
        same = x[order[1:]] == x[order[:-1]]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
        repeats = np.concatenate([[0], np.cumsum(back < n)])
        odd = repeats[n:] - repeats[:-n] > 0
        every = odd[:, None] | bent[None, :]
        w, i = index.within(pack(sums[n:] - sums[:-n]))
        every[w, i] = True
        yield from zip(*(part.tolist() for part in np.nonzero(every)), strict=True)

    def _similarity(self, window: np.ndarray, item: int, size: int) -> float:
        t = self.items[item]
        z, c = np.unique(window, return_counts=True)
        k = np.minimum(np.searchsorted(t.shingles, z), len(t.shingles) - 1)
        common = int(np.minimum(c, t.counts[k])[t.shingles[k] == z].sum())
        return common / (len(window) + size - common)


_held: dict[str, Index] = {}


def _index(token: str, texts: list[str | None], threshold: float) -> Index:
    """The index of a block, made once in each worker."""
    if token not in _held:
        _held.clear()
        _held[token] = Index(texts, threshold)
    return _held[token]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item, score, start) of every document and item with a window of similarity ``threshold`` or more."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    blocks, out = max(1, -(-volume // block_bytes)), None
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item", "text").collect()  # at most about block_bytes
        ids, texts, token = [r.item for r in held], [r.text for r in held], uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts, token=token) -> Iterator[pa.RecordBatch]:
            index = _index(token, texts, threshold)
            for batch in batches:
                data, off = T.buffer(batch.column("text"))
                for i, _, part, at in T.chunks(data, off):
                    found = index.matches(part, at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array([i + m[0] for m in found], pa.int64())),
                            pa.array([ids[m[1]] for m in found], pa.int64()),
                            pa.array([m[2] for m in found], pa.float64()),
                            pa.array([m[3] for m in found], pa.int64()),
                        ],
                        names=["id", "item", "score", "start"],
                    )

        part = source.mapInArrow(search, f"id {kind}, item long, score double, start long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a leak. Rows are told apart by id and a hash of the text, nulls included."""
    marked = docs.withColumn("__key", F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")))
    bad = leaks(marked, benchmark, "__key", text_col).select(F.col("id.i").alias("__i"), F.col("id.h").alias("__h")).distinct()
    return marked.join(bad, F.col("__key.i").eqNullSafe(F.col("__i")) & (F.col("__key.h") == F.col("__h")), "left_anti").drop("__key")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "start")


def brute_force(texts: list[str | None], items: list[str | None], threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """(document, item) of all leaks, from every window."""
    from collections import Counter

    split = lambda t: (t or "").encode().lower().split()
    grams = lambda w: Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))
    out = set()
    for d, text in enumerate(texts):
        words = split(text)
        for i, item in enumerate(items):
            t = split(item)
            if not words or not t:
                continue
            for s in range(max(1, len(words) - len(t) + 1)):
                a, b = grams(words[s : s + len(t)]), grams(t)
                if len(t) < SHINGLE:
                    if words[s : s + len(t)] == t:
                        out.add((d, i))
                elif sum((a & b).values()) >= (threshold - 1e-12) * sum((a | b).values()):
                    out.add((d, i))
    return out
