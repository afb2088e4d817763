"""Language-model scores by a hidden Markov model over word classes.

A text is its words (``A-Z`` folded) and one end. The ``TOP`` most frequent words are classes
of their own, all others share ``RARE`` classes by their ending. States emit classes, a class
emits its words by their counts:

``P(text) = P(class sequence) * prod P(word | class)``

The first factor is the exact likelihood of the hidden Markov model by the scaled forward
recursion; the second uses the smoothed counts of all training words, an unseen word getting
the mass of one unseen type of its class. Counts, vocabulary and every Baum-Welch round cover
all training texts: each partition adds up its expected counts, blocks of which are summed
across partitions. Only the first guess comes from a bounded sample, of ``GUESS`` texts and of at most ``SPREAD``
tokens at even distances of each.

The base score is the add-0.1 unigram model with the same counts. Null, empty and wordless
texts are the end alone; without training texts all words are unknown; repeated rows score
alike; ids may be null or shared; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidespark.sources.storage import materialize

from . import textops as T

STATES, TOP, RARE, ROUNDS = 8, 16384, 512, 3
#: Words whose counts travel with the tasks (6 MB); the counts of all others are joined.
KNOWN = 1 << 18
SMOOTH = 0.1
#: Texts of the first guess, tokens of each at even distances, and tokens that are recursed over at once.
GUESS, SPREAD, BATCH = 400, 2000, 3 << 19
BLOCK = 1024
U64 = np.uint64
END = np.int64(0x0123456789ABCDEF)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word fingerprints, their rare classes, and the first word of each document."""
    starts, ends, first = T.word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), first
    prefix = T.hash_prefix(data, T.LOWER_CODE)
    tail = T.hash_spans(prefix, np.maximum(starts, ends - 3), ends)
    return T.signed(T.hash_spans(prefix, starts, ends)), (tail % U64(RARE)).astype(np.int32), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False)
        data, off = T.buffer(batch.column("text"))
        for i, j, part, at in T.chunks(data, off, 8 * T.CHUNK_BYTES):
            w, c, first = tokens(part, at)
            use = np.repeat(train[i:j], np.diff(first))
            u, index, n = np.unique(w[use], return_index=True, return_counts=True)
            rows = [np.append(u, END), np.append(c[use][index], -1).astype(np.int32), np.append(n, int(train[i:j].sum()))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["word", "rare", "n"])


@dataclass
class Known:
    """Frequent words in order of fingerprint: class, log10 of the base model, log10 within the class, and whether they occur."""

    words: np.ndarray
    cls: np.ndarray
    base: np.ndarray
    within: np.ndarray
    seen: np.ndarray


_CODED = "row long, pick long, id {}, train boolean, n_tokens long, base double, within double, known long, classes array<int>, odd array<struct<word long, rare int, times int>>"


def _encode(known: Known, classes: int):
    """Class sequence and sums over frequent words of each text, and its rare words with their numbers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            for i, j, part, at in T.chunks(data, off, 4 * T.CHUNK_BYTES):
                w, rare, first = tokens(part, at)
                d = j - i
                ends = first[1:]
                w = np.insert(w, ends, END)
                rare = np.insert(rare, ends, 0)
                first = first + np.arange(d + 1)
                place = np.minimum(np.searchsorted(known.words, w), len(known.words) - 1)
                hit = known.words[place] == w
                cls = np.where(hit, known.cls[place], classes + rare).astype(np.int32)
                doc = np.repeat(np.arange(d), np.diff(first))
                there, at_ = doc[hit], place[hit]
                sums = [np.bincount(there, weights=x[at_], minlength=d) for x in (known.base, known.within, known.seen)]
                odd = np.flatnonzero(~hit)
                order = odd[np.lexsort((w[odd], doc[odd]))]
                new = np.ones(len(order), bool)
                new[1:] = (w[order[1:]] != w[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                lead = order[new]
                times = np.diff(np.append(np.flatnonzero(new), len(order)))
                cut = pa.array(np.searchsorted(doc[lead], np.arange(d + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, d) for c in ("row", "pick", "id", "train")),
                        pa.array(np.diff(first)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array(sums[2].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(cls)),
                        pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays([pa.array(w[lead]), pa.array(rare[lead]), pa.array(times.astype(np.int32))], ["word", "rare", "times"])),
                    ],
                    names=["row", "pick", "id", "train", "n_tokens", "base", "within", "known", "classes", "odd"],
                )

    return f


class Model:
    """A hidden Markov model; sequences are recursed over together, the longest first, in order of time."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, cls: np.ndarray, first: np.ndarray, expect: bool = False):
        """Log10 likelihood of each sequence; with ``expect`` also the Baum-Welch counts, for which state shares are held in single precision."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        at, size = first[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(steps), "left")
        base = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        k, n_all = len(self.start), int(base[-1])
        which = np.arange(n_all) - np.repeat(base[:-1], active)  # the sequence of each place in order of time
        seen = cls[at[which] + np.repeat(np.arange(steps), active)]
        column, ones = np.ascontiguousarray(self.emit.T), np.ones(k)
        scale = np.empty(n_all)
        shares = np.empty((n_all, k), np.float32) if expect else None
        a = np.broadcast_to(self.start, (int(active[0]) if steps else 0, k))
        for t in range(steps):
            lo, hi = base[t], base[t + 1]
            a = a if t == 0 else a[: hi - lo] @ self.move
            a = a * column[seen[lo:hi]]
            s = a @ ones
            a /= s[:, None]
            scale[lo:hi] = s
            if expect:
                shares[lo:hi] = a
        out = np.zeros(len(order))
        out[order] = np.bincount(which, weights=np.log10(scale), minlength=len(order))
        if not expect:
            return out
        moves, back = np.zeros((k, k)), np.ascontiguousarray(self.move.T)
        later = None
        for t in range(steps - 1, -1, -1):
            lo, hi = base[t], base[t + 1]
            if later is not None:
                m = len(later)
                later *= column[seen[hi : hi + m]]
                later /= scale[hi : hi + m, None]
                moves += shares[lo : lo + m].T @ later
                beta = np.ones((hi - lo, k))
                np.matmul(later, back, out=beta[:m])
                shares[lo : lo + m] *= beta[:m]
                later = beta
            else:
                later = np.ones((hi - lo, k))
        starts = shares[: base[1]].sum(axis=0, dtype=float) if steps else np.zeros(k)
        emits = np.stack([np.bincount(seen, weights=shares[:, i], minlength=self.emit.shape[1]) for i in range(k)])
        return out, starts, moves * self.move, emits


def _batches(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Record batches together up to about ``most`` tokens, with their sequences end to end."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def joined():
        sizes = np.concatenate([np.diff(off) for _, _, off in held])
        return [b for b, _, _ in held], np.concatenate([c for _, c, _ in held]), np.concatenate([[0], np.cumsum(sizes)])

    tokens_held = 0
    for batch in batches:
        column = batch.column("classes")
        off = np.asarray(column.offsets).astype(np.int64)
        flat, off = column.flatten().to_numpy(), off - off[0]
        for i, j, cls, first in T.chunks(flat, off, most):
            if held and tokens_held + len(cls) > most:
                yield joined()
                held, tokens_held = [], 0
            held.append((batch.slice(i, j - i), cls, first))
            tokens_held += len(cls)
    if held:
        yield joined()


def _expected(model: Model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, v = model.emit.shape
        total, used = np.zeros((k, 1 + k + v)), False
        for _, cls, first in _batches(batches):
            _, starts, moves, emits = model.forward(cls, first, True)
            total[:, 0] += starts
            total[:, 1 : k + 1] += moves
            total[:, k + 1 :] += emits
            used = True
        if used:
            parts = [(i, total[:, i : i + BLOCK].ravel()) for i in range(0, total.shape[1], BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[1].tolist() for p in parts], pa.list_(pa.float64()))], names=["block", "sums"])

    return f


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            x = x.values.to_numpy()
            held[b] = held[b] + x if b in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], names=["block", "sums"])


def _model(total: np.ndarray, prior: np.ndarray) -> Model:
    """Smoothed estimates; ``prior`` (the classes' shares) keeps every class possible in every state."""
    k = len(total)
    start, move, emit = total[:, 0] + 1, total[:, 1 : k + 1] + 0.1, total[:, k + 1 :] + 5 * prior
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def guess(texts: list[list[int]], prior: np.ndarray, states: int) -> Model:
    """Cluster centres of a few texts, chosen far apart and refined, as emissions of slow states."""
    rows = np.zeros((len(texts), min(len(prior), 2048)))
    frequent = np.argsort(-prior)[: rows.shape[1]]
    place = np.full(len(prior), -1)
    place[frequent] = np.arange(len(frequent))
    for row, t in zip(rows, texts, strict=True):
        p = place[np.asarray(t, np.int64)]
        np.add.at(row, p[p >= 0], 1)
    rows = np.log1p(rows)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    centres = [rows.mean(axis=0)] if len(rows) else []
    for _ in range(states):
        if len(rows):
            centres.append(rows[np.argmin((rows @ np.array(centres).T / np.maximum(np.linalg.norm(centres, axis=1), 1e-9)).max(axis=1))])
    label = np.zeros(len(rows), int)
    for _ in range(8):
        if len(rows):
            label = np.argmax(rows @ np.array(centres[1:]).T / np.maximum(np.linalg.norm(centres[1:], axis=1), 1e-9), axis=1)
            centres[1:] = [rows[label == i].mean(axis=0) if (label == i).any() else centres[1 + i] for i in range(states)]
    emit = np.tile(prior, (states, 1)) * 50.0
    for t, i in zip(texts, label, strict=True):
        np.add.at(emit[i], np.asarray(t, np.int64), 1.0)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count above which at most ``most`` words stand, and these words, their rare classes and counts."""
    bin_ = F.when(F.col("n") < 1024, F.col("n")).otherwise(384 + F.floor(64 * F.log2("n"))).cast("long").alias("bin")
    sizes = sorted(counts.groupBy(bin_).agg(F.min("n").alias("n"), F.count("*").alias("v")).collect(), key=lambda r: -r.n)  # at most 5,000 bins of counts
    least, held = 1 << 62, 0
    for r in sizes:
        held += r.v
        if held > most:
            break
        least = r.n
    t = counts.where(F.col("n") >= least).toArrow()  # at most `most` rows
    word, rare, n = (t[c].to_numpy() for c in ("word", "rare", "n"))
    if END not in word:
        word, rare, n = np.append(word, END), np.append(rare, np.int32(-1)), np.append(n, counts.where(F.col("word") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    order = np.argsort(word)
    return least, word[order].astype(np.int64), rare[order], n[order].astype(float)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, top: int = TOP, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every text, learning from the rows where ``train`` holds."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("pick"), F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    counts = materialize(texts.select("train", "text").mapInArrow(_count, "word long, rare int, n long").groupBy("word").agg(F.max("rare").alias("rare"), F.sum("n").alias("n")).where("n > 0"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = whole.n, whole.v
    least, words, rare_of, held = _frequent(counts, known)
    # the most frequent words are classes of their own; all others share the rare ones
    own = np.zeros(len(words), bool)
    own[np.lexsort((words, -held))[:top]] = True
    own[words == END] = True
    few = counts.where((F.col("n") < least) & (F.col("word") != int(END)))
    class_n, class_v = (np.bincount(rare_of[~own], weights=w, minlength=RARE)[:RARE] if (~own).any() else np.zeros(RARE) for w in (held[~own], None))
    for r in few.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row for each rare class
        class_n[r.rare], class_v[r.rare] = class_n[r.rare] + r.n, class_v[r.rare] + r.v
    n_own = int(own.sum())
    cls = np.where(own, np.cumsum(own) - 1, n_own + np.maximum(rare_of, 0)).astype(np.int32)
    safe = np.maximum(rare_of, 0)
    within = np.where(own, 0.0, np.log10((held + SMOOTH) / (class_n[safe] + SMOOTH * (class_v[safe] + 1))))
    base = np.log10((held + SMOOTH) / (n_all + SMOOTH * (n_types + 1)))
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    coded = materialize(texts.mapInArrow(_encode(Known(words, cls, base, within, (held > 0).astype(float)), n_own), _CODED.format(kind)))

    mass = np.concatenate([held[own], class_n]) + 0.5
    prior = mass / mass.sum()
    chosen = [r.row for r in coded.where("train and n_tokens > 20").select("pick", "row").orderBy("pick", "row").limit(GUESS).collect()]  # numbers only: every partition offers as many
    sample = coded.where(F.col("row").isin(chosen)).select("pick", "row", F.expr(f"filter(classes, (c, i) -> i % ceil(size(classes) / {SPREAD}.0) = 0)").alias("c")).collect() if chosen else []
    sample.sort(key=lambda r: (r.pick, r.row))
    model = guess([r.c for r in sample], prior, states)
    for _ in range(rounds):
        blocks = coded.where("train").select("classes").mapInArrow(_expected(model), "block long, sums array<double>").repartition("block").mapInArrow(_added, "block long, sums array<double>").collect()  # one row for each block of classes
        total = np.zeros((states, 1 + states + len(prior)))
        for r in blocks:
            total[:, r.block : r.block + BLOCK] = np.array(r.sums).reshape(states, -1)
        model = _model(total, prior)

    plain = ("row", "id", "train", "n_tokens", "base", "within", "known")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, cls, first in _batches(batches):
            out, done = model.forward(cls, first), 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), pa.array(out[done : done + len(part)])], names=[*plain, "sequence"])
                done += len(part)

    scored = coded.select(*plain, "classes").mapInArrow(apply, f"row long, id {kind}, train boolean, n_tokens long, base double, within double, known long, sequence double")
    # words below the known ones: their counts come by a join, once for each text and word
    sizes = spark.createDataFrame([(i, float(class_n[i]), float(class_v[i])) for i in range(RARE)], "rare int, class_n double, class_v double")
    odd = coded.where(F.size("odd") > 0).select("row", F.explode("odd").alias("o")).select("row", "o.word", "o.rare", "o.times")
    odd = odd.join(few.select("word", "n"), "word", "left").join(F.broadcast(sizes), "rare")
    n, times = F.coalesce("n", F.lit(0)), F.col("times")
    odd = odd.groupBy(F.col("row").alias("odd_row")).agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("odd_known"),
        F.sum(times * F.log10((n + SMOOTH) / (n_all + SMOOTH * (n_types + 1)))).alias("odd_base"),
        F.sum(times * F.log10((n + SMOOTH) / (F.col("class_n") + SMOOTH * (F.col("class_v") + 1)))).alias("odd_within"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = scored.join(odd, F.col("row") == F.col("odd_row"), "left")
    return out.select("id", "train", "n_tokens", (F.col("known") + F.coalesce("odd_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + z("odd_base")).alias("base_score"), (F.col("sequence") + F.col("within") + z("odd_within")).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    out = score(docs, ~held_out)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
