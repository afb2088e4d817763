"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learnt from document labels.

A sentence is a run between ``.``, ``!``, ``?`` and line ends that has a word; its score is
logistic in the set of its words (runs of letters, digits and non-ASCII bytes, ``A-Z``
folded) and of their first bytes, which join the forms of a stem. A document is toxic unless all its sentences are harmless:
``p = 1 - prod(1 - p_s)``. With ``z`` the sentence's logit, ``-log(1 - p)`` is the sum of
``softplus(z)``, which gives the exact gradient of the document's likelihood; an L1 penalty
keeps only words that carry evidence. ``locate`` returns the offending sentences.

The classifier is fitted on at most ``sample`` labelled rows, those of least id hash (of more rows under these ids, those of least text hash), in one
task; everything else reads all rows. Results: null, empty and wordless texts have score 0;
without labelled rows of both kinds all scores are the share of toxic labels (0 if there are
none); rows with a null label are not used; a labelled id that several documents share labels
them all; repeated rows score alike; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 8000
#: A feature is fitted if so many toxic documents have it and its log odds are so high.
LEAST_DOCS, LEAST_ODDS = 3, 1.0
ROUNDS = 150
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 6)
BREAK = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n\r"]] = True
U64 = np.uint64


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of words and stems with the sentence of each, and for each sentence its document and first byte."""
    starts, ends, first = T.word_spans(data, off, BREAK)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    prefix = T.hash_prefix(data, T.LOWER_CODE)
    words = [T.hash_spans(prefix, starts, ends)]
    stops = np.cumsum(STOP[data])[starts]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    at = [sentence]
    for k in STEMS:
        long = np.flatnonzero(ends - starts >= k)
        words.append(T.hash_spans(prefix, starts[long], starts[long] + k) ^ T.ODD[70 + k])
        at.append(sentence[long])
    return np.concatenate(words), np.concatenate(at), doc[new], starts[new]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def loss(bias: float, weight: np.ndarray, s: np.ndarray, f: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean negative log likelihood of the documents' labels, and its slope in the weights and the bias; ``s`` and ``f`` pair sentences with features."""
    n = len(label)
    z = bias + np.bincount(s, weights=weight[f], minlength=len(doc))
    total = np.maximum(np.bincount(doc, weights=_softplus(z), minlength=n), 1e-9)
    value = np.where(label > 0, -np.log(-np.expm1(-total)), total).mean()
    pull = np.where(label > 0, -1 / np.expm1(total), 1.0) / n
    g = pull[doc] / (1 + np.exp(-z))
    return float(value), np.bincount(f, weights=g[s], minlength=len(weight)), float(g.sum())


def fit(data: np.ndarray, off: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word fingerprints and their weights; the bias stands under fingerprint 0."""
    n = len(off) - 1
    rate = float(label.mean()) if n else 0.0
    # documents that have each feature, and toxic ones, chunk by chunk
    vocab, has, bad = np.zeros(0, U64), np.zeros(0), np.zeros(0)
    for i, _, part, at in T.chunks(data, off):
        w, s, d, _ = sentences(part, at)
        u, index = np.unique(w, return_inverse=True)
        pairs = np.unique(d[s] * max(1, len(u)) + index)
        k = pairs % max(1, len(u))
        both = np.concatenate([vocab, u])
        vocab, index = np.unique(both, return_inverse=True)
        has = np.bincount(index, weights=np.concatenate([has, np.bincount(k, minlength=len(u))]), minlength=len(vocab))
        bad = np.bincount(index, weights=np.concatenate([bad, np.bincount(k, weights=label[i + pairs // max(1, len(u))], minlength=len(u))]), minlength=len(vocab))
    if not 0 < rate < 1 or not len(vocab):
        return np.zeros(1, U64), np.array([-40.0 if rate <= 0 or not len(vocab) else 40.0])
    odds = np.log((bad + 10 * rate) / (has - bad + 10 * (1 - rate))) - np.log(rate / (1 - rate))
    use = (bad >= LEAST_DOCS) & (odds >= LEAST_ODDS)
    v, weight = vocab[use], odds[use] * 0.5
    parts, docs, shift = [], [], 0
    for i, _, part, at in T.chunks(data, off):
        w, s, d, _ = sentences(part, at)
        place = np.minimum(np.searchsorted(v, w), max(0, len(v) - 1))
        known = v[place] == w if len(v) else np.zeros(len(w), bool)
        parts.append(np.unique((s[known] + shift) * (len(v) + 1) + place[known]))
        docs.append(d + i)
        shift += len(d)
    pairs, doc = np.concatenate(parts), np.concatenate(docs)
    s, f = pairs // (len(v) + 1), pairs % (len(v) + 1)
    bias = np.log(rate / (1 - rate)) - np.log(max(1.0, len(doc) / n)) - 2
    penalty, step = 2e-4 * n ** 0.5 / 90, 0.05
    m1, m2, b1, b2 = np.zeros(len(v)), np.zeros(len(v)), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, gw, gb = loss(bias, weight, s, f, doc, label)
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        scale = step / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-5)
        weight -= scale * m1 / (1 - 0.9**t)
        weight = np.sign(weight) * np.maximum(np.abs(weight) - scale * penalty, 0)
        bias -= step * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-5)
    used = weight != 0
    order = np.argsort(v[used])
    return np.concatenate([np.zeros(1, U64), v[used][order]]), np.concatenate([[bias], weight[used][order]])


class Scorer:
    """Applies a fitted model to buffers of texts."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.words, self.weights = words, weights
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(words & U64(0xFFFF)).astype(np.int64)] = True

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, document and first byte of each sentence."""
        w, s, doc, at = sentences(data, off)
        hit = np.flatnonzero(self.maybe[(w & U64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, w[hit]), len(self.words) - 1)
        known = self.words[place] == w[hit]
        pairs = np.unique(s[hit[known]] * len(self.words) + place[known])
        z = self.weights[0] + np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=len(doc))
        return z, doc, at

    def scores(self, column) -> np.ndarray:
        data, off = T.buffer(column)
        out = np.zeros(len(off) - 1)
        for i, j, part, at in T.chunks(data, off):
            z, doc, _ = self.logits(part, at)
            out[i:j] = -np.expm1(-np.bincount(doc, weights=_softplus(z), minlength=j - i))
        return out

    def sentences(self, text: str | None, least: float = 0.5) -> list[dict]:
        raw = (text or "").encode()
        data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        z, _, at = self.logits(data, off)
        ends = [*at[1:].tolist(), len(raw)]
        return [{"sentence": raw[a:b].decode(errors="ignore").strip(), "score": float(p)} for a, b, p in zip(at.tolist(), ends, 1 / (1 + np.exp(-z)), strict=True) if p >= least]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """A scorer fitted on at most ``sample`` labelled rows, in one task."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("text"), "label")  # at most `sample` ids

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("label", pa.int32())]))
        data, off = T.buffer(table["text"])
        words, weights = fit(data, off, (table["label"].to_numpy() > 0).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(words)), pa.array(weights)], names=["word", "weight"])

    model = rows.orderBy(F.xxhash64("text"), "label").limit(sample).mapInArrow(fitted, "word long, weight double").collect()
    words, weights = np.array([r.word for r in model], np.int64).view(U64), np.array([r.weight for r in model])
    if not len(words):
        words, weights = np.zeros(1, U64), np.array([-40.0])
    order = np.argsort(words)
    return Scorer(words[order], weights[order])


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of every text."""
    names = [c for c in docs.columns if c != to]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scorer.scores(batch.column("__text")))], names=[*names, to])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(f, f"{fields}, `{to}` double")


def locate(docs: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Adds ``sentences``, the offending ones with their scores."""

    names = [c for c in docs.columns if c != "sentences"]
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.sentences(x.as_py(), least) for x in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, kind)], names=[*names, "sentences"])

    fields = "".join(f"`{n}` {t}, " for n, t in docs.select(*names).dtypes)
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(f, f"{fields}sentences array<struct<sentence string, score double>>")


def fold(id_: Column, n: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % n


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scorer = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = score(docs.select("doc_id", "text"), scorer)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
