"""Quality rules with line labels by a linear-chain conditional random field.

Lines of a text (split at ``\\n``, those with a word) are labelled content or boilerplate by
Viterbi decoding over binary line features; a text is kept if content lines hold at least
``share`` of its words and the base rules pass (50 words or more, at most half of them in
repeated three-word windows).

Labels are of documents, so lines are labelled in ``RELABEL`` rounds of hard expectation and
maximisation: at first every line has its document's label and lines stand alone; the field is fitted by maximum
likelihood; then the lines of documents of bad quality are labelled by its Viterbi decoding (the
least likely line stays boilerplate where none would), those of good ones stay content, and the
field is fitted again. Bad documents with clean lines around junk give the transitions. The fit takes
at most ``sample`` labelled rows, those of least id hash (of more rows under these ids, those of least text hash), in one task.

Null, empty and wordless texts have zero counts and fail; without labels of both kinds every
line is content; rows with a null label are not used; repeated rows are judged alike; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

SAMPLE, SHARE, ROUNDS, RELABEL = 6000, 0.35, 80, 3
U64 = np.uint64


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


SYMBOL = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _table("0123456789")
MARK = _table("!?")
LEAD = np.ones(256, np.int64)
LEAD[0x80:0xC0] = 0
STOP = _table(".!?;:") > 0
NAMES = ("bias", "some_symbols", "more_symbols", "many_symbols", "upper", "digits", "marks", "short", "few", "long_line", "short_words", "long_words", "no_stop", "copy", "repeats", "half_repeats")


def base(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of each document, and its lines with their features."""
    d = len(off) - 1
    starts, ends, first = T.word_spans(data, off)
    n_words = np.diff(first)
    sums = lambda t: np.concatenate([[0], np.cumsum(t[data])])
    lead, symbol, upper, digit, mark = (sums(t) for t in (LEAD, SYMBOL, UPPER, DIGIT, MARK))
    doc = np.repeat(np.arange(d), n_words)
    out = {"n_words": n_words, "n_symbols": symbol[off[1:]] - symbol[off[:-1]]}
    per = lambda x, k: np.bincount(k, weights=x, minlength=d).astype(np.int64)
    chars = lead[ends] - lead[starts]
    out["word_chars"] = per(chars, doc)
    prefix = T.hash_prefix(data)
    words = T.hash_spans(prefix, starts, ends) if len(starts) else np.zeros(0, U64)
    covered = np.zeros(len(words) + 1, np.int64)
    repeated = np.zeros(len(words), bool)
    if len(words) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        grams = T.mix(words[inside] * T.ODD[2] + words[inside + 1] * T.ODD[3] + words[inside + 2] * T.ODD[4] + doc[inside].astype(U64) * T.ODD[5])
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        twice = np.zeros(len(g), bool)
        twice[1:] = g[1:] == g[:-1]
        twice[:-1] |= twice[1:]
        hit = inside[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, np.minimum(hit + 3, len(words)), -1)
        repeated = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = per(repeated, doc)
    # lines with a word
    newline = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([off, newline + 1]))
    lo, hi = edges[:-1], edges[1:].copy()
    hi -= (hi > lo) & (data[np.maximum(hi - 1, 0)] == 10) if len(hi) else 0
    count = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    lo, hi, count = lo[count > 0], hi[count > 0], count[count > 0]
    of = np.searchsorted(off, lo, "right") - 1
    same = T.hash_spans(prefix, lo, hi) + of.astype(U64) * T.ODD[6] if len(lo) else np.zeros(0, U64)
    order = np.argsort(same, kind="stable")
    copy = np.zeros(len(lo), bool)
    copy[order[1:]] = same[order[1:]] == same[order[:-1]]
    out["n_dup_lines"] = per(copy, of)
    w0, w1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    span = lambda s: s[hi] - s[lo]
    letters = np.maximum(1, np.concatenate([[0], np.cumsum(chars)])[w1] - np.concatenate([[0], np.cumsum(chars)])[w0])
    rep = np.concatenate([[0], np.cumsum(repeated)])
    rep = (rep[w1] - rep[w0]) / np.maximum(1, count)
    last = data[ends[w1 - 1] - 1] if len(lo) else np.zeros(0, np.uint8)
    mean = letters / np.maximum(1, count)
    f = [np.ones(len(lo)), span(symbol) > 0.1 * count, span(symbol) > 0.3 * count, span(symbol) > 0.5 * count, span(upper) > 0.4 * letters, span(digit) > 0.2 * letters, span(mark) > 0.5 * count, count < 3, count < 8, count > 40, mean < 3, mean > 12, ~STOP[last], copy, rep > 0, rep > 0.5]
    out["features"] = np.stack(f, axis=1).astype(float) if len(lo) else np.zeros((0, len(NAMES)))
    out["line_words"], out["line_first"] = count, np.searchsorted(of, np.arange(d + 1))
    out["line_at"] = lo
    return out


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]]) if len(size) else 0
    return order, first[:-1][order], np.searchsorted(-size[order], -np.arange(steps), "left")


def viterbi(weights: np.ndarray, move: np.ndarray, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True for every content line."""
    score = np.stack([np.zeros(len(features)), features @ weights], axis=1)
    _, at, active = _steps(first)
    out = np.zeros(len(features), bool)
    best, back = None, []
    for t, n in enumerate(active):
        now = score[at[:n] + t]
        if t:
            ways = best[:n, :, None] + move[None]
            back.append(ways.argmax(axis=1))
            now = now + ways.max(axis=1)
        best = now if best is None else np.concatenate([now, best[n:]])
    if best is None:
        return out
    state = best[: active[0]].argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        out[at[:n] + t] = state[:n] == 1
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    return out


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, relabel: int = RELABEL) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content against boilerplate, and the transition scores, from labels of documents."""
    k = features.shape[1]
    size = np.diff(first)
    y = np.repeat(label, size).astype(int)
    theta, move = np.zeros(k), np.zeros((2, 2))
    share = y.mean() if len(y) else 0.0
    weight = np.where(label, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))  # lines of both kinds of documents weigh alike
    if not len(y) or y.min() == y.max():
        return np.concatenate([[40.0], np.zeros(k - 1)]), move
    bad = np.flatnonzero(~label & (size > 0))
    of_bad = np.repeat(~label, size)
    for r in range(relabel + 1):
        theta, move = fit_lines(features, first, y, weight, theta, move, rounds, chain=r > 0)
        if r < relabel:
            y = np.where(of_bad, viterbi(theta, move, features, first), True).astype(int)
            score = features @ theta
            for d in (d for d in bad if y[first[d] : first[d + 1]].all()):
                y[first[d] + int(np.argmin(score[first[d] : first[d + 1]]))] = 0
    return theta, move


def fit_lines(features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray, move: np.ndarray, rounds: int = ROUNDS, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Both from labels of lines (1: content) and weights of documents, by gradient steps on the penalised likelihood of the label sequences; without ``chain`` transitions stay."""
    k = features.shape[1]
    size = np.diff(first)
    order, at, active = _steps(first)
    each, sorted_weight = np.repeat(weight, size), weight[order]
    inside = np.ones(len(y), bool)
    inside[first[:-1][size > 0]] = False
    pairs = np.bincount(y[:-1][inside[1:]] * 2 + y[1:][inside[1:]], weights=each[1:][inside[1:]], minlength=4)
    truth, n = features.T @ (each * y), max(1e-9, each.sum())
    m, v = np.zeros(k + 4), np.zeros(k + 4)
    for r in range(1, rounds + 1):
        e = np.exp(np.clip(np.stack([np.zeros(len(y)), features @ theta], axis=1), -30, 30))
        tr = np.exp(move)
        alphas, scales, a = [], [], None
        for t, n_t in enumerate(active):
            b = e[at[:n_t] + t]
            a = b if t == 0 else (a[:n_t] @ tr) * b
            s = a.sum(axis=1)
            a = a / s[:, None]
            alphas.append(a)
            scales.append(s)
        post, expected, later = np.zeros(len(y)), np.zeros((2, 2)), np.ones((0, 2))
        for t in range(len(active) - 1, -1, -1):
            beta = np.ones((active[t], 2))
            if t + 1 < len(active):
                q = active[t + 1]
                ahead = e[at[:q] + t + 1] * later / scales[t + 1][:, None]
                expected += (alphas[t][:q] * sorted_weight[:q, None]).T @ ahead * tr
                beta[:q] = ahead @ tr.T
            later = beta
            post[at[: active[t]] + t] = (alphas[t] * beta)[:, 1]
        grad = np.concatenate([truth - features.T @ (each * post), pairs - expected.ravel()]) / n - 1e-3 * np.concatenate([theta, move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * m / (1 - 0.9**r) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
        theta, move = theta + step[:k], move + chain * step[k:].reshape(2, 2)
    return theta, move


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fits the field on at most ``sample`` labelled rows of (doc_id, quality), in one task."""
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "label")  # at most `sample` ids

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            y = batch.column("label").to_numpy()
            for i, j, part, at in T.chunks(data, off):
                b = base(part, at)
                parts.append((b["features"], np.diff(b["line_first"]), y[i:j] > 0))
        f = np.concatenate([p[0] for p in parts] or [np.zeros((0, len(NAMES)))])
        first = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts] or [np.zeros(0, int)]))]).astype(int)
        theta, move = fit(f, first, np.concatenate([p[2] for p in parts] or [np.zeros(0, bool)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(theta) + 4)), pa.array(np.concatenate([theta, move.ravel()]))], names=["i", "w"])

    model = np.array([r.w for r in rows.orderBy(F.xxhash64("text"), "label").limit(sample).mapInArrow(fitted, "i long, w double").orderBy("i").collect()])
    if not len(model):
        model = np.concatenate([[40.0], np.zeros(len(NAMES) + 3)])
    return model[:-4], model[-4:].reshape(2, 2)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(id, counts, content_words, base_failed, kept) of every text."""
    weights, move = model
    kind = dict(docs.dtypes)[id_col]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            for i, j, part, at in T.chunks(data, off):
                b = base(part, at)
                content = viterbi(weights, move, b["features"], b["line_first"])
                of = np.repeat(np.arange(j - i), np.diff(b["line_first"]))
                good = np.bincount(of, weights=b["line_words"] * content, minlength=j - i).astype(np.int64)
                failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
                cols = [batch.column("id").slice(i, j - i), *(pa.array(b[c]) for c in COUNTS), pa.array(good), pa.array(failed), pa.array(~failed & (good >= share * b["n_words"]))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", *COUNTS, "content_words", "base_failed", "kept"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(f, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, content_words long, base_failed boolean, kept boolean")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, train(docs, labels)).withColumnRenamed("id", "doc_id")
