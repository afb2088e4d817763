import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from slidespark.llm import textops as T
from slidespark.llm import toxicity as X


def corpus(n, seed):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        lines = [" ".join(r.choice(plain) for _ in range(r.randint(3, 15))) for _ in range(r.randint(1, 12))]
        if bad:
            at = r.randrange(len(lines))
            lines[at] = f"{lines[at]} {r.choice(['vile', 'rotten', 'Horrid'])} thing"
        out.append((i, ". ".join(lines), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(800, 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9001, None, "s"), (9002, "", "s")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.digest(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} >= set(held) and len(held) > 100
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9001].score == got[9002].score == 0
    assert X.digest(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in X.digest(docs, labels.where("toxic = 0")).collect()} == {0}


def test_locates_the_sentence(spark):
    rows = corpus(600, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scorer = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    found = scorer.sentences("w1 w2 w3. w4 vile thing! w5 w6")
    assert [f["sentence"] for f in found] == ["w4 vile thing!"] or [f["sentence"].strip(" !") for f in found] == ["w4 vile thing"]
    assert X.locate(docs.limit(3), scorer).columns == ["doc_id", "text", "sentences"]


def test_noisy_or():
    scorer = X.Scorer(np.zeros(1, T.U64), np.array([-1.0]))
    got = scorer.scores(pa.array(["a. b. c", "a", None]))
    p = 1 / (1 + np.exp(1.0))
    assert np.allclose(got, [1 - (1 - p) ** 3, p, 0])


def test_slope_is_that_of_the_likelihood():
    r = np.random.default_rng(3)
    doc = np.sort(r.integers(0, 6, 20))
    doc[:6] = range(6)
    doc.sort()
    s, f = np.repeat(np.arange(20), 2), r.integers(0, 5, 40)
    pairs = np.unique(s * 5 + f)
    s, f = pairs // 5, pairs % 5
    label, w, b = r.integers(0, 2, 6), r.normal(size=5), -0.7
    p = lambda b, w: [1 - math.prod(1 - 1 / (1 + math.exp(-(b + sum(w[k] for i, k in zip(s, f, strict=True) if i == x)))) for x in range(20) if doc[x] == d) for d in range(6)]
    brute = lambda b, w: -np.mean([math.log(q if y else 1 - q) for q, y in zip(p(b, w), label, strict=True)])
    value, gw, gb = X.loss(b, w, s, f, doc, label)
    assert abs(value - brute(b, w)) < 1e-12
    e = 1e-6
    for k in range(5):
        step = np.eye(5)[k] * e
        assert abs(gw[k] - (brute(b, w + step) - brute(b, w - step)) / (2 * e)) < 1e-6
    assert abs(gb - (brute(b + e, w) - brute(b - e, w)) / (2 * e)) < 1e-6


def test_scores_match_brute_force(spark):
    rows = corpus(300, 4)
    texts = [t for _, t, _ in rows] + [None, "", " .!? ", "Vile\n\nVILE vile; Über-vile? naïve", "x " * 200_000 + "vile"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").repartition(3)
    scorer = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    known = dict(zip(scorer.words.tolist(), scorer.weights.tolist(), strict=True))

    def print_of(raw, salt=0):
        data = np.frombuffer(raw, np.uint8)
        return int(T.hash_spans(T.hash_prefix(data, T.LOWER_CODE), np.array([0]), np.array([len(raw)]))[0]) ^ salt

    def brute(text):
        harmless = 1.0
        for part in re.split(rb"[.!?\n\r]", (text or "").encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)
            if words:
                found = {print_of(w) for w in set(words)} | {print_of(w[:k], int(T.ODD[70 + k])) for w in set(words) for k in X.STEMS if len(w) >= k}
                harmless *= 1 - 1 / (1 + math.exp(-(scorer.weights[0] + sum(known.get(x, 0.0) for x in found))))
        return 1 - harmless

    got = X.score(docs, scorer).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        assert abs(x.score - brute(texts[x.doc_id])) < 1e-9, x.doc_id
