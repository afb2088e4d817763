import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from slidespark.llm import hmm_lm as H


def test_forward_and_counts_match_enumeration():
    r = np.random.default_rng(4)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = H.Model(norm(r.random(3)), norm(r.random((3, 3))), norm(r.random((3, 5))))
    seqs = [[0, 1, 4, 2], [3], [2, 2, 0]]
    first = np.cumsum([0, *map(len, seqs)])
    ll, starts, moves, emits = m.forward(np.concatenate(seqs), first, True)
    want_s, want_m, want_e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for got, s in zip(ll, seqs, strict=True):
        paths = {}
        for p in itertools.product(range(3), repeat=len(s)):
            paths[p] = m.start[p[0]] * np.prod([m.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([m.emit[k, c] for k, c in zip(p, s, strict=True)])
        total = sum(paths.values())
        assert abs(got - math.log10(total)) < 1e-9
        for p, w in paths.items():
            want_s[p[0]] += w / total
            for a, b in itertools.pairwise(p):
                want_m[a, b] += w / total
            for k, c in zip(p, s, strict=True):
                want_e[k, c] += w / total
    assert np.allclose(starts, want_s) and np.allclose(moves, want_m) and np.allclose(emits, want_e)


def test_digest(spark):
    r = random.Random(1)
    langs = [["ab%d" % i for i in range(40)], ["xy%d" % i for i in range(40)]]
    texts = [" ".join(r.choice(langs[i % 2]) for _ in range(r.randint(5, 60))) + (" Odd%d" % i if i % 3 == 0 else "") for i in range(120)] + [None, "", " \n"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {x.doc_id: x for x in H.digest(df).collect()}
    words = [[w.decode() for w in (t or "").lower().encode().split()] + ["</s>"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    better = 0
    for i, ws in enumerate(words):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(x.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
        better += x.score > x.base_score
    assert better > 100
    assert H.digest(df.limit(0)).count() == 0


def test_long_and_repeated_texts(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.randint(5, 40))) for _ in range(60)]
    long = " ".join(f"w{r.randrange(50)}" for _ in range(150_000))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3]), (100, long), (101, long)]
    got = H.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for same in ([x for x in got if x.doc_id in (3, None)], [x for x in got if x.doc_id in (100, 101)]):
        assert len(same) >= 2 and len({(x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in same}) == 1
    assert {x.n_tokens for x in got if x.doc_id == 100} == {150_001} and all(x.score < 0 for x in got)


def test_bins_of_counts_keep_the_most_frequent(spark):
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate([5000, 4990, 2000, 30, 7, 7, 1, 1, 1])], "word long, rare int, n long")
    for most in (1, 2, 3, 4, 6, 9):
        least, words, _, _ = H._frequent(counts, most)
        kept = [i for i in words if i != int(H.END)]
        assert len(kept) <= most and kept == list(range(len(kept))) and least > (0 if most < 9 else -1)
