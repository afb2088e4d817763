import random

import numpy as np

from slidespark.llm import decontam as D


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    items = [" ".join(word() for _ in range(r.randint(6, 60))) for _ in range(12)]
    items += [items[0] + " and more", "one two three", "one", None, "", "same same same same same same same same"]
    texts = []
    for i in range(40):
        w = [word() for _ in range(r.randint(0, 60))]
        t = items[i % 12].split()
        if r.random() < 0.5:
            t[r.randrange(len(t))] = word()
        if r.random() < 0.3:
            t = t[1:]
        at = r.randint(0, len(w))
        texts.append(" \n".join([*w[:at], *(x.upper() for x in t), *w[at:]]))
    return [*texts, None, "", "One two  three", "two three", "same " * 9, items[3], " ".join(items[5].split()[:-1])], items


def test_all_leaks(spark):
    texts, items = make(2)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = D.brute_force(texts, items)
    assert len(want) > 25
    for size in (D.BLOCK_BYTES, 300):
        assert {(r.id, r.item) for r in D.leaks(docs, bench, block_bytes=size).collect()} == want
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in D.digest(docs, bench).collect()] == [(None, 1, 1.0)]
    assert D.digest(docs, bench.limit(0)).count() == 0 and D.digest(docs.limit(0), bench).count() == 0
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]


def test_multi_index_finds_all_within_the_radius():
    r = np.random.default_rng(3)
    items = r.integers(0, 1 << 32, (40, 8), dtype=np.uint32)
    flips = lambda k: np.packbits(np.isin(np.arange(256), r.choice(256, k, replace=False))).view(np.uint32)
    prints = np.array([items[r.integers(40)] ^ flips(k) for k in [0, 1, 30, 60, 70, 71, 71, 71, 72, 90, 128] * 20])
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(items) if sum(int(a ^ b).bit_count() for a, b in zip(p, q, strict=True)) <= D.RADIUS}
    assert set(zip(*(x.tolist() for x in D.MultiIndex(items).within(prints)), strict=True)) == want
    assert len(want) >= 160


def test_fingerprints_choose_what_is_verified(monkeypatch):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [words(40) for _ in range(30)]
    # every text has some shingles of many items and leaks one of them
    texts = [[*words(5), *sum((t[:6] for t in items), []), *items[i], *words(20)] for i in range(10)]
    index = D.Index([" ".join(t) for t in items])
    seen, real = [], index._similarity
    monkeypatch.setattr(index, "_similarity", lambda *a: seen.append(1) or real(*a))
    data = "".join(" ".join(t) + "\n" for t in texts).encode()
    off = np.cumsum([0, *(len(" ".join(t)) + 1 for t in texts)])
    assert {(d, i) for d, i, _, _ in index.matches(np.frombuffer(data, np.uint8), off)} == {(i, i) for i in range(10)}
    assert len(seen) < 200  # of 36 items and windows times 200 places in each text


def test_long_and_repeated_texts(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(60)]
    long = [word() for _ in range(150_000)]
    long[140_000:140_000] = [*item[:12], word(), *item[12:]]
    rows = [(1, " ".join(long)), (2, "x " * 50_000 + " ".join(item)), (2, "x " * 50_000 + " ".join(item)), (3, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, "x " * 30)], "item_id long, text string")
    assert sorted((x.id, x.item) for x in D.leaks(docs, bench).collect()) == [(1, 7)] * 2 + [(2, 7)] * 4 + [(2, 8)] * 2 + [(3, 8)]
    assert [x.doc_id for x in D.clean(docs, bench).collect()] == []
