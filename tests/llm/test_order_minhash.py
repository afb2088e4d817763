import random

import numpy as np

from slidespark.llm import order_minhash as O


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        w = [word() for _ in range(r.randint(20, 140))]
        out.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = w[:]
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = word()
            if r.random() < 0.3:
                v = v[r.randint(0, 12) :]
            out.append("\n ".join(v))
    out += [" ".join([*passage, *(word() for _ in range(r.randint(5, 40)))]) for _ in range(25)]
    return [*out, None, "", " \n", "two words", "Two  WORDS", "a " * 300, "a " * 330, "a " * 200]


def test_classes_match_all_pairs(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, v string").repartition(3)
    want = O.brute_force(texts)
    got = {r.doc_id: r.class_id for r in O.digest(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = O.near_duplicates(df, small=2, mins=1).collect()
    assert [r.class_id for r in sorted(rows, key=lambda r: r.id)] == want


def test_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, None), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in O.digest(df).collect()) == [("5", "5"), ("5", "5"), ("9", "9"), ("None", "5"), ("None", "None")]
    assert O.digest(df.limit(0)).count() == 0


def test_short_texts_in_crowded_buckets(spark):
    texts = []
    for n in (8, 9, 12, 13):
        base = [f"w{n}x{i}" for i in range(n)]
        texts += [" ".join(base), *(" ".join([*base, f"e{n}x{i}"] if i % 2 else [f"e{n}x{i}", *base]) for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = O.brute_force(texts)
    assert len(set(want)) == 4
    assert [r.class_id for r in sorted(O.near_duplicates(df).collect(), key=lambda r: r.id)] == want


def test_buckets_left_open_are_compared_in_full(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(50)]
    texts = []
    for _ in range(15):
        own = [word() for _ in range(22)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:-3], word()])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = O.brute_force(texts)
    assert len(set(want)) == 15
    for mins, bands in ((3, 20), (1, 4)):
        rows = O.near_duplicates(df, small=2, mins=mins, bands=bands).collect()
        assert [r.class_id for r in sorted(rows, key=lambda r: r.id)] == want


def test_very_long_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    long = [word() for _ in range(80_000)]
    near = long[:]
    for _ in range(1000):
        near[r.randrange(len(near))] = word()
    far = [word() for _ in range(80_000)]
    texts = [" ".join(x) for x in (long, near, far, long[:40_000], ["same"], ["same"] * 90_000, ["same"] * 80_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.class_id for x in sorted(O.near_duplicates(df).collect(), key=lambda x: x.id)] == [0, 0, 2, 3, 4, 5, 5]


def test_sketches_do_not_hang_on_the_block(monkeypatch):
    x = O.labelled(*_buffer(" ".join(f"w{i}" for i in range(300))))[0]
    whole = O.sketches(x, 3, 20)
    monkeypatch.setattr(O, "AT_ONCE", 700)
    assert (O.sketches(x, 3, 20) == whole).all()


def test_bitmaps_bound_what_is_common():
    r = random.Random(2)
    for _ in range(30):
        x = [f"w{i}" for i in range(r.randint(8, 80))]
        y = [w if r.random() < 0.8 else f"v{i}" for i, w in enumerate(x)]
        (a, fa, _), (b, fb, _) = O.labelled(*_buffer(" ".join(x))), O.labelled(*_buffer(" ".join(y)))
        apart = int(np.bitwise_count((O.bitmaps(a, fa) ^ O.bitmaps(b, fb)).view(np.uint64)).sum())
        assert len(set(a.tolist()) & set(b.tolist())) <= (len(a) + len(b) - apart) / 2


def _buffer(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])
