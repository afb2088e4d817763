import itertools
import random
import re

import numpy as np

from slidespark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams, inside, seen, dup = {}, set(), set(), 0
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            inside |= {i + k for i in at for k in range(3)}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        lines = [" ".join(r.choice(["a", "bé", "c#", "<d>", "E!", "1|2"]) for _ in range(r.randint(0, 30))) + r.choice(["", ".", "\r"]) for _ in range(r.randint(0, 8))]
        lines += [r.choice(lines) for _ in range(r.randint(0, 3)) if lines]
        out.append("\n".join(lines))
    return [*out, None, "", "\n\n", "x " * 3000, "one\x0btwo\x0cthree\u00a0four", "same\nsame\nsame \n"]


def test_counts_match_brute_force(spark):
    t = texts(1)
    df = spark.createDataFrame([(i, x, 3) for i, x in enumerate(t)], "doc_id long, text string, kept int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(t))], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.digest(df, labels).collect()}
    for i, x in enumerate(t):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(x), repr(x)
        assert not (r.base_failed and r.kept)
    assert Q.digest(df.limit(0), labels).count() == 0
    assert Q.digest(df, labels.limit(0)).where("kept = base_failed").count() == 0


def test_viterbi_is_best():
    r = np.random.default_rng(3)
    first = np.array([0, 1, 5, 5, 8])
    f = r.normal(size=(8, 3))
    w, move = r.normal(size=3), r.normal(size=(2, 2))
    got = Q.viterbi(w, move, f, first)
    for a, b in itertools.pairwise(first):
        score = lambda s: sum(f[a + k] @ w * s[k] for k in range(b - a)) + sum(move[p, q] for p, q in itertools.pairwise(s))  # noqa: E731, B023
        if b > a:
            assert tuple(got[a:b].astype(int)) == max(itertools.product((0, 1), repeat=b - a), key=score)


def test_learns_junk(spark):
    r = random.Random(4)
    prose = lambda: "\n".join(" ".join(r.choice("alpha beta gamma delta rather other words".split()) + str(r.randint(0, 999)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(15)) + "." for _ in range(6))
    junk = lambda: "\n".join(" | ".join(str(r.randint(1, 9**9)) for _ in range(12)) for _ in range(8))
    rows = [(i, prose() if i % 2 else junk()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in Q.digest(df, labels).collect()}
    assert np.mean([got[i] == bool(i % 2) for i in range(100, 200)]) > 0.95


def test_lines_are_told_apart_inside_bad_texts(spark):
    r = random.Random(9)
    clean = lambda: " ".join(r.choice("alpha beta gamma delta rather other words".split()) for _ in range(14)) + "."
    junk = lambda: " | ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(14))
    odd = lambda: "\n".join(["a few words"] * 1)
    rows = [(i, "\n".join(clean() for _ in range(7)), 1) if i % 2 else (i, "\n".join([clean(), *(junk() for _ in range(3)), odd(), *(junk() for _ in range(3)), clean()]), 0) for i in range(200)]
    model = Q.train(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    text = rows[0][1].encode()
    b = Q.base(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = Q.viterbi(*model, b["features"], b["line_first"])
    assert got.tolist() == [True, *[False] * 7, True]
    weights, move = model
    assert move[0, 0] + move[1, 1] > move[0, 1] + move[1, 0]


def test_repeated_rows_and_clashing_names(spark):
    t = "word " * 30 + "\n" + "other thing " * 30
    df = spark.createDataFrame([(1, t, "k"), (1, t, "k"), (None, t, None)], "doc_id long, text string, content_words string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    out = Q.digest(df, labels).collect()
    assert len(out) == 3 and len({tuple(x)[1:] for x in out}) == 1
