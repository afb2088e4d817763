import os
import random

import pytest

from slidespark.llm import suffix_dedup as S
from slidespark.sources import storage


def corpus(seed: int) -> list[str | None]:
    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, other = make(300), make(210)
    out = [make(r.randint(0, 500)) for _ in range(15)]
    for i in range(6):
        out.append(make(r.randint(0, 80)) + passage + make(r.randint(0, 80)))
        out.append(make(r.randint(0, 80)) + passage[r.randint(0, 60) : 300 - r.randint(0, 60)] + make(40) + other)
    return [*out, out[3], out[3] + "x", None, "", "a" * 900, "ab" * 300, "y" + "ab" * 120, passage[:199], passage[:200], other + other]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("open_at_once", [2000, 2])
def test_against_brute_force(spark, keep_first, open_at_once):
    texts = corpus(5)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in S.remove_repeats(df, keep_first=keep_first, open_at_once=open_at_once).collect()}
    want = S.brute_force(texts, keep_first=keep_first)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert bytes(got[i].kept) == want[i], i
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].n_removed == got[i].n_bytes - len(want[i])


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(1, "z" * 300), (2, "short"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.digest(df).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (300, 1, S.sha256(b""))
    assert got[2].kept_sha256 == S.sha256(b"short") and got[None].n_bytes == 0
    assert S.digest(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    r = random.Random(1)
    row = (7, "".join(r.choice("abcdefgh") for _ in range(400)))
    df = spark.createDataFrame([row, row, (8, "tail")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.digest(df).collect()) == [(7, 400), (7, 400), (8, 0)]
    assert sum(r.n_removed for r in S.remove_repeats(df).collect()) == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_very_long_text_comes_in_pieces(spark, keep_first):
    r = random.Random(6)
    make = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = make(90)
    long = make(S.PIECE - 50) + passage + make(100_000) + passage + make(S.PIECE)
    texts = [long, make(50) + passage, "é" + long[S.PIECE - 30 : S.PIECE + 30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: bytes(x.kept) for x in S.remove_repeats(df, length=40, keep_first=keep_first).collect()}
    assert [got[i] for i in range(3)] == S.brute_force(texts, 40, keep_first)


def test_shared_and_null_ids(spark):
    r = random.Random(7)
    make = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = make(300)
    df = spark.createDataFrame([(i, make(60) + passage + make(60)) for i in (None, None, 5, 5)], "doc_id long, text string")
    out = S.remove_repeats(df).collect()
    assert sorted(x.n_removed > 0 for x in out) == [False, True, True, True]
    assert [x.doc_id for x in out if not x.n_removed] == [None]


@pytest.mark.parametrize("keep_first", [False, True])
def test_spans_are_all_that_is_left_on_disk(spark, keep_first):
    at = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    texts = corpus(8)
    out = S.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_first=keep_first)
    assert len(set(os.listdir(at)) - before) == 1
    assert [bytes(r.kept) for r in sorted(out.collect())] == S.brute_force(texts, keep_first=keep_first)
