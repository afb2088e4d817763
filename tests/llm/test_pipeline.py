import os
import random

import corpus_pipeline as P
from slidespark.llm import decontam, mixing, order_minhash, suffix_dedup, toxicity
from slidespark.sources import storage


def test_stages_match_brute_force(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, passage = prose(40), prose(60)
    texts = [prose(80) for _ in range(30)]
    texts += [texts[0], texts[1].replace(" ", "  "), " ".join(texts[2].split()[:-1])]
    texts += [f"{prose(30)} {item} {prose(10)}", *(f"{prose(60)} {passage} {prose(60)}" for _ in range(3)), None, "", "short one"]
    texts += [f"{prose(20)}. {word()} horrid vile. {prose(9)}" for _ in range(25)]
    toxic = [int(t is not None and "horrid" in t) for t in texts]
    docs = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    held = {i: t for i, t, *_ in docs}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns or k == len(P.STAGES) - 1
        out.write.parquet(f"{tmp_path}/out{k}")
        df = spark.read.parquet(f"{tmp_path}/out{k}")
        rows = [(x.doc_id, x.text) for x in df.collect()]
        ids = sorted(held)
        if name == "toxicity":
            want = {i: held[i] for i in ids if not toxic[i]}
        elif name == "near_dedup":
            lead = order_minhash.brute_force([held[i] for i in ids])
            want = {i: held[i] for n, i in enumerate(ids) if lead[n] == n}
        elif name == "suffix_dedup":
            kept = suffix_dedup.brute_force([held[i] for i in ids], keep_first=True)
            want = {i: held[i] if x == (held[i] or "").encode() else x.decode("utf-8", "ignore") for i, x in zip(ids, kept, strict=True) if x or not held[i]}
        elif name == "decontamination":
            bad = {ids[d] for d, _ in decontam.brute_force([held[i] for i in ids], [item])}
            want = {i: held[i] for i in ids if i not in bad}
        else:
            assert set(rows) <= set(held.items()) and max(rows.count(x) for x in rows) <= mixing.MOST
            continue
        assert len(rows) == len(want) and dict(rows) == want, name
        held = want
    assert toxicity.SAMPLE >= 5000
    assert P.run(spark, str(tmp_path)).count() == len(rows)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_rows_without_an_id(spark):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, passage = prose(80), prose(80), prose(60)
    near = lambda t: t.rsplit(" ", 1)[0]
    texts = [(None, a), (None, near(a)), (4, b), (None, near(b)), (4, near(near(b))), (None, None), (7, "")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], shape)
    got = [(x.doc_id, x.text) for x in P.drop_near_copies(spark, df, "").collect()]
    of = lambda *ts: [x for x in got if x[1] in ts]
    assert len(got) == 4 and len(of(a, near(a))) == 1 and (None, None) in got and (7, "") in got
    assert [i for i, _ in of(b, near(b), near(near(b)))] == [4]

    df = spark.createDataFrame([(None, f"{prose(60)} {passage} {prose(60)}", "en", "s", 1) for _ in range(3)], shape)
    cut = [x.text for x in P.cut_repeats(spark, df, "").collect()]
    assert sum(passage in t for t in cut) == 1


def test_odd_rows_pass_every_stage(spark, tmp_path):
    r = random.Random(6)
    long = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60_000))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None)] * 2 + [(1, long, "en", "s", None)] * 2 + [(1, "", None, None, 0), (2, "", "en", "s", 0), (3, "é " * 9, "en", "s", 18)]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/o{k}")
        df = spark.read.parquet(f"{tmp_path}/o{k}")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(df.count())
    assert sizes[:4] == [7, 5, 5, 5]
    assert {x.text for x in df.collect()} >= {long}


def test_sketches_of_near_copies_are_deleted(spark, tmp_path):
    at = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(6)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[0], texts[1] + " end", ""])]
    out = P.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert len(set(os.listdir(at)) - before) == 2  # the rows with their numbers, and the numbers of those that stay
    assert sorted(x.doc_id for x in out.collect()) == [0, 1, 2, 3, 4, 5, 8]
