import random
from collections import defaultdict

import pytest

from slidespark.llm import mixing as M

from ..differential import compare


def test_targets():
    got = M.targets([(None, 100), ("b", 1000), ("a", 10), ("c", 0)])
    assert [g[0] for g in got] == ["a", "b", "c", None]
    want = dict((s, t) for s, _, t in got)
    assert want["a"] == 30 and want["c"] == 0
    assert sum(want.values()) == pytest.approx(1110)
    assert want["b"] / want[None] == pytest.approx(2.0) or want[None] == 300
    assert M.targets([]) == [] and M.targets([("x", 0)]) == [("x", 0, 0.0)]


def docs(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i if i % 50 else None, " ".join("w" for _ in range(int(r.paretovariate(1.1)) % 3000)) if i % 17 else None, r.choice(["s1", "s2", "é", None]), 5) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long")


def test_near_targets_and_bounds(spark):
    df = docs(spark)
    rows = M.mix(df).collect()
    assert len(rows) == 400
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        last = [r.size for r in rs if r.size * M.TIERS[-1] <= rs[0].target]
        assert last and abs(sum(r.copies * r.size for r in rs) - rs[0].target) <= max(last) + 1
        assert all(r.copies * r.size <= M.MOST * r.size for r in rs)
        assert sorted(r["rank"] for r in rs) == list(range(1, len(rs) + 1))


def test_against_sql(spark, tmp_path):
    import duckdb

    df = docs(spark, seed=4).where("doc_id is not null")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(M.digest(spark.read.parquet(f"{tmp_path}/documents.parquet")), con, M.oracle()) == ""


def test_emit_and_empty(spark):
    t = [(1, "a b c", "x", "e")] * 3 + [(2, None, None, "e"), (None, "q " * 40, "y", "e")]
    df = spark.createDataFrame(t, "doc_id long, text string, source string, copies string")
    out = M.emit(df).collect()
    taken = {r.id: r for r in M.mix(df.drop("copies")).collect()}
    assert M.emit(df).columns == df.columns
    assert sum(r.doc_id is None for r in out) == taken[None].copies
    assert M.digest(df.limit(0)).count() == 0 and M.emit(df.limit(0)).count() == 0


def test_long_and_like_rows(spark):
    long = "word " * 300_000
    rows = [(1, long, "a"), *[(None, "b c", "a")] * 50, *[(i, "x y z", "b") for i in range(40)]]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 91 and max(r.size for r in out) == 300_000 and all(0 <= r.copies <= M.MOST for r in out)
    taken = lambda s: sum(r.copies * r.size for r in out if r.source == s)
    assert taken("b") == 360 and {r.target for r in out if r.source == "b"} == {360.0}
