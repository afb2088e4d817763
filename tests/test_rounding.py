"""Queries that round: ties fall as in exact arithmetic and in DuckDB, in whatever order sums are made."""

from fractions import Fraction
from pathlib import Path

import pytest

from slidespark import registry
from slidespark.operators import labels
from slidespark.sources import fixtures as fx

from .differential import connect

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the shared tables are not here")


def test_ties_of_invariants(spark):
    shapes = {}
    for b in fx.blocks(spark, SF).collect():
        shapes.setdefault((b.slide_id, b.label), []).append((b.x, b.y))
    want = {}
    for k, p in shapes.items():
        n, sx, sy = len(p), sum(x for x, _ in p), sum(y for _, y in p)
        millionths = Fraction(sum(x * x + y * y for x, y in p) * n - sx * sx - sy * sy, n**3) * 10**6
        if millionths.denominator == 2:
            want[k] = (millionths + Fraction(1, 2)) / 10**6
    assert len(want) == 5
    for parts in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r.slide_id, r.label): r.hu1 for r in registry.queries()["region_invariants"](spark, SF).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert {k: got[k] for k in want} == {k: float(v) for k, v in want.items()}


def test_digits_of_bands_as_in_sql(spark):
    name = "nuclei_feature_bands"
    rel = connect(SF).sql(registry.oracle_sql()[name])
    own = registry.queries()[name](spark, SF).select(rel.columns).collect()
    key = lambda r: (r[0], r[1])
    assert rel.columns[:2] == ["slide_id", "label"]
    pairs = list(zip(sorted(map(tuple, own), key=key), sorted(rel.fetchall(), key=key), strict=True))
    assert [(a[:2], c, x, y) for a, b in pairs for c, x, y in zip(rel.columns, a, b, strict=True) if x != y] == []


def test_upright_labels_turn_one_way(spark):
    """Where the covariance is exactly 0 the angle hangs on no sum's rounding error."""
    t = fx.blocks(spark, "/root/testdata/sf0.1").where("(slide_id, label) IN ((1, 8), (88, 22), (97, 25), (98, 23))")
    for parts in (1, 7):
        got = {(r.slide_id, r.label): r.orientation for r in labels.moments(t.repartition(parts)).collect()}
        assert got == {(1, 8): 1.5708, (88, 22): 1.5708, (97, 25): 1.5708, (98, 23): 1.5708}
