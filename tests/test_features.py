"""Feature tables against plain definitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.operators import features, graph, labels, spatial

SIX = [(-1.0, -1.0), (-1.0, 1.0), (1.0, -1.0), (1.0, 1.0), (-0.5, -0.5), (0.5, 0.5)]


def stats(x):
    x = np.asarray(x, float)
    while True:
        kept = x[np.abs(x - x.mean()) <= 3 * x.std() + 1e-12]
        if len(kept) == len(x):
            break
        x = kept
    m, s = x.mean(), x.std()
    return m, s, x.min() / x.max() if x.max() else 0.0, s / (m + s) if m + s else 0.0


def test_density_of_six_points(spark):
    radii, counts = [0.7 * k for k in range(1, 6)], (3, 5)
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(SIX)] + [(1, 9, *SIX[0])], "label int, vec_id long, cx double, cy double")
    got = {r.name: tuple(r)[3:] for r in graph.density(df, radii, counts).collect()}
    far = [sorted(math.dist(p, q) for q in SIX if q != p) for p in SIX]
    want = {f"neighbors_in_distance_{i}": stats([sum(d <= r for d in ds) for ds in far]) for i, r in enumerate(radii)}
    want |= {f"distance_for_neighbors_{i}": stats([ds[k - 1] for ds in far]) for i, k in enumerate(counts)}
    assert set(got) == set(want)
    for name, w in want.items():
        assert got[name] == pytest.approx(w), name
    names = [f"neighbors_in_distance_{i}" for i in range(5)] + ["distance_for_neighbors_0", "distance_for_neighbors_1"]
    row = graph.wide(graph.density(df, radii, counts), names).first()
    assert len(row) == 1 + 4 * 7 and row.density_neighbors_in_distance_4_mean == 5.0


def test_orientation_follows_the_long_side(spark):
    shapes = {1: [(0, x) for x in range(5)], 2: [(y, 0) for y in range(5)], 3: [(i, i) for i in range(5)], 4: [(i, -i) for i in range(5)], 5: [(0, 0)]}
    rows = [(1, y, x + 10, k) for k, at in shapes.items() for y, x in at]
    got = {r.label: r.orientation for r in labels.moments(spark.createDataFrame(rows, "slide_id int, y int, x int, label int")).collect()}
    assert got[1] == pytest.approx(math.pi / 2, abs=1e-5) or got[1] == pytest.approx(-math.pi / 2, abs=1e-5)
    assert got[2] == 0 and got[3] == pytest.approx(-math.pi / 4, abs=1e-5) and abs(got[4]) == abs(got[5]) == pytest.approx(math.pi / 4, abs=1e-5)


def test_nuclei_table_holds_every_block(spark):
    r = random.Random(3)
    px = [(1, y, x, r.randrange(256)) for y in range(24) for x in range(24)]
    objects = [(1, y, x, 1 + (x > 12)) for y in range(4, 12) for x in [*range(4, 10), *range(15, 20)]]
    px, objects = spark.createDataFrame(px, "slide_id int, y int, x int, i int"), spark.createDataFrame(objects, "slide_id int, y int, x int, label int")
    out = features.nuclei(px, objects, 24, 24, px, 3, 8)
    rows = {x.label: x.asDict() for x in out.collect()}
    assert set(rows) == {1, 2} and len(set(out.columns)) == len(out.columns)
    for side in ("nucleus", "cytoplasm"):
        assert sum(c.startswith(f"{side}_intensity") for c in out.columns) == 12
        assert sum(c.startswith(f"{side}_gradient") for c in out.columns) == 8
        assert sum(c.startswith(f"{side}_haralick") for c in out.columns) == 26
    assert {"orientation", "hu7", "fsd6", "perimeter", "solidity", "eccentricity"} <= set(out.columns)
    values = {k: [x.i for x in px.join(objects.where(F.col("label") == k), ["slide_id", "y", "x"]).collect()] for k in (1, 2)}
    for k in (1, 2):
        assert rows[k]["nucleus_intensity_mean"] == pytest.approx(np.mean(values[k]), abs=1e-5)
        assert rows[k]["nucleus_intensity_iqr"] == pytest.approx(np.quantile(values[k], 0.75) - np.quantile(values[k], 0.25), abs=1e-5)
        assert rows[k]["cytoplasm_intensity_mean"] is not None and rows[k]["nucleus_gradient_canny_sum"] >= 0


def test_spans_fill_rings(spark):
    r = random.Random(4)
    rings = {k: [(r.uniform(0, 30), r.uniform(0, 30)) for _ in range(r.randint(3, 9))] for k in range(20)} | {99: [(1.0, 1.0), (5.0, 1.0)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in rings.items()], "id int, points array<struct<x double, y double>>")
    got = {(q.id, q.y, x) for q in spatial.spans(spatial.ring_edges(df, "id"), "id").collect() for x in range(q.x0, q.x1 + 1)}
    want = set()
    for k, p in rings.items():
        for y, x in itertools.product(range(31), repeat=2):
            crossings = sum(1 for (xa, ya), (xb, yb) in zip(p, p[1:] + p[:1], strict=True) if min(ya, yb) <= y < max(ya, yb) and xa + (y - ya) * (xb - xa) / (yb - ya) > x)
            if crossings % 2:
                want.add((k, y, x))
    assert got == want
