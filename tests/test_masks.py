"""Tissue, contours, unions and gradient fields against plain definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidespark.functions import raster
from slidespark.operators import spatial, stains, tiles, tissue

from .test_raster import flood


def otsu(values):
    """The first of 256 bins after which the variance between both kinds is largest; the middle of the bin."""
    lo, hi = values.min(), values.max()
    if lo == hi:
        return lo
    bins = np.minimum((values - lo) / ((hi - lo) / 256), 255).astype(int)
    best = max((round((bins <= t).sum() * (bins > t).sum() * (bins[bins <= t].mean() - bins[bins > t].mean()) ** 2, 4), -t) for t in np.unique(bins)[:-1])
    return lo + (-best[1] + 0.5) * (hi - lo) / 256


def smooth(im, sigma):
    half = max(1, int(4 * sigma + 0.5))
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (1, 0):
        p = np.pad(im, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        im = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, p)
    return im


@pytest.mark.parametrize("steps, sigma", [(1, 0.0), (2, 1.0)])
def test_tissue_pieces(spark, steps, sigma):
    r = np.random.default_rng(2)
    images = {1: r.integers(0, 256, (20, 24)), 2: np.where(np.add.outer((np.arange(20) - 9) ** 2, (np.arange(24) - 12) ** 2) < 40, 30, 245)}
    rows = [(s, y, x, *[int(im[y, x])] * 3) for s, im in images.items() for y in range(20) for x in range(24)]
    got = {}
    for p in tissue.pieces(spark.createDataFrame(rows, "slide_id int, y int, x int, r int, g int, b int"), steps=steps, sigma=sigma, least=5).collect():
        got.setdefault((p.slide_id, p.label), set()).add((p.y, p.x))
    want = set()
    for s, im in images.items():
        v = 255.0 - im
        for _ in range(steps):
            v = smooth(v, sigma) if sigma else v
            v = np.where(v < otsu(v[v > 0]), 0, v)
        parts = flood(v > 0, 4)
        want |= {(s, frozenset(map(tuple, np.argwhere(parts == k).tolist()))) for k in range(1, parts.max() + 1) if (parts == k).sum() >= 5}
    assert {(s, frozenset(at)) for (s, _), at in got.items()} == want


def test_largest_piece_and_stain(spark):
    px = spark.createDataFrame([(1, 0, x, v, v, v) for x, v in enumerate([10, 10, 250, 10, 10, 250, 10])], "slide_id int, y int, x int, r int, g int, b int")
    parts = tissue.pieces(px, least=1)
    assert sorted((p.y, p.x) for p in tissue.largest(parts).collect()) == [(0, 0), (0, 1)]
    assert tissue.pieces(px, deconvolve_first=True, least=1).count() == 5
    assert tissue.pieces(px.limit(0)).count() == 0


def test_gradients_spread_as_an_elastic_body():
    r = np.random.default_rng(4)
    dy, dx, mask = r.normal(size=(7, 8)), r.normal(size=(7, 8)), r.random((7, 8)) < 0.5
    v, u = dy.copy(), dx.copy()
    at = lambda f, y, x: f[min(max(y, 0), 6), min(max(x, 0), 7)]

    def slope(f, y, x, axis):
        n = f.shape[axis]
        k = (y, x)[axis]
        a, b = max(k - 1, 0), min(k + 1, n - 1)
        get = lambda i: f[(i, x) if axis == 0 else (y, i)]
        return (get(b) - get(a)) / (b - a)

    for _ in range(3):
        div = np.array([[slope(v, y, x, 0) + slope(u, y, x, 1) for x in range(8)] for y in range(7)])
        lap = lambda f: np.array([[at(f, y - 1, x) + at(f, y + 1, x) + at(f, y, x - 1) + at(f, y, x + 1) - 4 * f[y, x] for x in range(8)] for y in range(7)])
        push = [np.array([[slope(div, y, x, axis) for x in range(8)] for y in range(7)]) for axis in (0, 1)]
        v, u = v + 0.02 * (2 * lap(v) + 5 * push[0] + mask * (dy - v)), u + 0.02 * (2 * lap(u) + 5 * push[1] + mask * (dx - u))
    got = raster.diffused(dy, dx, mask, mu=2.0, lam=3.0, iterations=3, dt=0.02)
    assert np.allclose(got[0], v) and np.allclose(got[1], u)


def test_contours_know_holes_and_edges(spark):
    ring = [(y, x) for y in range(2, 7) for x in range(2, 7) if not (3 < y < 5 and 3 < x < 5)]
    corner = [(y, x) for y in range(2) for x in range(3)]
    open_ = [(y, x) for y, x in ring if (y, x) != (3, 4)]
    rows = [(1, y, x, 1) for y, x in ring] + [(1, y, x, 2) for y, x in corner] + [(2, y, x, 3) for y, x in open_ if x != 4 or y > 4] + [(2, 8, 9, 4)]
    got = {r.label: r for r in tiles.mask_contours(spark.createDataFrame(rows, "slide_id int, y int, x int, label int"), 9, 10).collect()}
    assert (got[1].has_holes, got[2].has_holes, got[3].has_holes, got[4].has_holes) == (1, 0, 0, 0)
    edges = lambda k: [got[k][f"touches_edge_{e}"] for e in ("top", "left", "bottom", "right")]
    assert edges(1) == [0, 0, 0, 0] and edges(2) == [1, 1, 0, 0] and edges(4) == [0, 0, 1, 1]
    assert (got[1].ymin, got[1].ymax, got[1].xmin, got[1].xmax) == (2, 6, 2, 6)


def test_unions_of_runs(spark):
    r = random.Random(5)
    rows = [(k, y, x, x + r.randint(0, 6)) for k in range(4) for _ in range(30) for y, x in [(r.randint(0, 5), r.randint(0, 30))]]
    joined = spatial.joined_runs(spark.createDataFrame(rows, "c int, y int, x0 int, x1 int"), "c")
    runs = joined.collect()
    px = [(q.c, q.y, x) for q in runs for x in range(q.x0, q.x1 + 1)]
    want = {(k, y, x) for k, y, a, b in rows for x in range(a, b + 1)}
    assert len(px) == len(want) and set(px) == want
    for a, b in itertools.permutations(runs, 2):
        assert (a.c, a.y) != (b.c, b.y) or a.x1 + 1 < b.x0 or b.x1 + 1 < a.x0
    area = {q.c: q.area for q in tiles.run_outlines(joined, "c").collect()}
    assert area == {k: sum(w[0] == k for w in want) for k in range(4)}


def test_outline_of_a_union(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 4, 2), (1, 3, 2, 6, 6)], "c int, xmin int, ymin int, xmax int, ymax int")
    q = tiles.run_outlines(spatial.joined_runs(spatial.box_runs(boxes, "c"), "c"), "c").first()
    ring = set(zip(map(int, q.coords_x.split(",")), map(int, q.coords_y.split(",")), strict=True))
    inside = {(x, y) for x in range(7) for y in range(7) if (x <= 4 and y <= 2) or (3 <= x and 2 <= y)}
    rim = {(x, y) for x, y in inside if any((x + a, y + b) not in inside for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    assert q.area == len(inside) and ring == rim


def test_more_objects_than_codes_is_an_error(spark):
    e = spark.range(3).select(F.col("id").alias("element_id"))
    pairs = spark.createDataFrame([(1, 2, 2), (1, 3, 3)], "a int, b int, product int")
    assert spatial.object_codes(e.withColumn("k", F.col("element_id") + 1).where("k < 3"), pairs).count() == 2
    with pytest.raises(Exception, match="more elements than there are codes"):
        spatial.object_codes(e.withColumn("k", F.col("element_id") + 1), pairs).collect()


def test_bounds_by_mode(spark):
    slides = spark.createDataFrame([(1, 100, 80), (2, 50, 50)], "slide_id int, width int, height int")
    e = spark.createDataFrame([(1, -5, 10, 30, 90, 0), (1, 20, 5, 60, 40, 1)], "slide_id int, xmin int, ymin int, xmax int, ymax int, is_roi int")
    of = lambda *a: {tuple(r) for r in spatial.mode_bounds(slides, e, *a).collect()}
    assert of("wsi") == {(1, 0, 0, 100, 80), (2, 0, 0, 50, 50)}
    assert of("min_bounding_box") == {(1, 0, 5, 60, 80)} and of("polygonal") == {(1, 20, 5, 60, 40)}
    assert of("manual", [60, 10, 120, 30]) == {(1, 60, 10, 100, 30)}
    for bad in (("manual", None), ("manual", [5, 5, 5, 9]), ("other",)):
        with pytest.raises(ValueError):
            of(*bad)


def test_codes_of_masks_are_checked(spark):
    shape = "grp string, overlay_order int, gt_code int, is_roi int, is_background_class int"
    good = [("a", 1, 1, 0, 1), ("b", 2, 254, 1, 0)]
    out = {r.grp: r for r in spatial.mask_codes(spark.createDataFrame(good, shape)).collect()}
    assert len(out) == 3 and out["super_roi"].gt_code == 255 and out["super_roi"].overlay_order == 0
    for bad in ([*good, ("c", 1, 255, 0, 0)], [*good, ("c", 1, 0, 0, 0)], [*good, ("c", 1, None, 0, 0)], good[1:]):
        with pytest.raises(Exception, match="code out of|no background"):
            spatial.mask_codes(spark.createDataFrame(bad, shape)).collect()


def test_drawn_pixels_follow_the_fraction(spark):
    px = spark.range(40_000).select(F.lit(1).alias("slide_id"), (F.col("id") / 200).cast("int").alias("y"), (F.col("id") % 200).cast("int").alias("x"), (F.col("id") % 200 < 100).cast("int").alias("r"))
    out = stains.resampled(px, F.col("r") == 1, 0.5, 50, 0.1, 1)
    n = out.agg(F.sum("times")).first()[0]
    assert out.where("x >= 100").isEmpty() and abs(n - 10_000) < 500
    share = out.groupBy("times").count().collect()
    assert {r["times"] for r in share} >= {1, 2, 3} and abs(sum(r["count"] for r in share) - 20_000 * (1 - np.exp(-0.5))) < 400
    assert stains.resampled(px, F.col("x") < 4, 0.5, 50, 0.1, 1).isEmpty()
