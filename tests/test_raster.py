"""Image kernels and triangulation against plain definitions."""

import itertools
import math

import numpy as np
import pytest

from slidespark.functions import colour, raster, triangulation
from slidespark.operators import spatial, stains, tiles

R = np.random.default_rng(3)
MASKS = [R.random((9, 12)) < p for p in (0.3, 0.6, 0.9)] + [np.ones((5, 5), bool), np.eye(6, dtype=bool)]


@pytest.mark.parametrize("m", MASKS)
def test_distance(m):
    got = raster.distance(m)
    off = np.argwhere(~m)
    for y, x in np.argwhere(m):
        want = np.sqrt(((off - (y, x)) ** 2).sum(axis=1)).min() if len(off) else np.inf
        assert got[y, x] == pytest.approx(want)
    assert (got[~m] == 0).all()


def flood(m, conn, values=None):
    out, k = np.zeros(m.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for y, x in itertools.product(*map(range, m.shape)):
        if m[y, x] and not out[y, x]:
            k += 1
            todo = [(y, x)]
            out[y, x] = k
            while todo:
                a, b = todo.pop()
                for dy, dx in steps:
                    c, d = a + dy, b + dx
                    if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and not out[c, d] and (values is None or values[c, d] == values[a, b]):
                        out[c, d] = k
                        todo.append((c, d))
    return out


@pytest.mark.parametrize("m", MASKS)
@pytest.mark.parametrize("conn", [4, 8])
def test_label(m, conn):
    assert (raster.label(m, conn) == flood(m, conn)).all()
    v = R.integers(0, 2, m.shape)
    assert (raster.label(m, conn, v) == flood(m, conn, v)).all()


def test_fill_open_close():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert raster.fill_holes(m).sum() == 25
    m[0, 0] = True
    assert not raster.opened(m, 1)[0, 0]
    assert raster.closed(m, 1)[4, 4]


def test_outline():
    m = np.zeros((5, 6), bool)
    m[1:4, 1:5] = True
    ring = raster.outline(m, 8)
    want = {(y, x) for y, x in np.argwhere(m) if y in (1, 3) or x in (1, 4)}
    assert set(ring) == want and len(ring) == len(want)
    assert raster.outline(np.eye(1, dtype=bool)) == []
    assert {abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in itertools.pairwise(raster.outline(m, 4))} == {1}


def test_shapes():
    m = np.ones((8, 8), bool)
    assert raster.perimeter(m) == pytest.approx(28)
    assert raster.polygon_area(raster.hull(np.array([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1)]))) == 12
    turned = np.rot90(np.triu(np.ones((7, 7), bool)))
    assert np.allclose(raster.hu(np.triu(np.ones((7, 7), bool)))[:4], raster.hu(turned)[:4])
    a = np.linspace(0, 2 * math.pi, 64, endpoint=False)
    circle = np.column_stack([20 * np.cos(a), 20 * np.sin(a)])
    f = raster.fourier_shape(circle)
    assert len(f) == 6 and f[0] == max(f)


def test_gaussian_keeps_constants():
    assert np.allclose(raster.gaussian(np.full((6, 7), 3.0), 2.0), 3.0)
    k = R.random((3, 5))
    im = R.random((6, 7))
    p = np.pad(im, ((1, 1), (2, 2)))
    want = sum(k[a, b] * p[2 - a : 8 - a, 4 - b : 11 - b] for a in range(3) for b in range(5))
    assert np.allclose(raster.convolve(im, k), want)


def test_peaks_climb():
    y, x = np.mgrid[:20, :20]
    im = np.exp(-((y - 5) ** 2 + (x - 5) ** 2) / 8) + np.exp(-((y - 14) ** 2 + (x - 13) ** 2) / 8)
    out, centres = raster.local_peaks(im, np.ones(im.shape, bool), 3)
    assert sorted(tuple(map(round, c)) for c in centres) == [(5, 5), (14, 13)]
    assert out[4, 6] == out[5, 5] != out[14, 13] == out[15, 12]


def test_level_sets_find_a_disk():
    y, x = np.mgrid[:24, :24]
    disk = (y - 12) ** 2 + (x - 12) ** 2 <= 36
    im = np.where(disk, 50.0, 200.0)
    start = (y - 11) ** 2 + (x - 13) ** 2 <= 60
    assert ((raster.region_contour(im, start, rounds=80) < 0) == disk).mean() > 0.97
    assert (raster.contours_by_gradient(im) > 0)[disk].mean() > 0.9
    assert raster.canny(im)[disk ^ raster.opened(disk, 2)].any() or raster.canny(im).any()


def test_split_concavity():
    y, x = np.mgrid[:20, :30]
    m = ((y - 10) ** 2 + (x - 8) ** 2 <= 49) | ((y - 10) ** 2 + (x - 20) ** 2 <= 49)
    assert len(np.unique(raster.split_concavity(m))) == 3
    assert len(np.unique(raster.split_concavity(m[:, :15]))) <= 2


def test_superpixels_follow_colour():
    rgb = np.zeros((16, 16, 3))
    rgb[:, 8:] = 255
    out = raster.superpixels(rgb, 8)
    assert not set(out[:, :8].ravel()) & set(out[:, 8:].ravel())


def test_delaunay_is_empty_circle():
    p = R.random((30, 2)) * 100
    tri = triangulation.delaunay(p)
    c, r2 = triangulation._circles(p, tri)
    for q, r in zip(c, r2, strict=True):
        assert (((p - q) ** 2).sum(axis=1) >= r * (1 - 1e-6)).all()
    hull = len(raster.hull(p))
    assert len(tri) == 2 * 30 - 2 - hull
    tree = triangulation.spanning_tree(p, triangulation.edges_of(tri))
    every = np.array(list(itertools.combinations(range(30), 2)))
    assert len(tree) == 29 and tree.sum() == pytest.approx(triangulation.spanning_tree(p, every).sum())


def test_polygon_distance_and_clip():
    a = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert triangulation.distance_of_polygons(a, a + 7) == pytest.approx(math.hypot(3, 3))
    assert triangulation.distance_of_polygons(a, a + 2) == 0
    assert triangulation.distance_of_polygons(a, a / 4 + 1) == 0
    assert raster.polygon_area(triangulation.clipped(a, 1, 1, 9, 3)) == pytest.approx(6)


@pytest.mark.parametrize("shape", [(5, 7), (4, 3, 3), (2, 6, 4)])
def test_png_round_trip(shape):
    p = R.integers(0, 256, shape).astype(np.uint8)
    got = tiles.decode_png(tiles.encode_png(p))
    assert (got == p.reshape(got.shape)).all()


def test_regions_and_scales():
    assert spatial.region_box([10, 20, 30, 40], 1000, 1000) == {"left": 10, "top": 20, "width": 30, "height": 40}
    assert spatial.region_box([50, 50, 0, 10, 5, 0], 1000, 52) == {"left": 40, "top": 45, "width": 20, "height": 7}
    assert len(spatial.region_polygons([0, 0, 5, 0, 5, 5, -1, -1, 1, 1, 2, 1, 2, 2])) == 2
    assert spatial.region_box([-1, -1, -1, -1], 7, 8)["width"] == 7
    with pytest.raises(ValueError):
        spatial.region_box([0, 0, 50, 50], 100, 100, most=10)
    assert stains.magnification(0.0005, 20, want_mpp=1.0)[0] == 0.5
    assert stains.magnification(None, 40, want_mag=10)[0] == 0.25 and stains.magnification(None, None, 1.0) == (1.0, "")
    assert stains.low_resolution(40000) == 16


def test_stain_matrices():
    w = colour.stains_of(["hematoxylin", "eosin", "null"])
    assert np.allclose(np.linalg.norm(w, axis=0), 1) and abs(w[:, 2] @ w[:, 0]) < 1e-9
    assert colour.stain_index(colour.EOSIN, w) == 1
    assert np.allclose(colour.reorder(w[:, [1, 0, 2]]), w)


def test_stains_are_found_again(spark):
    w = colour.stain_matrix()
    amount = R.gamma(1.5, 30, (3000, 2))
    amount[:1000, 0] *= 0.02
    amount[1000:2000, 1] *= 0.02
    od = amount @ w[:, :2].T
    df = spark.createDataFrame([tuple(map(float, v)) for v in od], "r double, g double, b double")
    got = stains.macenko(df)
    assert {colour.stain_index(w[:, 0], got[:, :2]), colour.stain_index(w[:, 1], got[:, :2])} == {0, 1}
    assert all(max(abs(got[:, k] @ w[:, j]) for k in (0, 1)) > 0.99 for j in (0, 1))
    start = colour.stain_matrix((0.7, 0.6, 0.3), (0.2, 0.9, 0.2))
    assert all(max(abs(stains.sparse_factors(df, start)[:, k] @ w[:, j]) for k in (0, 1)) > 0.98 for j in (0, 1))
