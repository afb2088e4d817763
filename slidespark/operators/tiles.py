"""Grouped operators: a tile with its halo, an object or a slide at a time, as numpy arrays.

Pixels are dealt by (slide, tile); a tile holds its core and ``halo`` pixels around it, so that
results do not hang on the layout, and what a tile finds belongs to it if the centre lies in its core.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.functions import colour, raster, triangulation
from slidespark.operators import stains
from slidespark.operators.groups import Arrays, per_group
from slidespark.sources.storage import grown


def with_halo(px: DataFrame, size: int, halo: int) -> DataFrame:
    """Adds ty, tx: every pixel under its own tile and the tiles whose halo it lies in."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)))
    t = px.withColumn("ty", span("y")).withColumn("tx", span("x")).where("ty >= 0 and tx >= 0")
    return t.withColumns({"ty": F.col("ty").cast("int"), "tx": F.col("tx").cast("int")})


def raster_of(t: pd.DataFrame, columns: list[str], fill: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Values (h, w, len(columns)), which pixels are there, and the first y and x."""
    y0, x0 = int(t.y.min()), int(t.x.min())
    y, x = (t.y - y0).to_numpy(), (t.x - x0).to_numpy()
    out = np.full((int(y.max()) + 1, int(x.max()) + 1, len(columns)), fill, float)
    there = np.zeros(out.shape[:2], bool)
    out[y, x] = t[columns].to_numpy(float)
    there[y, x] = True
    return out, there, y0, x0


def per_tile(px: DataFrame, f: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str, size: int, halo: int, by: str = "slide_id") -> DataFrame:
    """``f(pixels, ty, tx)`` of every tile."""
    return with_halo(px, size, halo).groupBy(by, "ty", "tx").applyInPandas(lambda key, t: f(t, int(key[1]), int(key[2])), schema)


def owned(y: np.ndarray, x: np.ndarray, ty: int, tx: int, size: int) -> np.ndarray:
    return (np.floor(y / size) == ty) & (np.floor(x / size) == tx)


NUCLEI = "slide_id int, y double, x double, area long, ymin int, ymax int, xmin int, xmax int, mean_stain double, coords_x string, coords_y string"


@dataclass(frozen=True)
class Nuclei:
    """How nuclei are found; ``smooth`` is the radius of the disk that closes and opens the foreground."""

    threshold: float = 60.0
    min_radius: float = 2.0
    max_radius: float = 4.0
    least_area: int = 4
    radius: int = 3
    smooth: float = 0.0
    invert: bool = False


def _parts(t: pd.DataFrame, p: Nuclei, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Numbered nuclei of a tile with its halo, the nuclear stain, and the first y and x."""
    rgb, there, y0, x0 = raster_of(t, ["r", "g", "b"], 255.0)
    rgb = np.where(there[:, :, None], 255.0 - rgb, 255.0) if p.invert else rgb
    od = np.maximum(-np.log(np.maximum(rgb, 1e-10) / 255.0) * 255 / np.log(255.0), 0)
    stain = 255.0 ** (1 - (od @ q.T)[:, :, 0] / 255)
    fore = (stain < p.threshold) & there
    if p.smooth:
        fore = raster.opened(raster.closed(fore, p.smooth), p.smooth) & there
    fore = raster.fill_holes(fore)
    response, _ = raster.difference_scales(-stain, fore, p.min_radius / 2**0.5, p.max_radius / 2**0.5)
    found, _ = raster.local_peaks(-response, fore, p.radius)
    return raster.label(found > 0, 8, found), stain, y0, x0


def _nuclei(px: DataFrame, p: Nuclei, size: int, halo: int, w: np.ndarray | None, reference: tuple | None, border: bool, give, schema: str) -> DataFrame:
    """``give(slide, part, stain, y, x)`` of every nucleus whose centre lies in the core of its tile."""
    q = np.linalg.inv(colour.stain_matrix() if w is None else w)
    px = stains.reinhard(px, *reference) if reference else px
    if border:  # nuclei at the rim of the slide go
        px = px.join(px.groupBy("slide_id").agg(F.min("y").alias("__y0"), F.max("y").alias("__y1"), F.min("x").alias("__x0"), F.max("x").alias("__x1")), "slide_id")

    def f(t: pd.DataFrame, ty: int, tx: int) -> pd.DataFrame:
        parts, stain, y0, x0 = _parts(t, p, q)
        rows = []
        for k in range(1, int(parts.max(initial=0)) + 1):
            m = parts == k
            y, x = np.nonzero(m)
            if len(y) < p.least_area or not owned(np.array(y.mean() + y0), np.array(x.mean() + x0), ty, tx, size):
                continue
            if border and (y.min() + y0 == t.__y0.iloc[0] or y.max() + y0 == t.__y1.iloc[0] or x.min() + x0 == t.__x0.iloc[0] or x.max() + x0 == t.__x1.iloc[0]):
                continue
            rows += give(int(t.slide_id.iloc[0]), m, stain, y0, x0, y, x)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return per_tile(px, f, schema, size, halo)


def detect_nuclei(px: DataFrame, size: int = 32, halo: int = 8, p: Nuclei = Nuclei(), w: np.ndarray | None = None, reference: tuple | None = None, drop_border: bool = False) -> DataFrame:
    """Nuclei of RGB pixels with their outlines: nuclear stain, foreground below the threshold, closed, opened and filled, blobs by differences of Gaussians, parts by local peaks.

    ``reference`` (means and deviations in LAB) normalises each slide first. A nucleus is found by the tile that holds its
    centre, so none is found twice where tiles meet; the halo has to be as wide as a nucleus.
    """

    def give(slide, m, stain, y0, x0, y, x):
        ring = raster.outline(m, 8)
        return [(slide, y.mean() + y0, x.mean() + x0, len(y), int(y.min() + y0), int(y.max() + y0), int(x.min() + x0), int(x.max() + x0), float(stain[m].mean()), ",".join(str(b + x0) for _, b in ring), ",".join(str(a + y0) for a, _ in ring))]

    return _nuclei(px, p, size, halo, w, reference, drop_border, give, NUCLEI)


def nuclei_pixels(px: DataFrame, size: int = 32, halo: int = 8, p: Nuclei = Nuclei(), w: np.ndarray | None = None, reference: tuple | None = None, drop_border: bool = False) -> DataFrame:
    """(slide_id, y, x, label) of the same nuclei; a label is a nucleus's first pixel, ``y * 2 ** 31 + x``."""

    def give(slide, m, stain, y0, x0, y, x):
        label = (int(y[0]) + y0) * 2**31 + int(x[0]) + x0
        return [(slide, a + y0, b + x0, label) for a, b in zip(y.tolist(), x.tolist(), strict=True)]

    return _nuclei(px, p, size, halo, w, reference, drop_border, give, "slide_id int, y int, x int, label long")


def blobs(px: DataFrame, by: str, value: str = "i", kind: str = "difference", low: float = 1, high: float = 3) -> DataFrame:
    """(by, y, x, response, sigma): blob responses over scales of small images; kind difference, laplacian or oriented."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        im, there, y0, x0 = raster_of(t, [value], 0.0)
        im = im[:, :, 0]
        if kind == "laplacian":
            r, s = raster.laplacian_scales(im, there, int(low), int(high))
        elif kind == "oriented":
            r = raster.oriented_scales(im, [float(v) for v in np.arange(low, high + 1)])
            s = np.zeros(r.shape)
        else:
            r, s = raster.difference_scales(im, there, low, high)
        y, x = np.nonzero(there)
        return pd.DataFrame({by: t[by].iloc[0], "y": y + y0, "x": x + x0, "response": r[y, x], "sigma": s[y, x]})

    kind_of = dict(px.dtypes)[by]
    return px.groupBy(by).applyInPandas(f, f"{by} {kind_of}, y int, x int, response double, sigma double")


def peaks(px: DataFrame, by: str, value: str = "i", radius: int = 2) -> DataFrame:
    """(by, y, x, label): the peak that every pixel climbs to."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        im, there, y0, x0 = raster_of(t, [value], 0.0)
        found, _ = raster.local_peaks(im[:, :, 0], there, radius)
        y, x = np.nonzero(there)
        return pd.DataFrame({by: t[by].iloc[0], "y": y + y0, "x": x + x0, "label": found[y, x]})

    return px.groupBy(by).applyInPandas(f, f"{by} {dict(px.dtypes)[by]}, y int, x int, label int")


def contours(px: DataFrame, by: str, value: str = "i", method: str = "region", rounds: int = 20) -> DataFrame:
    """(by, y, x, label) of segmented small images: method region or edge (level sets from the dark half), flow (diffused gradients) or rim (grey-level contours)."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        im, there, y0, x0 = raster_of(t, [value], 255.0)
        im = im[:, :, 0]
        start = (im <= np.median(im)) & there
        if method == "region":
            out = (raster.region_contour(im, start, rounds=rounds) < 0).astype(int)
        elif method == "edge":
            out = (raster.edge_contour(im, start, rounds=rounds) < 0).astype(int)
        elif method == "flow":
            gy, gx = np.gradient(-im)
            out, _ = raster.flow_sinks(*raster.diffused(gy, gx, start), start, 2.0)
        else:
            out = raster.contours_by_gradient(im)
        y, x = np.nonzero(there & (out > 0))
        return pd.DataFrame({by: t[by].iloc[0], "y": y + y0, "x": x + x0, "label": out[y, x]})

    return px.groupBy(by).applyInPandas(f, f"{by} {dict(px.dtypes)[by]}, y int, x int, label int")


def edges(px: DataFrame, by: str, value: str = "i") -> DataFrame:
    """(by, canny_sum, canny_mean) of small images."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        im, there, _, _ = raster_of(t, [value], 0.0)
        e = raster.canny(im[:, :, 0]) & there
        return pd.DataFrame({by: [t[by].iloc[0]], "canny_sum": [float(e.sum())], "canny_mean": [float(e.sum()) / max(1, int(there.sum()))]})

    return px.groupBy(by).applyInPandas(f, f"{by} {dict(px.dtypes)[by]}, canny_sum double, canny_mean double")


def edge_map(px: DataFrame, size: int, halo: int) -> DataFrame:
    """(slide_id, y, x) of the edge pixels of (slide_id, y, x, i), a tile at a time."""

    def f(t: pd.DataFrame, ty: int, tx: int) -> pd.DataFrame:
        im, there, y0, x0 = raster_of(t, ["i"], 0.0)
        y, x = np.nonzero(raster.canny(im[:, :, 0]) & there)
        mine = owned(y + y0, x + x0, ty, tx, size)
        return pd.DataFrame({"slide_id": t.slide_id.iloc[0], "y": (y + y0)[mine], "x": (x + x0)[mine]})

    return per_tile(px, f, "slide_id int, y int, x int", size, halo)


def boundaries(labels: DataFrame, conn: int = 8) -> DataFrame:
    """(slide_id, label, n, coords_x, coords_y): outline of every object."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        m, there, y0, x0 = raster_of(t, ["label"], 0.0)
        ring = raster.outline(there, conn)
        return pd.DataFrame({"slide_id": [t.slide_id.iloc[0]], "label": [t.label.iloc[0]], "n": [len(ring)], "coords_x": [",".join(str(b + x0) for _, b in ring)], "coords_y": [",".join(str(a + y0) for a, _ in ring)]})

    return labels.groupBy("slide_id", "label").applyInPandas(f, f"slide_id int, label {dict(labels.dtypes)['label']}, n long, coords_x string, coords_y string")


def mask_contours(labels: DataFrame, height: int, width: int, conn: int = 8) -> DataFrame:
    """Outline of every object with its box, whether it has holes, and which edges of the frame it touches."""
    kind = dict(labels.dtypes)["label"]
    sides = ("top", "left", "bottom", "right")

    def f(t: pd.DataFrame) -> pd.DataFrame:
        _, m, y0, x0 = raster_of(t, ["label"], 0.0)
        ring = raster.outline(m, conn)
        h, w = m.shape
        touch = (y0 == 0, x0 == 0, y0 + h == height, x0 + w == width)
        return pd.DataFrame([[t.slide_id.iloc[0], t.label.iloc[0], y0, y0 + h - 1, x0, x0 + w - 1, int(raster.fill_holes(m).sum() > m.sum()), *map(int, touch), ",".join(str(b + x0) for _, b in ring), ",".join(str(a + y0) for a, _ in ring)]], columns=["slide_id", "label", "ymin", "ymax", "xmin", "xmax", "has_holes", *(f"touches_edge_{e}" for e in sides), "coords_x", "coords_y"])

    return labels.groupBy("slide_id", "label").applyInPandas(f, f"slide_id int, label {kind}, ymin int, ymax int, xmin int, xmax int, has_holes int, {', '.join(f'touches_edge_{e} int' for e in sides)}, coords_x string, coords_y string")


def run_outlines(runs: DataFrame, by: str, conn: int = 8) -> DataFrame:
    """(by, area, n, coords_x, coords_y): outlines of masks given as runs (by, y, x0, x1); of several pieces the largest, the first of those alike."""

    def f(t: Arrays) -> Arrays:
        y0, x0 = int(t["y"].min()), int(t["x0"].min())
        m = np.zeros((int(t["y"].max()) - y0 + 1, int(t["x1"].max()) - x0 + 1), bool)
        for y, a, b in zip((t["y"] - y0).tolist(), (t["x0"] - x0).tolist(), (t["x1"] - x0 + 1).tolist(), strict=True):
            m[y, a:b] = True
        one = np.zeros_like(m)
        for y, a, b in raster.largest_runs(*raster.runs_of(m), conn):
            one[y, a : b + 1] = True
        ring = raster.outline(one, conn)
        return {by: t[by][:1], "area": [int(m.sum())], "n": [len(ring)], "coords_x": [",".join(str(q + x0) for _, q in ring)], "coords_y": [",".join(str(p + y0) for p, _ in ring)]}

    return per_group(runs, [by], f, f"{by} {dict(runs.dtypes)[by]}, area long, n long, coords_x string, coords_y string")


SHAPES = ("perimeter", "circularity", "hull_area", "solidity", "fractal", *(f"hu{k}" for k in range(1, 8)), *(f"fsd{k}" for k in range(1, 7)))


def shapes(labels: DataFrame) -> DataFrame:
    """Perimeter, circularity, hull, solidity, fractal dimension, moment invariants and Fourier shape descriptors of every object."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        _, m, _, _ = raster_of(t, ["label"], 0.0)
        y, x = np.nonzero(m)
        around = raster.perimeter(m)
        corners = np.vstack([np.column_stack([x + a, y + b]) for a in (-0.5, 0.5) for b in (-0.5, 0.5)])
        wide = raster.polygon_area(raster.hull(corners))
        ring = raster.outline(m, 8)
        values = [around, 4 * np.pi * len(y) / (around**2 if around else 1.0), wide, len(y) / wide if wide else 0.0, raster.fractal(m), *raster.hu(m), *raster.fourier_shape(np.array([(b, a) for a, b in ring]).reshape(-1, 2))]
        return pd.DataFrame([[t.slide_id.iloc[0], t.label.iloc[0], *map(float, values)]], columns=["slide_id", "label", *SHAPES])

    return labels.groupBy("slide_id", "label").applyInPandas(f, f"slide_id int, label {dict(labels.dtypes)['label']}, " + ", ".join(f"{n} double" for n in SHAPES))


def superpixels(px: DataFrame, size: int = 8, tile: int = 48) -> DataFrame:
    """(slide_id, y, x, ty, tx, local): superpixels by tile, numbered from 1 within it."""

    def f(t: pd.DataFrame, ty: int, tx: int) -> pd.DataFrame:
        rgb, there, y0, x0 = raster_of(t, ["r", "g", "b"], 255.0)
        out = raster.superpixels(rgb, size)
        y, x = np.nonzero(there)
        return pd.DataFrame({"slide_id": t.slide_id.iloc[0], "y": y + y0, "x": x + x0, "ty": ty, "tx": tx, "local": out[y, x]})

    return per_tile(px, f, "slide_id int, y int, x int, ty int, tx int, local int", tile, 0)


def numbered(parts: DataFrame) -> DataFrame:
    """(slide_id, y, x, label): superpixels numbered through a slide by tile; only the tiles' counts are ordered."""
    ids = parts.select("slide_id", "ty", "tx", "local").distinct()
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("slide_id", "ty", "tx").orderBy("local")))
    counts = ids.groupBy("slide_id", "ty", "tx").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("slide_id").orderBy("ty", "tx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = ids.join(grown(counts.withColumn("before", before)), ["slide_id", "ty", "tx"]).select("slide_id", "ty", "tx", "local", (F.col("before") + F.col("k")).cast("int").alias("label"))
    return parts.join(grown(named), ["slide_id", "ty", "tx", "local"]).select("slide_id", "y", "x", "label")


GRAPH = tuple(f"{k}_{n}" for k in ("voronoi_area", "voronoi_perimeter", "voronoi_max_dist", "delaunay_sides", "delaunay_area", "mst_branches") for n in ("mean", "stddev", "min_max_ratio", "disorder"))


def cell_graph(points: DataFrame, by: str = "label") -> DataFrame:
    """Voronoi, Delaunay and spanning-tree statistics of the points (by, cx, cy) of each slide."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        found = triangulation.graph_features(np.unique(t[["cx", "cy"]].to_numpy(float), axis=0))
        return pd.DataFrame([[t[by].iloc[0], *(found[n] for n in GRAPH)]], columns=[by, *GRAPH])

    return points.select(by, "cx", "cy").groupBy(by).applyInPandas(f, f"{by} {dict(points.dtypes)[by]}, " + ", ".join(f"{n} double" for n in GRAPH))


def vote_centres(px: DataFrame, by: str, value: str = "i", low: int = 1, high: int = 3, bandwidth: float = 2.0) -> DataFrame:
    """(by, y, x): centres that gradients vote for, joined by mean shift."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        im, there, y0, x0 = raster_of(t, [value], 0.0)
        v = raster.votes(im[:, :, 0], low, high)
        y, x = np.nonzero(there & (v > 0.5 * v.max()) & (v > 0))
        modes, _ = raster.mean_shift(np.column_stack([y, x]), v[y, x], bandwidth)
        return pd.DataFrame({by: [t[by].iloc[0]] * len(modes), "y": modes[:, 0] + y0, "x": modes[:, 1] + x0})

    return px.groupBy(by).applyInPandas(f, f"{by} {dict(px.dtypes)[by]}, y double, x double")


def ring_distance(pairs: DataFrame, most: float) -> DataFrame:
    """Pairs (a, b, xa, ya, xb, yb with comma-joined coordinates) whose polygons are less than ``most`` apart."""

    @F.pandas_udf("double")
    def apart(xa: pd.Series, ya: pd.Series, xb: pd.Series, yb: pd.Series) -> pd.Series:
        ring = lambda x, y: np.column_stack([np.array(x.split(","), float), np.array(y.split(","), float)])
        return pd.Series([triangulation.distance_of_polygons(ring(a, b), ring(c, d)) for a, b, c, d in zip(xa, ya, xb, yb, strict=True)])

    return pairs.withColumn("distance", apart("xa", "ya", "xb", "yb")).where(F.col("distance") < most)


def crop(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, least_area: float = 2.0) -> DataFrame:
    """Polygons (coords_x, coords_y) cut to a rectangle; those of less area than ``least_area`` go."""

    @F.pandas_udf("coords_x string, coords_y string, area double")
    def cut(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(xs, ys, strict=True):
            ring = triangulation.clipped(np.column_stack([np.array(a.split(","), float), np.array(b.split(","), float)]), xmin, ymin, xmax, ymax)
            whole = ring.astype(int)
            out.append((",".join(map(str, whole[:, 0])), ",".join(map(str, whole[:, 1])), raster.polygon_area(ring) if len(ring) > 2 else 0.0))
        return pd.DataFrame(out, columns=["coords_x", "coords_y", "area"])

    t = polygons.withColumn("__c", cut("coords_x", "coords_y")).where(F.col("__c.area") > least_area)
    return t.select(*(c for c in polygons.columns if c not in ("coords_x", "coords_y")), "__c.coords_x", "__c.coords_y", "__c.area")


def decode_png(raw: bytes) -> np.ndarray:
    """Pixels (h, w, channels) of an 8-bit PNG without interlacing."""
    import struct
    import zlib

    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette, head = 8, b"", None, None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    w, h, depth, colour_type, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNGs without interlacing are read")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour_type]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w, c), np.int64)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].reshape(w, c).astype(np.int64)
        up = out[y - 1] if y else np.zeros((w, c), np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w):
                left = out[y, x - 1] if x else np.zeros(c, np.int64)
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up[x]) >> 1
                else:
                    corner = up[x - 1] if x else np.zeros(c, np.int64)
                    p = left + up[x] - corner
                    pa, pb, pc = np.abs(p - left), np.abs(p - up[x]), np.abs(p - corner)
                    add = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up[x], corner))
                out[y, x] = (line[x] + add) & 255
    return palette[out[:, :, 0]] if palette is not None else out.astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey, RGB or RGBA PNG."""
    import struct
    import zlib

    p = np.ascontiguousarray(pixels, np.uint8)
    p = p[:, :, None] if p.ndim == 2 else p
    h, w, c = p.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * c)], axis=1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(spark, path: str) -> DataFrame:
    """(path, y, x, r, g, b) of all PNG files under a path that Spark can read."""

    def f(batches):
        for t in batches:
            for name, raw in zip(t.path, t.content, strict=True):
                p = decode_png(raw)
                p = np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]
                y, x = (a.ravel() for a in np.mgrid[: p.shape[0], : p.shape[1]])
                yield pd.DataFrame({"path": name, "y": y.astype(np.int32), "x": x.astype(np.int32), **{c: p[:, :, k].ravel().astype(np.int32) for k, c in enumerate("rgb")}})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content").mapInPandas(f, "path string, y int, x int, r int, g int, b int")
