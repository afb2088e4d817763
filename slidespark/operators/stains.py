"""Estimation of stain matrices, by aggregates and ranks over all pixels.

Only moments (six sums) and two ranked pixels leave the cluster; eigenvectors of 3 x 3 matrices
are found in the driver, with the sign fixed so that their largest entry is positive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidespark.functions import chance, colour

MAGNITUDE, LOW, HIGH = 16.0, 0.01, 0.99


def components_of(m: np.ndarray) -> np.ndarray:
    """Principal axes of uncentred second moments, largest first."""
    values, vectors = np.linalg.eigh(m)
    v = vectors[:, np.argsort(-values)]
    return v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0)


def second_moments(od: DataFrame) -> np.ndarray:
    """Mean products of the columns r, g, b over finite rows."""
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    row = od.agg(*(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs)).first()
    return np.array([[row["".join(sorted((a, b), key="rgb".index))] or 0.0 for b in "rgb"] for a in "rgb"])


def finite(od: DataFrame) -> DataFrame:
    """Rows whose r, g, b are all finite."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in "rgb"]
    return od.where(ok[0] & ok[1] & ok[2])


def macenko(od: DataFrame, magnitude: float = MAGNITUDE, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Stain matrix from optical densities (r, g, b): the extreme directions in the plane of the two main axes.

    Directions are ranked by a count of a fine histogram and then within one bin of it, so that no task sorts all pixels.
    """
    od = finite(od)
    axes = components_of(second_moments(od))
    p0, p1 = colour.linear(axes.T[:2], [F.col(c) for c in "rgb"])
    t = od.select(p0.alias("p0"), p1.alias("p1")).withColumn("size", F.sqrt(F.col("p0") * F.col("p0") + F.col("p1") * F.col("p1"))).where(F.col("size") > magnitude)
    u, v = F.col("p0") / F.col("size"), F.col("p1") / F.col("size")
    t = t.withColumn("angle", (1 - u) * F.signum(v))
    bins = 4096
    t = t.withColumn("bin", F.least(F.floor((F.col("angle") + 2) / 4 * bins), F.lit(bins - 1)).cast("int"))
    counts = sorted((r.bin, r.n) for r in t.groupBy("bin").agg(F.count("*").alias("n")).collect())  # at most 4096 rows
    total = sum(n for _, n in counts)
    if not total:
        return colour.stain_matrix()
    found = []
    for q in (low, high):
        rank, below = min(int(q * total + 0.5), total - 1), 0
        for b, n in counts:
            if below + n > rank:
                break
            below += n
        row = t.where(F.col("bin") == b).orderBy("angle", "p0", "p1").limit(rank - below + 1).orderBy(F.desc("angle"), F.desc("p0"), F.desc("p1")).first()
        found.append(axes[:, :2] @ np.array([row.p0, row.p1]))
    return colour.complement(colour.complement(np.array(found).T)[:, :2])


def sparse_factors(od: DataFrame, start: np.ndarray, beta: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Stain matrix by nonnegative factorisation with an L1 penalty on the amounts.

    Amounts of a pixel follow from the matrix in closed form (two stains, clamped at 0), so each
    round is one aggregate over all pixels and a small solve in the driver.
    """
    w = colour.complement(start)[:, :2]
    for _ in range(rounds):
        g = w.T @ w
        inv = np.linalg.inv(g + 1e-9 * np.eye(2))
        x = [F.col(c) for c in "rgb"]
        proj = colour.linear(w.T, x)
        pen = [p - F.lit(beta) for p in proj]
        h = colour.linear(inv, pen)
        only = [F.greatest(pen[i] / F.lit(float(g[i, i])), F.lit(0.0)) for i in (0, 1)]
        a = F.when((h[0] >= 0) & (h[1] >= 0), h[0]).when(h[1] < 0, only[0]).otherwise(F.lit(0.0))
        b = F.when((h[0] >= 0) & (h[1] >= 0), h[1]).when(h[0] < 0, only[1]).otherwise(F.lit(0.0))
        t = od.select(*"rgb", a.alias("u"), b.alias("v"))
        row = t.agg(*(F.avg(F.col(s) * F.col(c)).alias(s + c) for s in "uv" for c in "rgb"), F.avg(F.col("u") * F.col("u")).alias("uu"), F.avg(F.col("u") * F.col("v")).alias("uv"), F.avg(F.col("v") * F.col("v")).alias("vv")).first()
        hh = np.array([[row.uu, row.uv], [row.uv, row.vv]], float) + 1e-9 * np.eye(2)
        xh = np.array([[row[s + c] for s in "uv"] for c in "rgb"], float)
        w = np.maximum(xh @ np.linalg.inv(hh), 1e-9)
        w /= np.linalg.norm(w, axis=0)
    return colour.complement(w)


def sampled(pixels: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the pixels that depends on their coordinates alone; reruns agree."""
    return pixels.where(chance.mixed(F.col("slide_id"), F.col("y"), F.col("x"), seed=seed) < int(fraction * chance.PRIME))


def resampled(pixels: DataFrame, inside: Column, fraction: float, tile: int, least: float = 0.1, seed: int = 0) -> DataFrame:
    """Pixels inside, drawn with replacement at an expected ``fraction``, from tiles of which a share of ``least`` or more is inside; adds ``times``.

    How often a pixel is drawn follows the Poisson law by a number made of its coordinates, so reruns and engines agree.
    """
    at = lambda c: F.floor(F.col(c) / tile).cast("int").alias(f"t{c}")
    t = pixels.select("*", at("y"), at("x"), F.coalesce(inside, F.lit(False)).alias("__in"))
    full = t.groupBy("slide_id", "ty", "tx").agg(F.avg(F.col("__in").cast("double")).alias("share")).where(F.col("share") >= least).select("slide_id", "ty", "tx")
    u = chance.mixed(F.col("slide_id"), F.col("y"), F.col("x"), seed=seed) / chance.PRIME
    below, steps, term = 0.0, [], math.exp(-fraction)
    while below < 1 - 1e-9 and len(steps) < 64:
        below += term
        steps.append(below)
        term *= fraction / len(steps)
    times = sum(((u >= b).cast("int") for b in steps), F.lit(0))
    return t.where("__in").join(full, ["slide_id", "ty", "tx"], "left_semi").select(*pixels.columns, times.alias("times")).where("times > 0")


def weighted_stats(t: DataFrame, names, weight: str, by: str = "slide_id") -> DataFrame:
    """Mean and population deviation of columns, rows counting as often as their weight says."""
    w = F.col(weight)
    mean = lambda c: F.sum(w * c) / F.sum(w)
    cells = []
    for n in names:
        c = F.col(n)
        cells += [F.round(mean(c), 5).alias(f"{n}_mu"), F.round(F.sqrt(F.greatest(mean(c * c) - mean(c) * mean(c), F.lit(0.0))), 5).alias(f"{n}_sigma")]
    return t.groupBy(by).agg(*cells)


def reinhard(px: DataFrame, means, deviations) -> DataFrame:
    """Pixels whose colours have the given means and deviations in LAB, slide by slide; a channel without spread becomes its mean."""
    names = ("l", "alpha", "beta")
    t = px.select("slide_id", "y", "x", *(c.alias(n) for c, n in zip(colour.lab(*(F.col(c) for c in "rgb")), names, strict=True)))
    of = t.groupBy("slide_id").agg(*(f(c).alias(f"{c}_{n}") for c in names for n, f in (("mu", F.avg), ("sd", F.stddev_pop))))
    moved = [F.coalesce((F.col(c) - F.col(f"{c}_mu")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), F.lit(0.0)) * float(sd) + float(mu) for c, mu, sd in zip(names, means, deviations, strict=True)]
    return t.join(of, "slide_id").select("slide_id", "y", "x", *(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).alias(n) for c, n in zip(colour.lab_to_rgb(*moved), "rgb", strict=True)))


def tissue_threshold(gray: DataFrame, bandwidth: float = 2.0) -> tuple[float, float]:
    """(low, high) of the grey values of tissue, from a histogram with 256 bins.

    The smoothed histogram's highest mode from the bright end is the background, the highest darker one
    the tissue; two Gaussians by their half widths give the point of equal likelihood.
    """
    h = np.zeros(256)
    for r in gray.groupBy(F.floor("v").cast("int").alias("v")).agg(F.count("*").alias("n")).collect():  # at most 256 rows
        h[min(max(r.v, 0), 255)] += r.n
    t = np.arange(256)
    k = np.exp(-((t[:, None] - t) ** 2) / (2 * bandwidth**2))
    y = k @ (h / max(1.0, h.sum()))
    peaks = [i for i in range(256) if y[i] >= (y[i - 1] if i else -1) and y[i] > (y[i + 1] if i < 255 else -1) and y[i] > 1e-3 * y.max()]
    if len(peaks) < 2:
        return 0.0, float(peaks[0] if peaks else 255)
    back = peaks[-1]
    tissue = max(peaks[:-1], key=lambda i: y[i])
    width = lambda p: max(1.0, _half_width(y, p) / 2.355)
    a, b = width(tissue), width(back)
    grid = np.linspace(tissue, back, 513)
    score = np.log(y[tissue] / a) - (grid - tissue) ** 2 / (2 * a * a) - np.log(y[back] / b) + (grid - back) ** 2 / (2 * b * b)
    cut = grid[np.argmax(score <= 0)] if (score <= 0).any() else (tissue + back) / 2
    return max(0.0, tissue - 1.96 * a), float(cut)


def _half_width(y: np.ndarray, p: int) -> float:
    """Full width at half of a peak's height, with straight lines between bins."""
    half, out = y[p] / 2, 0.0
    for step in (-1, 1):
        i = p
        while 0 <= i + step < len(y) and y[i + step] > half:
            i += step
        nxt = i + step
        out += abs(i - p) + ((y[i] - half) / max(y[i] - y[nxt], 1e-12) if 0 <= nxt < len(y) else 0.0)
    return out


def angle_percentile(values: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """The element of rank ``min(int(q n + 0.5), n - 1)`` of each group."""
    w = Window.partitionBy(by)
    t = values.withColumn("k", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return t.where(F.col("k") - 1 == F.least(F.floor(F.lit(q) * F.col("n") + 0.5), F.col("n") - 1)).select(by, value)


def magnification(mm_x: float | None, mag: float | None, want_mpp: float | None = None, want_mag: float | None = None) -> tuple[float, str]:
    """Scale factor of a region request and the words that ask for it; by resolution first, then by magnification, else 1."""
    if want_mpp is not None and mm_x is not None:
        mm = 0.001 * want_mpp
        return mm_x / mm, f"&mm_x={mm:.8f}&mm_y={mm:.8f}"
    if want_mag is not None and mag is not None:
        return want_mag / mag, f"&magnification={want_mag:.8f}"
    return 1.0, ""


def low_resolution(size: int, most: int = 2048) -> int:
    """The power of two by which a side is divided for an overview."""
    return 2 ** max(0, math.floor(math.log2(max(1, size) / most)))
