"""Neighbourhood operators over dense images (key columns, y, x, value).

One-dimensional passes are sums of ``lag`` over the rows or the columns of an image, so that a
separable filter costs two sorts whatever its width is, and no pixel is copied. Pixels outside
the image count as 0. Only for images without missing pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 2.0**-52


def line(key: Sequence[str], axis: str) -> WindowSpec:
    """Pixels of one image in order along an axis."""
    return Window.partitionBy(*key, "x" if axis == "y" else "y").orderBy(axis)


def convolve(value: Column, kernel: Sequence[float], window: WindowSpec) -> Column:
    """Convolution with an odd kernel along a line."""
    half = len(kernel) // 2
    terms = [F.lit(float(w)) * F.coalesce(F.lag(value, k - half).over(window), F.lit(0.0)) for k, w in enumerate(kernel) if w]
    return sum(terms[1:], terms[0])


def gradient(px: DataFrame, key: Sequence[str], value: str = "i") -> DataFrame:
    """Adds gy, gx: central differences, one-sided at the ends of a line."""
    v = F.col(value).cast("double")
    for axis in ("y", "x"):
        w = line(key, axis)
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        px = px.withColumn(f"g{axis}", F.coalesce((after - before) / 2, after - v, v - before, F.lit(0.0)))
    return px


def laplacian(px: DataFrame, key: Sequence[str], value: str = "i") -> DataFrame:
    """Adds lap: half the sum over both axes of half the second difference, ends extrapolated in a straight line."""
    v = F.col(value).cast("double")
    for axis in ("y", "x"):
        w = line(key, axis)
        px = px.withColumn("__d", (F.lead(v).over(w) - 2 * v + F.lag(v).over(w)) / 2)
        d = lambda k: F.lag("__d", k).over(w)  # noqa: E731, B023
        ahead = F.when(d(-2).isNull(), d(-1)).otherwise(2 * d(-1) - d(-2))
        behind = F.when(d(2).isNull(), d(1)).otherwise(2 * d(1) - d(2))
        px = px.withColumn(f"__{axis}", F.coalesce("__d", F.when(F.lag(v).over(w).isNull(), ahead).otherwise(behind), F.lit(0.0)))
    return px.withColumn("lap", (F.col("__y") + F.col("__x")) / 2).drop("__d", "__y", "__x")


def _gauss(at: Sequence[float], sigma: float) -> list[float]:
    return [math.exp(-(t * t) / (2 * sigma**2)) for t in at]


def derivative_kernels(sigma: float) -> tuple[list[float], list[float]]:
    """Smoothing and derivative taps of a Gaussian, from -ceil(6 sigma)/2 on in steps of one."""
    n = math.ceil(6 * sigma)
    at = [k - n / 2 for k in range(n + 1)]
    unit = [g / (sigma * math.sqrt(2 * math.pi)) for g in _gauss(at, sigma)]
    return unit, [2 * t / sigma**2 * g for t, g in zip(at, unit, strict=True)]


def gaussian_gradient(px: DataFrame, key: Sequence[str], sigma: float = 1.0, value: str = "i") -> DataFrame:
    """Adds dx, dy of the smoothed image."""
    smooth, slope = derivative_kernels(sigma)
    v = F.col(value).cast("double")
    px = px.withColumn("__a", convolve(v, slope, line(key, "x"))).withColumn("__b", convolve(v, smooth, line(key, "x")))
    return px.withColumn("dx", convolve(F.col("__a"), smooth, line(key, "y"))).withColumn("dy", convolve(F.col("__b"), slope, line(key, "y"))).drop("__a", "__b")


def hessian_kernels(sigma: float) -> dict[str, tuple[list[float], list[float], float]]:
    """Taps along y and along x, and the factor, of each second derivative."""
    at = list(range(-round(3 * sigma), round(3 * sigma + 1)))
    g = _gauss(at, sigma)
    bend = [((t / sigma) ** 2 - 1) * w for t, w in zip(at, g, strict=True)]
    tilt = [t * w for t, w in zip(at, g, strict=True)]
    two, mixed = 1 / (2 * math.pi * sigma**4), 1 / (2 * math.pi * sigma**6)
    return {"dyy": (bend, g, two), "dxy": (tilt, tilt, mixed), "dxx": (g, bend, two)}


def hessian(px: DataFrame, key: Sequence[str], sigma: float = 1.0, value: str = "i") -> DataFrame:
    """Adds dyy, dxy, dxx by Gaussian derivatives."""
    taps = hessian_kernels(sigma)
    for name, (_, across, _) in taps.items():
        px = px.withColumn(f"__{name}", convolve(F.col(value).cast("double"), across, line(key, "x")))
    for name, (down, _, factor) in taps.items():
        px = px.withColumn(name, factor * convolve(F.col(f"__{name}"), down, line(key, "y"))).drop(f"__{name}")
    return px


def eigen(a: Column, b: Column, d: Column) -> dict[str, Column]:
    """Eigenvalues of ((a, b), (b, d)), smaller magnitude first, and the unit vector of the first one."""
    root = F.sqrt((a - d) * (a - d) + 4 * b * b)
    high, low = (a + d + root) / 2, (a + d - root) / 2
    u, v = 2 * b, d - a + root
    norm = F.sqrt(u * u + v * v)
    u, v = (F.when(norm > 0, c / F.nullif(norm, F.lit(0.0))).otherwise(0.0) for c in (u, v))
    swap = F.abs(high) > F.abs(low)
    return {"e1": F.when(swap, low).otherwise(high), "e2": F.when(swap, high).otherwise(low), "v1": F.when(swap, -v).otherwise(u), "v2": F.when(swap, u).otherwise(v)}


def hessian_eigen(px: DataFrame, key: Sequence[str], sigma: float = 1.0, value: str = "i") -> DataFrame:
    """Adds e1, e2, v1, v2 of the Hessian scaled by sigma squared."""
    h = hessian(px, key, sigma, value)
    s = sigma**2
    found = eigen(s * F.col("dyy"), s * F.col("dxy"), s * F.col("dxx"))
    return h.withColumns(found)


def vesselness(px: DataFrame, key: Sequence[str], sigma: float = 1.0, value: str = "i") -> DataFrame:
    """Adds deviation, frobenius and theta, besides the eigenvalues."""
    e = hessian_eigen(px, key, sigma, value)
    shifted = F.col("e2") + EPS
    return e.withColumns({
        "deviation": F.col("e1") / F.nullif(shifted, F.lit(0.0)),
        "frobenius": F.sqrt(F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2")),
        "theta": F.atan2("v2", "v1"),
    })
