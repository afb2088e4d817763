"""Tissue on overviews of slides: smoothing and thresholding in rounds, connected pieces, the largest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.functions import colour
from slidespark.operators import labels, pixelstats, spatial, stains, stencil
from slidespark.sources.storage import grown, materialize, release

BINS = 256


def darkness(px: DataFrame, deconvolve_first: bool = False, w: np.ndarray | None = None) -> DataFrame:
    """(slide_id, y, x, v): inverted grey, or inverted nuclear stain, as a whole number from 0 to 255."""
    rgb = [F.col(c) for c in "rgb"]
    if deconvolve_first:
        v = 255 - colour.to_byte(F.round(colour.unmix(*rgb, colour.stain_matrix() if w is None else w)[0], 6))
    else:
        v = 255 - F.round(0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2])
    return px.select("slide_id", "y", "x", v.cast("double").alias("v"))


def smoothed(px: DataFrame, sigma: float) -> DataFrame:
    """A Gaussian over v along rows, then columns; beyond the ends of a line its last value goes on."""
    half = max(1, int(4 * sigma + 0.5))
    taps = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    taps = taps / taps.sum()
    for axis in ("x", "y"):
        line = stencil.line(("slide_id",), axis)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        t = px.withColumns({"__a": F.first("v").over(whole), "__b": F.last("v").over(whole)})
        at = lambda k: F.coalesce(F.lag("v", -k).over(line), F.col("__a") if k < 0 else F.col("__b"))  # noqa: E731, B023
        px = t.select("slide_id", "y", "x", sum((at(k - half) * float(w) for k, w in enumerate(taps) if w > 1e-12), F.lit(0.0)).alias("v"))
    return px


def cut(px: DataFrame) -> DataFrame:
    """v with what lies below Otsu's threshold of the values above 0 set to 0; thresholds are those of 256 bins over a slide's values."""
    over = px.where("v > 0")
    ends = over.groupBy("slide_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / BINS
    binned = over.join(ends, "slide_id").select("slide_id", F.coalesce(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))), F.lit(BINS - 1)), F.lit(0)).cast("int").alias("i"))
    level = ends.join(pixelstats.otsu(binned, "slide_id"), "slide_id", "left").select("slide_id", F.coalesce(F.col("lo") + (F.col("threshold") + 0.5) * step, F.lit(0.0)).alias("level"))
    return px.join(level, "slide_id", "left").select("slide_id", "y", "x", F.when(F.col("v") < F.coalesce("level", F.lit(0.0)), 0.0).otherwise(F.col("v")).alias("v"))


def pieces(px: DataFrame, deconvolve_first: bool = False, steps: int = 1, sigma: float = 0.0, least: int = 500, w: np.ndarray | None = None) -> DataFrame:
    """(slide_id, y, x, label): pieces of tissue of RGB pixels by four neighbours; smaller ones than ``least`` go.

    A label is the first pixel of its piece. Rounds smooth, find a threshold and blank what lies below it.
    """
    t = darkness(px, deconvolve_first, w)
    for _ in range(steps):
        t, old = materialize(cut(smoothed(t, sigma) if sigma > 0 else t)), t
        release(old)
    parts = labels.connected(t.where("v > 0").select("slide_id", "y", "x")).withColumnRenamed("component", "label")
    big = parts.groupBy("slide_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return parts.join(grown(big), ["slide_id", "label"], "left_semi").select("slide_id", "y", "x", "label")


def largest(parts: DataFrame) -> DataFrame:
    """The largest piece of each slide, the first of those alike."""
    sizes = parts.groupBy("slide_id", "label").agg(F.count("*").alias("area"))
    best = sizes.groupBy("slide_id").agg(F.min_by("label", F.struct(-F.col("area"), F.col("label"))).alias("label"))
    return parts.join(grown(best), ["slide_id", "label"], "left_semi")


def overview(px: DataFrame, side: int, most: int = 2048, **options) -> DataFrame:
    """Tissue of overviews: slides of a greater side than ``most`` are first made smaller by a power of two."""
    factor = stains.low_resolution(side, most)
    small = spatial.thumbnail(px, factor) if factor > 1 else px
    return pieces(small, **options)
