"""The feature table of objects: form, intensity, edges and texture of nuclei and of the rings around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.operators import labels, pixelstats, stencil, texture, tiles

KEY = ["slide_id", "label"]


def _named(t: DataFrame, prefix: str) -> DataFrame:
    return t.select(*KEY, *(F.col(c).alias(f"{prefix}{c}") for c in t.columns if c not in KEY))


def of_pixels(px: DataFrame, levels: int = 32, prefix: str = "") -> DataFrame:
    """Intensity, gradient and texture of the objects of (slide_id, label, y, x, i, mag), ``mag`` being the size of the gradient of the whole image."""
    key = F.struct(*KEY).alias("k")
    intensity = pixelstats.intensity_features(px.select(key, "i"), "k").select("k.*", *(F.col(c).alias(f"intensity_{c}") for c in ("min", "max", "mean", "median", "mean_median_diff", "std", "iqr", "mad", "skewness", "kurtosis", "energy", "entropy")))
    edges = pixelstats.intensity_features(px.select(key, F.col("mag").alias("i")), "k").select("k.*", *(F.col(c).alias(f"gradient_{c}") for c in ("mean", "std", "skewness", "kurtosis", "entropy", "energy")))
    pairs = pixelstats.glcm(px.select(key, "y", "x", "i"), "k", levels)
    woven = texture.haralick(pairs, "k", levels)
    woven = woven.select("k.*", *(F.col(c).alias(f"haralick_{c}") for c in woven.columns if c != "k"))
    return _named(intensity.join(edges, KEY).join(woven, KEY, "left"), prefix)


def edge_pixels(px: DataFrame, objects: DataFrame, size: int = 1024, halo: int = 8, prefix: str = "") -> DataFrame:
    """(slide_id, label, canny_sum, canny_mean): edge pixels of (slide_id, y, x, i) that lie in each object."""
    found = tiles.edge_map(px, size, halo)
    hit = objects.join(found.withColumn("e", F.lit(1)), ["slide_id", "y", "x"], "left").groupBy(*KEY).agg(F.sum(F.coalesce("e", F.lit(0))).cast("double").alias("canny_sum"), F.avg(F.coalesce("e", F.lit(0))).alias("canny_mean"))
    return _named(hit, f"{prefix}gradient_")


def nuclei(px: DataFrame, objects: DataFrame, height: int, width: int, around: DataFrame | None = None, ring: int = 8, levels: int = 32, shapes: bool = True, canny: bool = True) -> DataFrame:
    """All features of the objects (slide_id, y, x, label) over nuclear pixels (slide_id, y, x, i).

    With ``around`` (pixels of the same form), those of the cytoplasm too: the ring of ``ring`` pixels around each nucleus.
    Sizes, axes, box and orientation; with ``shapes`` perimeter, hull, moment invariants and Fourier descriptors;
    twelve of intensity, eight of the gradient, thirteen of texture with mean and range over four offsets.
    """
    sides = [("nucleus_", px, objects)]
    if around is not None:
        sides.append(("cytoplasm_", around, labels.ring(objects, height, width, ring)))
    out = labels.moments(objects)
    if shapes:
        out = out.join(tiles.shapes(objects), KEY)
    if shapes:
        weighed = labels.invariants(objects.join(px, ["slide_id", "y", "x"]), "i")
        out = out.join(weighed.select(*KEY, *(F.col(f"hu{k}").alias(f"weighted_hu{k}") for k in range(1, 8))), KEY, "left")
    for prefix, image, parts in sides:
        steep = stencil.gradient(image, ("slide_id",)).select("slide_id", "y", "x", "i", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"))
        out = out.join(of_pixels(steep.join(parts, ["slide_id", "y", "x"]), levels, prefix), KEY, "left")
        if canny:
            out = out.join(edge_pixels(image, parts, prefix=prefix), KEY, "left")
    return out
