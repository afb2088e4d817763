"""Predicates, aggregates and neighbourhoods over pixel tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.functions import colour
from slidespark.sources.storage import grown


@dataclass(frozen=True)
class PositiveParams:
    hue: float = 0.05
    width: float = 0.15
    saturation: float = 0.05
    upper: float = 0.95
    weak: float = 0.65
    strong: float = 0.35
    lower: float = 0.05


def positive_labels(pixels: DataFrame, p: PositiveParams = PositiveParams()) -> DataFrame:
    """Adds the intensity and the class: 0 negative, 1 weak, 2 plain, 3 strong."""
    h, s, i = colour.hsi(F.col("r"), F.col("g"), F.col("b"))
    far = h - F.lit(p.hue) + 0.5
    near = F.abs(far - F.floor(far) - 0.5) <= p.width / 2
    hit = near & (s >= p.saturation) & (i < p.upper) & (i >= p.lower)
    kind = F.when(~hit, 0).when(i >= p.weak, 1).when(i < p.strong, 3).otherwise(2)
    return pixels.withColumn("intensity", i).withColumn("kind", kind)


def positive_counts(pixels: DataFrame, by: str = "slide_id", p: PositiveParams = PositiveParams()) -> DataFrame:
    """One aggregate pass; every ratio is 0 where its denominator is."""
    t = positive_labels(pixels, p)
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("intensity")).otherwise(0.0))
    t = t.groupBy(by).agg(F.count("*").alias("n_pixels"), n(1).alias("n_weak"), n(2).alias("n_plain"), n(3).alias("n_strong"), total(1).alias("i_weak"), total(2).alias("i_plain"), total(3).alias("i_strong"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    every = F.col("n_weak") + F.col("n_plain") + F.col("n_strong")
    return t.select(
        by, "n_pixels", "n_weak", "n_plain", "n_strong",
        ratio(F.col("i_weak") + F.col("i_plain") + F.col("i_strong"), every).alias("intensity_average"),
        ratio(F.col("n_strong"), every).alias("ratio_strong_to_total"),
        ratio(F.col("i_weak") + F.col("i_plain"), F.col("n_weak") + F.col("n_plain")).alias("intensity_average_weak_and_plain"),
        ratio(every, F.col("n_pixels")).alias("ratio_total_to_pixels"),
    )


def intensity_features(px: DataFrame, by: str, value: str = "i") -> DataFrame:
    """First-order statistics by object: population moments, linear quantiles, ten bins over the object's own range."""
    med = px.groupBy(by).agg(F.median(value).alias("median"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    t = px.join(grown(med), by)
    bin_ = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * 10), F.lit(9))
    hist = t.groupBy(by, F.coalesce(bin_, F.lit(5)).alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    hist = hist.withColumn("p", p).groupBy(by).agg(F.sum(F.col("p") * F.col("p")).alias("energy"), F.sum(-F.col("p") * F.ln("p")).alias("entropy"))
    stats = t.groupBy(by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.first("median").alias("median"), F.stddev_pop(value).alias("std"),
        (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return stats.join(grown(hist), by).select(by, "min", "max", r("mean"), r("median"), F.round(F.col("mean") - F.col("median"), 6).alias("mean_median_diff"), r("std"), r("iqr"), r("mad"), r("skewness"), r("kurtosis"), r("energy"), r("entropy"))


OFFSETS = ((0, 1), (1, 0), (1, 1), (1, -1))


def glcm(px: DataFrame, by: str, levels: int = 8, offsets=OFFSETS, key: str | None = None) -> DataFrame:
    """(by, offset, i, j, n): grey-level pairs.

    Along rows, columns and diagonals the neighbour is the next pixel of the line, if it is adjacent; other offsets join on shifted coordinates.
    """
    key = key or by
    names = [key, *([by] if by != key else [])]
    q = px.select(*names, "y", "x", F.round(F.col("i") / 255 * (levels - 1)).cast("int").alias("q"))
    lines = {(0, 1): ("y", "x"), (1, 0): ("x", "y"), (1, 1): (F.col("y") - F.col("x"), "y"), (1, -1): (F.col("y") + F.col("x"), "y")}
    parts = []
    for k, (dy, dx) in enumerate(offsets):
        if line := lines.get((dy, dx)):
            w = Window.partitionBy(key, line[0]).orderBy(line[1])
            ahead = q.select(*names, "q", F.lead("q").over(w).alias("j"), (F.lead(line[1]).over(w) == F.col(line[1]) + 1).alias("near")).where("near")
        else:
            near = q.select(F.col(key).alias("k2"), F.col("q").alias("j"), (F.col("y") - dy).alias("y2"), (F.col("x") - dx).alias("x2"))
            ahead = q.join(near, (F.col(key) == F.col("k2")) & (F.col("y") == F.col("y2")) & (F.col("x") == F.col("x2")))
        parts.append(ahead.groupBy(by, F.lit(k).alias("offset"), F.col("q").alias("i"), "j").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionAll, parts)


def texture(counts: DataFrame, by: str) -> DataFrame:
    """Texture measures of each symmetric normalised matrix, averaged over offsets."""
    both = counts.select(by, "offset", "i", "j", "n").unionByName(counts.select(by, "offset", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(by, "offset", "i", "j").agg(F.sum("n").alias("n"))
    p = both.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by, "offset")))
    d = F.col("i") - F.col("j")
    one = p.groupBy(by, "offset").agg(
        F.sum(F.col("p") * F.col("p")).alias("asm"), F.sum(d * d * F.col("p")).alias("contrast"), F.sum(F.col("p") / (1 + d * d)).alias("idm"), F.sum(-F.col("p") * F.log2(F.col("p") + 1e-5)).alias("entropy"),
        F.sum(F.col("i") * F.col("p")).alias("mu"), F.sum(F.col("i") * F.col("i") * F.col("p")).alias("ii"), F.sum(F.col("i") * F.col("j") * F.col("p")).alias("ij"),
    )
    var = F.col("ii") - F.col("mu") * F.col("mu")
    one = one.withColumn("variance", var).withColumn("correlation", F.coalesce((F.col("ij") - F.col("mu") * F.col("mu")) / F.when(var > 1e-12, var), F.lit(0.0)))
    return one.groupBy(by).agg(*(F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("asm", "contrast", "correlation", "variance", "idm", "entropy")), *(F.round(F.max(c) - F.min(c), 6).alias(f"{c}_range") for c in ("asm", "contrast")))


def otsu(px: DataFrame, by: str, value: str = "i") -> DataFrame:
    """Threshold of largest between-class variance: running sums over at most 256 bins by group."""
    h = px.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy(by).orderBy("v"), Window.partitionBy(by)
    t = h.select(by, "v", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_).alias("s"))
    t = t.where("w0 < w").withColumn("gap", F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")))
    t = t.withColumn("score", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * F.col("gap") * F.col("gap"), 4))
    return t.groupBy(by).agg(F.min_by("v", F.struct(-F.col("score"), F.col("v"))).alias("threshold"))


def poisson_threshold(px: DataFrame, by: str, value: str = "i") -> DataFrame:
    """(by, threshold, low_mean, high_mean): the split of the grey histogram into two Poisson kinds of least cost; the first one if alike."""
    eps = 2.0**-52
    h = px.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    h = h.withColumn("h", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    up = Window.partitionBy(by).orderBy("v")
    t = h.select(by, "v", F.sum("h").over(up).alias("p"), F.sum(F.col("v") * F.col("h")).over(up).alias("m"), F.sum(F.col("v") * F.col("h")).over(Window.partitionBy(by)).alias("mu"))
    none = 1 - F.col("p") <= 1e-12
    t = t.withColumns({"p0": F.greatest("p", F.lit(eps)), "p1": F.when(none, eps).otherwise(1 - F.col("p"))})
    t = t.withColumns({"m0": F.col("m") / F.col("p0") + eps, "m1": F.when(none, 0.0).otherwise(F.greatest(F.col("mu") - F.col("m"), F.lit(0.0)) / F.col("p1") + eps)})
    tail = F.when(none, 0.0).otherwise(F.col("m1") * F.ln(F.greatest("m1", F.lit(eps))))
    cost = F.col("mu") - F.col("p0") * (F.ln("p0") + F.col("m0") * F.ln("m0")) - F.col("p1") * (F.ln("p1") + tail)
    best = F.min_by(F.struct("v", "m0", "m1"), F.struct(F.round(cost, 9), F.col("v"))).alias("b")
    return t.groupBy(by).agg(best).select(by, F.col("b.v").alias("threshold"), F.round("b.m0", 6).alias("low_mean"), F.round("b.m1", 6).alias("high_mean"))
