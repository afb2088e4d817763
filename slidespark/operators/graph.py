"""Cell-graph statistics over centroids (vec_id, label, cx, cy), a label being a slide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.sources.storage import materialize, release


def within(points: DataFrame, radius: float) -> DataFrame:
    """Ordered pairs of a slide not farther apart than ``radius``, by an equi-join on grid cells."""
    g = points.withColumn("gx", F.floor(F.col("cx") / radius)).withColumn("gy", F.floor(F.col("cy") / radius))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    near = g.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    near = near.select("label", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), F.col("vec_id").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d2 = (F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy"))
    return g.join(near, ["label", "gx", "gy"]).where(F.col("vec_id") != F.col("other")).select("label", "vec_id", "other", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def radius_counts(points: DataFrame, radius: int) -> DataFrame:
    n = within(points, radius).groupBy("label", "vec_id").agg(F.count("*").alias("n"))
    every = points.join(n, ["label", "vec_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.groupBy("label").agg(F.count("*").alias("n_points"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.max("n").alias("most"))


def _near_cells(points: DataFrame, cell: int, asking: DataFrame) -> DataFrame:
    """(label, vec_id, other, d2, edge): points in the nine cells around those that ask, and the squared distance that these are sure to cover."""
    at = lambda c: F.floor(F.col(c) / cell)
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = asking.select("label", "vec_id", "cx", "cy", at("cx").alias("gx"), at("cy").alias("gy"))
    inside = F.least(F.col("cx") - (F.col("gx") - 1) * cell, (F.col("gx") + 2) * cell - F.col("cx"), F.col("cy") - (F.col("gy") - 1) * cell, (F.col("gy") + 2) * cell - F.col("cy"))
    a = a.withColumn("edge", inside * inside).withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("label", "vec_id", "cx", "cy", "edge", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    b = points.select("label", at("cx").alias("gx"), at("cy").alias("gy"), F.col("vec_id").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d2 = (F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy"))
    return a.join(b, ["label", "gx", "gy"], "left").select("label", "vec_id", F.nullif("other", "vec_id").alias("other"), d2.alias("d2"), F.col("edge").alias("edge"))


def _first_cell(points: DataFrame, k: int, most: int) -> int:
    """The largest side, a half of a half of ``most`` and so on, at which a point shares its cell with at most about ``4 k`` others on the mean; else 1."""
    sides = [most >> i for i in range(most.bit_length())]
    at = lambda c: F.floor(F.col(c) / F.col("side"))
    t = points.select("label", "cx", "cy", F.explode(F.array(*(F.lit(n) for n in sides))).alias("side"))
    crowd = t.groupBy("label", "side", at("cx").alias("gx"), at("cy").alias("gy")).agg(F.count("*").cast("double").alias("n")).groupBy("side").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("with"))
    return max((r.side for r in crowd.collect() if r["with"] <= 4 * k), default=1)  # a row for each side


def nearest(points: DataFrame, k: int, cell: int = 64) -> DataFrame:
    """(label, vec_id, place, other, d2): the k nearest others of every point, exactly; ties by id.

    Points look into the nine grid cells around them. Who has k others nearer than the rim of
    those is done; the rest asks again in cells of twice the side, until one cell holds the slide.
    The first cells have at most the side ``cell``, and less where points are crowded, so that candidates grow with the points.
    """
    cell = _first_cell(points, k, cell)
    extent = points.agg(F.max(F.greatest(F.abs("cx"), F.abs("cy"))).alias("m")).first().m
    asking, done = points, []
    w = Window.partitionBy("label", "vec_id").orderBy("d2", "other")
    while extent is not None:
        last = cell > 2 * extent
        found = _near_cells(points, cell, asking).withColumn("place", F.row_number().over(w.orderBy(F.col("other").isNull(), "d2", "other")))
        found = materialize(found.where(F.col("place") <= k))
        sure = found.groupBy("label", "vec_id").agg((F.count("other") == k).alias("full"), F.max("d2").alias("far"), F.first("edge").alias("edge")).where(F.lit(last) | (F.col("full") & (F.col("far") < F.col("edge"))))
        done.append(found.where("other is not null").join(sure.select("vec_id", "label"), ["label", "vec_id"], "left_semi").select("label", "vec_id", "place", "other", "d2"))
        asking, old = materialize(asking.join(sure, ["label", "vec_id"], "left_anti")), asking
        if old is not points:
            release(old)
        if last or asking.isEmpty():
            break
        cell *= 2
    if not done:
        return points.limit(0).select("label", "vec_id", F.lit(0).alias("place"), F.col("vec_id").alias("other"), F.lit(0).alias("d2"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def trimmed_stats(t: DataFrame, by: Sequence[str], value: str = "v", rounds: int = 50) -> DataFrame:
    """(by, n, mean, std, min_max_ratio, disorder) after values beyond three deviations are left out until none is.

    What stays is an interval around the mean, so only the bounds of each group are carried from round to round.
    """
    by = list(by)
    bounds = t.select(*by).distinct().withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "n": F.lit(-1).cast("long")})
    held = None
    for _ in range(rounds):
        inside = t.join(bounds.select(*by, "lo", "hi"), by).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
        stats = inside.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
        merged = stats.join(bounds.select(*by, "lo", "hi", F.col("n").alias("before")), by)
        slack = 3 * F.col("std") * (1 + 1e-12) + 1e-12
        merged = materialize(merged.withColumns({"lo": F.greatest("lo", F.col("mean") - slack), "hi": F.least("hi", F.col("mean") + slack)}))
        if held is not None:
            release(held)
        held = merged
        if merged.where("n <> before").isEmpty():
            break
        bounds = merged.select(*by, "lo", "hi", "n")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return merged.select(*by, "n", "mean", "std", ratio(F.col("least").cast("double"), F.col("most").cast("double")).alias("min_max_ratio"), ratio(F.col("std"), F.col("mean") + F.col("std")).alias("disorder"))


STATS = ("mean", "stddev", "min_max_ratio", "disorder")
RADII, COUNTS = (10.0, 20.0, 30.0, 40.0, 50.0), (3, 5, 7)


def density_values(points: DataFrame, radii: Sequence[float] = RADII, counts: Sequence[int] = COUNTS) -> DataFrame:
    """(label, name, v): how many others lie within each radius, and how far the k-th other is, for the places of each slide.

    Names are ``neighbors_in_distance_0`` and so on, ``distance_for_neighbors_0`` and so on. Points on one place count once.
    """
    points = materialize(points.groupBy("label", "cx", "cy").agg(F.min("vec_id").alias("vec_id")))
    near = within(points, max(radii)).groupBy("label", "vec_id").agg(*(F.sum((F.col("d2") <= r * r).cast("long")).alias(f"n{i}") for i, r in enumerate(radii)))
    every = points.select("label", "vec_id").join(near, ["label", "vec_id"], "left")
    many = every.select("label", F.explode(F.array(*(F.struct(F.lit(f"neighbors_in_distance_{i}").alias("name"), F.coalesce(f"n{i}", F.lit(0)).cast("double").alias("v")) for i in range(len(radii))))).alias("x"))
    far = nearest(points, max(counts)).where(F.col("place").isin(*counts))
    place = F.element_at(F.create_map(*(F.lit(x) for k in enumerate(counts) for x in (k[1], f"distance_for_neighbors_{k[0]}"))), F.col("place"))
    return materialize(many.select("label", "x.name", "x.v").unionByName(far.select("label", place.alias("name"), F.sqrt("d2").alias("v"))))


def density(points: DataFrame, radii: Sequence[float] = RADII, counts: Sequence[int] = COUNTS) -> DataFrame:
    """(label, name, n, mean, std, min_max_ratio, disorder) of those values."""
    return trimmed_stats(density_values(points, radii, counts), ["label", "name"])


def wide(stats: DataFrame, names: Sequence[str], prefix: str = "density_") -> DataFrame:
    """(label, a column for each name and statistic) of ``density``."""
    cells = [F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{prefix}{n}_{to}") for n in names for c, to in zip(("mean", "std", "min_max_ratio", "disorder"), STATS, strict=True)]
    return stats.groupBy("label").agg(*cells)


DENSITY = (*(f"neighbors_in_distance_{i}" for i in range(len(RADII))), *(f"distance_for_neighbors_{i}" for i in range(len(COUNTS))))


def two_hop(edges: DataFrame, by: Sequence[str] = ("slide_id",)) -> DataFrame:
    """(by, a, b), a <= b: edges, and pairs with a common neighbour; a vertex with a neighbour reaches itself."""
    by = list(by)
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    far = both.join(both.select(*by, F.col("a").alias("b"), F.col("b").alias("c")), [*by, "b"]).select(*by, "a", F.col("c").alias("b"))
    return both.unionByName(far).where("a <= b").distinct()
