"""Label images: sparse tables (slide_id, y, x, label), background left out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.functions import chance
from slidespark.operators.components import components
from slidespark.sources.storage import grown, materialize, release


def condense(labels: DataFrame) -> DataFrame:
    """Numbers the labels of each slide from 1 in ascending order; only distinct labels are ranked."""
    ids = labels.select("slide_id", "label").distinct().withColumn("new", F.dense_rank().over(Window.partitionBy("slide_id").orderBy("label")).cast("int"))
    return labels.join(grown(ids), ["slide_id", "label"]).select("slide_id", "y", "x", F.col("new").alias("label"))


def delete(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids, ids.columns, "left_anti")


def delete_border(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Drops labels that touch the frame; a slide is renumbered only if one was dropped."""
    edge = labels.where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)).select("slide_id", "label").distinct()
    hit = edge.select("slide_id").distinct()
    kept = delete(labels, grown(edge))
    return condense(kept.join(hit, "slide_id", "left_semi")).unionByName(kept.join(hit, "slide_id", "left_anti").select("slide_id", "y", "x", "label"))


def area_open(labels: DataFrame, least: int) -> DataFrame:
    big = labels.groupBy("slide_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("slide_id", "label")
    return condense(labels.join(grown(big), ["slide_id", "label"], "left_semi"))


def _shifted(labels: DataFrame, shifts) -> DataFrame:
    """Each pixel under the coordinates of its neighbours."""
    s = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in shifts)))
    t = labels.select("slide_id", "y", "x", F.col("label").alias("near"), s.alias("s"))
    return t.select("slide_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "near")


def perimeter(labels: DataFrame, height: int, width: int, shifts=((0, 1), (0, -1), (1, 0), (-1, 0))) -> DataFrame:
    """Pixels with a neighbour in the image of another label or of the background."""
    y, x = F.col("y"), F.col("x")
    inside = sum(((y - a).between(0, height - 1) & (x - b).between(0, width - 1)).cast("int") for a, b in shifts)
    same = labels.join(grown(_shifted(labels, shifts)), ["slide_id", "y", "x"]).where("label = near").groupBy("slide_id", "y", "x").agg(F.count("*").alias("alike"))
    return labels.join(grown(same), ["slide_id", "y", "x"], "left").where(F.coalesce("alike", F.lit(0)) < inside).select("slide_id", "y", "x", "label")


def adjacency(labels: DataFrame) -> DataFrame:
    """(slide_id, a, b), a < b: labels that touch, by right and lower neighbours only."""
    t = labels.join(grown(_shifted(labels, ((0, -1), (-1, 0)))), ["slide_id", "y", "x"]).where("label <> near")
    return t.select("slide_id", F.least("label", "near").alias("a"), F.greatest("label", "near").alias("b")).distinct()


def largest(labels: DataFrame, n: int) -> DataFrame:
    """The n largest regions of each slide; ties by label."""
    t = labels.groupBy("slide_id", "label").agg(F.count("*").alias("area"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("x").alias("xmin"), F.max("x").alias("xmax"))
    w = Window.partitionBy("slide_id").orderBy(F.desc("area"), "label")
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def delete_margin(labels: DataFrame, height: int, width: int, overlap: dict[str, int]) -> DataFrame:
    """Drops labels that reach into half of the overlap at any side, and renumbers slides that lost one."""
    half = {k: v // 2 for k, v in overlap.items()}
    y, x = F.col("y"), F.col("x")
    rim = (y < half.get("top", 0)) | (y >= height - half.get("bottom", 0)) | (x < half.get("left", 0)) | (x >= width - half.get("right", 0))
    gone = labels.where(rim).select("slide_id", "label").distinct()
    hit = gone.select("slide_id").distinct()
    kept = delete(labels, grown(gone))
    return condense(kept.join(hit, "slide_id", "left_semi")).unionByName(kept.join(hit, "slide_id", "left_anti").select("slide_id", "y", "x", "label"))


def ring(labels: DataFrame, height: int, width: int, reach: int) -> DataFrame:
    """Background pixels within ``reach`` of an object, with the label of the nearest one; of the nearest, the least label.

    Only pixels at the rim of objects spread, to the offsets of a disk.
    """
    disk = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if 0 < a * a + b * b <= reach * reach]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in disk))).alias("o")
    spread = perimeter(labels, height, width).select("slide_id", "y", "x", "label", offsets)
    at = spread.select("slide_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.struct((F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx")).alias("d2"), F.col("label")).alias("near"))
    at = at.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    best = at.groupBy("slide_id", "y", "x").agg(F.min("near").alias("near")).join(grown(labels), ["slide_id", "y", "x"], "left_anti")
    return best.select("slide_id", "y", "x", F.col("near.label").alias("label"))


EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))


def connected(mask: DataFrame, by: str = "slide_id", conn: int = 4, same: str | None = None) -> DataFrame:
    """(by, y, x, component): the component is numbered by its least pixel, ``y * 2**20 + x``.

    Runs along rows are found with windows; runs of neighbouring rows that touch become edges of a
    graph whose components are found by hooking. ``same`` keeps pixels of different values apart.
    """
    keys = [by, *([same] if same else [])]
    w = Window.partitionBy(*keys, "y").orderBy("x")
    start = F.when(F.col("x") - F.lag("x").over(w) == 1, None).otherwise(F.col("x"))
    runs = mask.select(*keys, "y", "x").withColumn("s", F.last(start, ignorenulls=True).over(w))
    runs = materialize(runs)
    spans = runs.groupBy(*keys, "y", "s").agg(F.max("x").alias("e"))
    node = lambda y, x: F.struct(F.col(by).alias("g"), (F.col(y) * (1 << 20) + F.col(x)).cast("long").alias("p"))
    reach = 0 if conn == 4 else 1
    # two runs touch where one holds the other's first pixel, or lies next to it
    cells = runs.select(*keys, "y", "x", "s")
    below = cells.select(*keys, (F.col("y") - 1).alias("y"), F.col("x").alias("x"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    if reach:
        below = below.withColumn("d", F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))).withColumn("x", F.col("x") + F.col("d")).drop("d")
    edges = cells.join(grown(below), [*keys, "y", "x"]).select(node("y", "s").alias("a"), node("y2", "s2").alias("b")).distinct()
    roots = components(edges)
    named = spans.select(*keys, "y", "s", node("y", "s").alias("v")).join(grown(roots), "v", "left").select(*keys, "y", "s", F.coalesce(F.col("root.p"), F.col("v.p")).alias("component"))
    return runs.join(grown(named), [*keys, "y", "s"]).select(*keys, "y", "x", "component")


def split(labels: DataFrame, conn: int = 8) -> DataFrame:
    """Gives every further component of a label a new number, above all labels of its slide; the first keeps it."""
    condensed = condense(labels)
    parts = connected(condensed, conn=conn, same="label")
    kinds = parts.select("slide_id", "label", "component").distinct()
    kinds = kinds.withColumn("k", F.row_number().over(Window.partitionBy("slide_id", "label").orderBy("component")))
    top = condensed.groupBy("slide_id").agg(F.max("label").alias("top"))
    extra = kinds.where("k > 1").withColumn("n", F.row_number().over(Window.partitionBy("slide_id").orderBy("label", "component"))).join(top, "slide_id")
    new = extra.select("slide_id", "label", "component", (F.col("top") + F.col("n")).cast("int").alias("new"))
    return parts.join(grown(new), ["slide_id", "label", "component"], "left").select("slide_id", "y", "x", F.coalesce("new", "label").alias("label"))


def shuffle(labels: DataFrame, seed: int = 0) -> DataFrame:
    """Permutes the labels of each slide; the same seed gives the same permutation."""
    ids = labels.select("slide_id", "label").distinct()
    a = ids.withColumn("k", F.row_number().over(Window.partitionBy("slide_id").orderBy("label")))
    b = ids.withColumn("k", F.row_number().over(Window.partitionBy("slide_id").orderBy(chance.mixed(F.col("label"), F.col("slide_id"), seed=seed), "label"))).withColumnRenamed("label", "new")
    return labels.join(grown(a.join(grown(b), ["slide_id", "k"])), ["slide_id", "label"]).select("slide_id", "y", "x", F.col("new").alias("label"))


def taxicab_depth(labels: DataFrame, most: int) -> DataFrame:
    """Adds depth: city-block distance to the nearest pixel of another label, up to ``most``; pixels outside the image are other ones.

    Each round peels the pixels that a shallower one touches; rounds are bounded by ``most``.
    """
    deep = labels.withColumn("depth", F.lit(1))
    four = ((0, 1), (0, -1), (1, 0), (-1, 0))
    for k in range(1, most):
        inner = deep.where(F.col("depth") == k)
        held = inner.join(grown(_shifted(inner.select("slide_id", "y", "x", "label"), four)), ["slide_id", "y", "x"]).where("label = near").groupBy("slide_id", "y", "x").agg(F.count("*").alias("alike")).where("alike = 4").drop("alike")
        deep = materialize(deep.join(grown(held.withColumn("up", F.lit(1))), ["slide_id", "y", "x"], "left").select("slide_id", "y", "x", "label", (F.col("depth") + F.coalesce("up", F.lit(0))).alias("depth")))
    return deep


def width_open(labels: DataFrame, width: int) -> DataFrame:
    """Drops labels that are nowhere ``width`` deep, and renumbers."""
    wide = taxicab_depth(labels, width).groupBy("slide_id", "label").agg(F.max("depth").alias("depth")).where(F.col("depth") >= width).select("slide_id", "label")
    return condense(labels.join(grown(wide), ["slide_id", "label"], "left_semi"))


def compact(labels: DataFrame, compaction: int = 3) -> DataFrame:
    """Cuts thin spurs: sweeping depths down from ``compaction - 1``, pixels without a deeper neighbour sink by one; at 0 they go.

    Depths are those of the foreground as a whole.
    """
    four = ((0, 1), (0, -1), (1, 0), (-1, 0))
    depth = taxicab_depth(labels.select("slide_id", "y", "x", F.lit(1).alias("label")), compaction).select("slide_id", "y", "x", "depth")
    for k in range(compaction - 1, 0, -1):
        around = _shifted(depth.select("slide_id", "y", "x", F.col("depth").alias("label")), four).groupBy("slide_id", "y", "x").agg(F.max("near").alias("near"))
        sink = (F.col("depth") == k) & (F.greatest("depth", F.coalesce("near", F.lit(0))) < k + 1)
        depth, old = materialize(depth.join(grown(around), ["slide_id", "y", "x"], "left").select("slide_id", "y", "x", (F.col("depth") - sink.cast("int")).alias("depth"))), depth
        release(old)
    return labels.join(grown(depth.where("depth > 0").select("slide_id", "y", "x")), ["slide_id", "y", "x"], "left_semi")


def colour(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slide_id, label, colour): greedy colouring in order of labels, the least colour that no earlier neighbour has.

    A slide's graph of touching objects is coloured in one task, as each colour hangs on the ones before.
    """

    def greedy(key, table):
        a = table.dropna(subset=["b"]).groupby("label")["b"].agg(set).to_dict()
        found: dict[int, int] = {}
        for v in sorted(table["label"].unique()):
            taken = {found[u] for u in a.get(v, ()) if u in found}
            found[v] = next(c for c in range(1, len(taken) + 2) if c not in taken)
        return pd.DataFrame({"slide_id": key[0], "label": list(found), "colour": list(found.values())})

    both = edges.select("slide_id", F.col("a").alias("label"), "b").unionByName(edges.select("slide_id", F.col("b").alias("label"), F.col("a").alias("b")))
    every = nodes.select("slide_id", "label").distinct().join(grown(both), ["slide_id", "label"], "left")
    return every.groupBy("slide_id").applyInPandas(greedy, "slide_id int, label int, colour int")


def embed(pixels: DataFrame, rim: DataFrame, paint: tuple[int, int, int]) -> DataFrame:
    """Pixels with those of the rim in one colour."""
    hit = pixels.join(grown(rim.select("slide_id", "y", "x").distinct().withColumn("__hit", F.lit(True))), ["slide_id", "y", "x"], "left")
    return hit.select("slide_id", "y", "x", *(F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", paint, strict=True)))


def moments(labels: DataFrame) -> DataFrame:
    """Area, box, centroid, axes, orientation, eccentricity, extent and equivalent diameter of every label, by one aggregate of coordinate powers.

    Axes are those of the ellipse of the same second moments, each pixel counted as a unit square.
    """
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    whole = lambda a, b: F.sum((F.col(a).cast("long") * F.col(b).cast("long")).cast("decimal(20,0)"))
    t = labels.groupBy("slide_id", "label").agg(
        F.count("*").alias("area"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min("x").alias("xmin"), F.max("x").alias("xmax"),
        F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.sum(F.col("y").cast("long")).alias("sy"), F.sum(F.col("x").cast("long")).alias("sx"), whole("y", "y").alias("yy"), whole("x", "x").alias("xx"), whole("x", "y").alias("xy"),
    )
    # sums of whole numbers are exact, so a covariance of nothing is 0 and no rounding error of either sign
    n = F.col("area").cast("double")
    central = lambda both, a, b: (F.col("area").cast("decimal(20,0)") * F.col(both) - F.col(a).cast("decimal(20,0)") * F.col(b).cast("decimal(20,0)")).cast("double") / (n * n)
    u20 = central("xx", "sx", "sx") + F.lit(1 / 12)
    u02 = central("yy", "sy", "sy") + F.lit(1 / 12)
    u11 = central("xy", "sx", "sy")
    root = F.sqrt((u20 - u02) * (u20 - u02) + 4 * u11 * u11)
    big, small = (u20 + u02 + root) / 2, F.greatest((u20 + u02 - root) / 2, F.lit(0.0))
    major, minor = 4 * F.sqrt(big), 4 * F.sqrt(small)
    # the angle between the rows and the major axis; a quarter turn where both axes are alike
    quarter = F.lit(0.7853981633974483)
    turn = F.when(F.abs(u02 - u20) < 1e-9, F.when(u11 > 1e-9, -quarter).otherwise(quarter)).otherwise(F.atan2(2 * u11, u02 - u20) / 2)
    box = (F.col("ymax") - F.col("ymin") + 1) * (F.col("xmax") - F.col("xmin") + 1)
    r = lambda c, n: F.round(c, 5).alias(n)
    return t.select(
        "slide_id", "label", "area", "ymin", "ymax", "xmin", "xmax", r(F.col("cy"), "cy"), r(F.col("cx"), "cx"), r(turn, "orientation"), r(major, "major_axis"), r(minor, "minor_axis"),
        r(F.sqrt(F.greatest(1 - small / big, F.lit(0.0))), "eccentricity"), r(F.sqrt(4 * F.col("area") / F.lit(3.141592653589793)), "equivalent_diameter"), r(F.col("area") / box, "extent"),
        r(F.coalesce(minor / F.nullif(major, F.lit(0.0)), F.lit(1.0)), "axis_ratio"),
    )


def invariants(labels: DataFrame, value: str | None = None) -> DataFrame:
    """(slide_id, label, hu1 .. hu7): Hu's moment invariants of every label, each pixel weighing one or its value.

    Centres come first and central moments second, so that far coordinates cost no digits.
    """
    w = F.lit(1.0) if value is None else F.col(value).cast("double")
    t = labels.select("slide_id", "label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w"))
    centre = t.groupBy("slide_id", "label").agg(F.sum("w").alias("m"), (F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("cx"), (F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("cy"))
    t = t.join(grown(centre), ["slide_id", "label"]).withColumns({"u": F.col("x") - F.col("cx"), "v": F.col("y") - F.col("cy")})
    power = lambda c, k: [F.lit(1.0), F.col(c), F.col(c) * F.col(c), F.col(c) * F.col(c) * F.col(c)][k]
    orders = ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))
    t = t.groupBy("slide_id", "label").agg(F.first("m").alias("m"), *(F.sum(F.col("w") * power("u", p) * power("v", q)).alias(f"s{p}{q}") for p, q in orders))
    n = {f"{p}{q}": F.coalesce(F.col(f"s{p}{q}") / F.pow("m", F.lit(1 + (p + q) / 2)), F.lit(0.0)) for p, q in orders}
    a, b, c, d, g = n["30"] + n["12"], n["21"] + n["03"], n["30"] - 3 * n["12"], 3 * n["21"] - n["03"], n["20"] - n["02"]
    made = [
        n["20"] + n["02"], g * g + 4 * n["11"] * n["11"], c * c + d * d, a * a + b * b,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), g * (a * a - b * b) + 4 * n["11"] * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]
    return t.select("slide_id", "label", *(x.alias(f"hu{k}") for k, x in enumerate(made, 1)))
