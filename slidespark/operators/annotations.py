"""Annotation elements: boxes, overlaps, summaries and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell of the overlap join; boxes are at most some cells wide.
CELL = 128


def _cells(e: DataFrame, cell: int) -> DataFrame:
    grid = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return e.withColumn("gx", grid("xmin", "xmax")).withColumn("gy", grid("ymin", "ymax"))


def overlaps(e: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of intersecting boxes of a slide (earlier, later) with their IoU.

    An equi-join on grid cells; a pair is made in the one cell that holds the corner of its
    intersection, so that none comes twice and nothing is deduplicated.
    """
    side = lambda s: _cells(e, cell).select("slide_id", "gx", "gy", *(F.col(c).alias(f"{c}_{s}") for c in ("element_id", "xmin", "ymin", "xmax", "ymax")))
    p = side("a").join(side("b"), ["slide_id", "gx", "gy"]).where("element_id_a < element_id_b")
    left, right = F.greatest("xmin_a", "xmin_b"), F.least("xmax_a", "xmax_b")
    top, low = F.greatest("ymin_a", "ymin_b"), F.least("ymax_a", "ymax_b")
    p = p.where((left <= right) & (top <= low) & (F.floor(left / cell) == F.col("gx")) & (F.floor(top / cell) == F.col("gy")))
    area = lambda s: (F.col(f"xmax_{s}") - F.col(f"xmin_{s}") + 1) * (F.col(f"ymax_{s}") - F.col(f"ymin_{s}") + 1)
    common = (right - left + 1) * (low - top + 1)
    return p.select("slide_id", "element_id_a", "element_id_b", F.round(common / (area("a") + area("b") - common), 6).alias("iou"))


def remove_overlaps(e: DataFrame) -> DataFrame:
    """Drops every element that an earlier one of its slide intersects, whether that one stays or not."""
    return e.join(overlaps(e).select(F.col("element_id_b").alias("element_id")).distinct(), "element_id", "left_anti")


def rotated_boxes(e: DataFrame) -> DataFrame:
    """Bounding boxes of the boxes turned about their centres; every step truncates."""
    angle = (F.col("element_id") % 4) * 0.5
    w, h = F.floor((F.col("xmax") - F.col("xmin")) / 2), F.floor((F.col("ymax") - F.col("ymin")) / 2)
    cx, cy = F.floor((F.col("xmin") + F.col("xmax")) / 2), F.floor((F.col("ymin") + F.col("ymax")) / 2)
    xs = [(cx + F.cos(angle) * (a * w) - F.sin(angle) * (b * h)).cast("int") for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    ys = [(cy + F.sin(angle) * (a * w) + F.cos(angle) * (b * h)).cast("int") for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return e.select("element_id", F.least(*xs).alias("xmin"), F.greatest(*xs).alias("xmax"), F.least(*ys).alias("ymin"), F.greatest(*ys).alias("ymax"))


def chunks(e: DataFrame, size: int) -> DataFrame:
    """Deals the elements of a slide out to documents of ``size``; the rest joins the last one."""
    w = Window.partitionBy("slide_id").orderBy("element_id")
    count = e.groupBy("slide_id").agg(F.count("*").alias("n"))
    t = e.withColumn("k", F.row_number().over(w)).join(count, "slide_id")
    last = F.greatest(F.ceil(F.col("n") / size) - 2, F.lit(0))
    return t.select("slide_id", "element_id", F.least(F.floor((F.col("k") - 1) / size), last).cast("int").alias("chunk"))


def latest(versions: DataFrame) -> DataFrame:
    """Newest version of each annotation that has groups."""
    return versions.where("n_groups > 0").groupBy("annotation_id").agg(F.max("version").alias("version"))


def folder_paths(folders: DataFrame, depth: int = 2) -> DataFrame:
    """Names from the root down; one self-join for each level."""
    up = folders.select(F.col("folder_id").alias("up"), F.col("parent_id").alias("next"), F.col("name").alias("up_name"))
    t = folders.select("folder_id", "parent_id", F.col("name").alias("path"))
    for _ in range(depth - 1):
        t = t.join(up, F.col("parent_id") == F.col("up"), "left").select("folder_id", F.col("next").alias("parent_id"), F.when(F.col("up_name").isNull(), F.col("path")).otherwise(F.concat_ws("/", "up_name", "path")).alias("path"))
    return t.select("folder_id", "path")


def merge_colinear(vertices: DataFrame, by: str) -> DataFrame:
    """Vertices (by, k, x, y) without those equal to the next one, and then without those on a straight line between their neighbours."""
    w = Window.partitionBy(by).orderBy("k")
    same = (F.lead("x").over(w) == F.col("x")) & (F.lead("y").over(w) == F.col("y"))
    t = vertices.withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")
    step = lambda c: (F.col(c) - F.lag(c).over(w)).cast("double")
    ahead = lambda c: (F.lead(c).over(w) - F.col(c)).cast("double")
    line = F.coalesce(step("x") * ahead("y") == ahead("x") * step("y"), F.lit(False))
    return t.withColumn("__line", line).where("not __line").drop("__line")
