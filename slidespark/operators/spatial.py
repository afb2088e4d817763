"""Regions, tiles and overlays: spatial joins, painter's order, polygons and layouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidespark.operators.annotations import CELL, _cells
from slidespark.operators.groups import Arrays, per_group
from slidespark.sources.storage import grown, materialize


def tile_grid(slides: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(slide_id, position, x, y, width, height) of all tiles of slides (slide_id, width, height), row by row."""
    step = size - overlap
    starts = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c) - 1 - overlap, F.lit(0)), F.lit(step))
    t = slides.select("slide_id", "width", "height", F.explode(starts("height")).alias("y"), F.size(starts("width")).alias("across"))
    t = t.join(slides.select("slide_id", F.posexplode(starts("width")).alias("c", "x")), "slide_id")
    return t.select("slide_id", (F.floor(F.col("y") / step) * F.col("across") + F.col("c")).cast("int").alias("position"), "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("width"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("height"))


def thumbnail(pixels: DataFrame, factor: int) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy("slide_id", at("y"), at("x")).agg(*(F.round(F.avg(c), 6).alias(c) for c in "rgb"))


def intersecting(e: DataFrame, windows: DataFrame, cell: int = CELL) -> DataFrame:
    """(window_id, element_id): boxes with a common area of more than nothing, by an equi-join on grid cells; each pair in the one cell that owns its corner."""
    a = _cells(e, cell).select("slide_id", "gx", "gy", "element_id", "xmin", "ymin", "xmax", "ymax")
    b = _cells(windows, cell).select("slide_id", "gx", "gy", "window_id", *(F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    left, top = F.greatest("xmin", "wxmin"), F.greatest("ymin", "wymin")
    hit = (left < F.least("xmax", "wxmax")) & (top < F.least("ymax", "wymax")) & (F.floor(left / cell) == F.col("gx")) & (F.floor(top / cell) == F.col("gy"))
    return a.join(b, ["slide_id", "gx", "gy"]).where(hit).select("window_id", "element_id")


def containing(e: DataFrame, holders: DataFrame, cell: int = CELL) -> DataFrame:
    """Ids of boxes that lie within a holder of their slide; the holder covers the box's first corner, whose cell joins them."""
    at = lambda c: F.floor(F.col(c) / cell)
    a = e.select("slide_id", "element_id", "xmin", "ymin", "xmax", "ymax", at("xmin").alias("gx"), at("ymin").alias("gy"))
    b = _cells(holders, cell).select("slide_id", "gx", "gy", *(F.col(c).alias(f"h{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    hit = (F.col("hxmin") <= F.col("xmin")) & (F.col("hymin") <= F.col("ymin")) & (F.col("hxmax") >= F.col("xmax")) & (F.col("hymax") >= F.col("ymax"))
    return a.join(b, ["slide_id", "gx", "gy"]).where(hit).select("element_id").distinct()


def drop_open_background(contours: DataFrame, background: str) -> DataFrame:
    """Contours without those of the background group that no holed contour of another group encloses."""
    back = contours.where(F.col("grp") == background)
    inside = containing(back, contours.where((F.col("grp") != background) & (F.col("has_holes") == 1)))
    return contours.where(F.coalesce(F.col("grp") != background, F.lit(True))).unionByName(back.join(inside, "element_id", "left_semi"))


def shared_edges(tiles: DataFrame, near: int = 2) -> DataFrame:
    """(slide_id, a, edge_a, b, edge_b), a < b: tiles whose opposite edges lie less than ``near`` apart and that overlap along them.

    An edge meets another on the same or the next coordinates, so the join is on equal ones.
    """
    sides = {"left": ("right", "top", "bottom"), "right": ("left", "top", "bottom"), "top": ("bottom", "left", "right"), "bottom": ("top", "left", "right")}
    edge = lambda n: F.struct(F.lit(n).alias("edge"), F.lit(sides[n][0]).alias("other"), F.col(n).alias("at"), F.col(sides[n][1]).alias("lo"), F.col(sides[n][2]).alias("hi"))
    t = tiles.select("slide_id", "tile_id", F.explode(F.array(*(edge(n) for n in sides))).alias("s")).select("slide_id", "tile_id", "s.*")
    steps = F.explode(F.array(*(F.lit(k) for k in range(1 - near, near))))
    a = t.select("slide_id", F.col("tile_id").alias("a"), F.col("edge").alias("edge_a"), F.col("other").alias("edge_b"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), "at", steps.alias("step")).withColumn("at", F.col("at") + F.col("step")).drop("step")
    b = t.select("slide_id", F.col("tile_id").alias("b"), F.col("edge").alias("edge_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "at")
    span = F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b")
    return a.join(b, ["slide_id", "at", "edge_b"]).where((F.col("a") < F.col("b")) & (span < F.col("hi_a") - F.col("lo_a") + F.col("hi_b") - F.col("lo_b"))).select("slide_id", "a", "edge_a", "b", "edge_b")


def gaps(e: DataFrame, reach: int, cell: int = CELL) -> DataFrame:
    """(slide_id, a, b), a < b: boxes of one slide and group whose distance is below ``reach``."""
    wide = e.select("slide_id", "grp", "element_id", (F.col("xmin") - reach).alias("xmin"), (F.col("ymin") - reach).alias("ymin"), (F.col("xmax") + reach).alias("xmax"), (F.col("ymax") + reach).alias("ymax"))
    side = lambda d, s: _cells(d, cell).select("slide_id", "grp", "gx", "gy", *(F.col(c).alias(f"{c}_{s}") for c in ("element_id", "xmin", "ymin", "xmax", "ymax")))
    p = side(wide, "a").join(side(e, "b"), ["slide_id", "grp", "gx", "gy"]).where("element_id_a < element_id_b")
    left, top = F.greatest("xmin_a", "xmin_b"), F.greatest("ymin_a", "ymin_b")
    own = (F.floor(left / cell) == F.col("gx")) & (F.floor(top / cell) == F.col("gy")) & (left <= F.least("xmax_a", "xmax_b")) & (top <= F.least("ymax_a", "ymax_b"))
    dx = F.greatest(F.lit(0), F.col("xmin_a") + reach - F.col("xmax_b"), F.col("xmin_b") - F.col("xmax_a") + reach)
    dy = F.greatest(F.lit(0), F.col("ymin_a") + reach - F.col("ymax_b"), F.col("ymin_b") - F.col("ymax_a") + reach)
    return p.where(own & (dx * dx + dy * dy < reach * reach)).select("slide_id", F.col("element_id_a").alias("a"), F.col("element_id_b").alias("b"))


def _outermost(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes that no other one of the same first corner holds, and for each box one of these that shares its corner."""
    order = np.lexsort((-y1, -x1, y0, x0))
    x, y, low = x0[order], y0[order], y1[order]
    corner = np.r_[0, np.cumsum((x[1:] != x[:-1]) | (y[1:] != y[:-1]))]
    top = low - low.min() + corner * (low.max() - low.min() + 1)  # later corners lie above all earlier ones
    kept = np.r_[True, top[1:] > np.maximum.accumulate(top)[:-1]]
    heads = order[np.flatnonzero(np.r_[True, corner[1:] != corner[:-1]])][corner]
    stands = np.empty(len(order), int)
    stands[order] = np.where(kept, order, heads)
    return order[kept], stands


def _parts_of_boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, reach: float) -> np.ndarray:
    """For each box the first one of its part, boxes nearer than ``reach`` being linked; memory is linear in the boxes.

    A box within another one is near to all that is near to it, so only outermost boxes are searched.
    """
    k, stands = _outermost(x0, y0, x1, y1)
    a0, b0, a1, b1 = x0[k], y0[k], x1[k], y1[k]
    part, todo, found = np.full(len(x0), -1), np.arange(len(k)), 0
    while len(todo):
        front, todo = todo[:1], todo[1:]
        part[k[front]] = found
        while len(front) and len(todo):
            hit = np.zeros(len(todo), bool)
            for f in range(0, len(front), 64):
                g = front[f : f + 64, None]
                dx = np.maximum(0, np.maximum(a0[g] - a1[todo], a0[todo] - a1[g]))
                dy = np.maximum(0, np.maximum(b0[g] - b1[todo], b0[todo] - b1[g]))
                hit |= (dx * dx + dy * dy < reach * reach).any(axis=0)
            front, todo = todo[hit], todo[~hit]
            part[k[front]] = found
        found += 1
    part = part[stands]
    return np.unique(part, return_index=True)[1][part]


def near_forest(e: DataFrame, reach: int, cell: int = 2 * CELL) -> DataFrame:
    """(a, b): links of boxes (slide_id, grp, element_id, ...) whose components are those of all pairs nearer than ``reach``.

    Boxes are dealt to the cells that they come near to. A cell links each of its boxes to the first one of its part there,
    so that links grow with the boxes and not with the pairs.
    """
    wide = e.select("slide_id", "grp", "element_id", *((F.col(c) + d * reach).alias(c) for c, d in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))))
    keys = ["slide_id", "grp", "gx", "gy"]

    def links(t: Arrays) -> Arrays | None:
        if len(t["element_id"]) < 2:
            return None
        order = np.argsort(t["element_id"])
        box = [(t[c][order] + d * reach).astype(float) for c, d in (("xmin", 1), ("ymin", 1), ("xmax", -1), ("ymax", -1))]
        ids, first = t["element_id"][order], _parts_of_boxes(*box, reach)
        far = first != np.arange(len(ids))
        return {"a": ids[first[far]], "b": ids[far]}

    kind = dict(e.dtypes)["element_id"]
    return per_group(_cells(wide.where("slide_id is not null and grp is not null"), cell).select(*keys, "element_id", "xmin", "ymin", "xmax", "ymax"), keys, links, f"a {kind}, b {kind}")


def paint(e: DataFrame, codes: DataFrame, step: int) -> DataFrame:
    """(slide_id, y, x, gt_code, element_id): which element shows at each cell of a grid, later ones over earlier ones.

    Elements are drawn by overlay order, larger boxes first, then by id. A grid cell keeps one maximum, whatever overlaps there.
    """
    area = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    grid = lambda a, b: F.explode(F.sequence(F.ceil(F.col(a) / step), F.floor(F.col(b) / step)))
    t = e.join(F.broadcast(codes), "grp").where((F.ceil(F.col("xmin") / step) <= F.floor(F.col("xmax") / step)) & (F.ceil(F.col("ymin") / step) <= F.floor(F.col("ymax") / step)))
    # places in drawing order are numbers, whose maxima are counted in hash tables of the grid's size; structs would be sorted cell by cell
    order = Window.partitionBy("slide_id").orderBy("overlay_order", F.desc(area), "element_id")
    drawn = materialize(t.select("slide_id", "gt_code", "element_id", "xmin", "ymin", "xmax", "ymax", F.row_number().over(order).alias("place")))
    cells = drawn.select("slide_id", "place", grid("ymin", "ymax").alias("y"), "xmin", "xmax").select("slide_id", "place", "y", grid("xmin", "xmax").alias("x"))
    top = cells.groupBy("slide_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("place").alias("place"))
    return top.join(grown(drawn.select("slide_id", "place", "gt_code", "element_id")), ["slide_id", "place"]).select("slide_id", "y", "x", "gt_code", "element_id")


def spans(edges: DataFrame, by: str) -> DataFrame:
    """(by, y, x0, x1): the runs of pixels inside polygons by the even-odd rule, from edges (by, x1, y1, x2, y2).

    A polygon is cut row by row; the crossings of a row pair up in order, and a run reaches from one to the next, its end left out.
    """
    rows = F.explode(F.sequence(F.ceil(F.least("y1", "y2")).cast("int"), F.greatest("y1", "y2").cast("int")))
    cut = edges.where("y1 <> y2").withColumn("y", rows).where((F.col("y") >= F.least("y1", "y2")) & (F.col("y") < F.greatest("y1", "y2")))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = cut.groupBy(by, "y").agg(F.sort_array(F.collect_list(at)).alias("c"))
    pairs = F.explode(F.sequence(F.lit(0), (F.size("c") / 2 - 1).cast("int")))
    runs = crossed.withColumn("k", pairs).select(by, "y", F.ceil(F.element_at("c", 2 * F.col("k") + 1)).cast("int").alias("x0"), (F.ceil(F.element_at("c", 2 * F.col("k") + 2)) - 1).cast("int").alias("x1"))
    return runs.where("x0 <= x1")


def joined_runs(runs: DataFrame, by: str) -> DataFrame:
    """The union of runs (by, y, x0, x1): those that meet or overlap in a row become one."""
    w = Window.partitionBy(by, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = runs.select(by, "y", "x0", "x1", F.coalesce((F.col("x0") > reach + 1).cast("int"), F.lit(1)).alias("new"))
    return t.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "y", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def union_runs(e: DataFrame, by: str, cell: int = 2 * CELL) -> DataFrame:
    """(by, y, x0, x1): the union of the boxes (slide_id, grp, ...) of each ``by``, rims included, as runs of pixels that end at the cells of a grid.

    Boxes of one slide and group that overlap have one ``by``. A cell is painted in one task, so rows grow with what is covered and not with the boxes.
    """
    keys = ["slide_id", "grp", "gx", "gy"]

    def paint_cell(t: Arrays) -> Arrays:
        left, top = int(t["gx"][0]) * cell, int(t["gy"][0]) * cell
        left, right = max(left, int(t["xmin"].min())), min(left + cell - 1, int(t["xmax"].max()))
        top, low = max(top, int(t["ymin"].min())), min(top + cell - 1, int(t["ymax"].max()))
        x0, x1 = np.maximum(t["xmin"] - left, 0), np.minimum(t["xmax"], right) - left
        y0, y1 = np.maximum(t["ymin"] - top, 0), np.minimum(t["ymax"], low) - top
        names, number = np.unique(t[by], return_inverse=True)
        at = np.full((low - top + 1, right - left + 3), -1, np.int32)
        for i in _outermost(x0, y0, x1, y1)[0].tolist():
            at[y0[i] : y1[i] + 1, x0[i] + 1 : x1[i] + 2] = number[i]
        on, change = at[:, 1:-1] >= 0, at[:, 1:] != at[:, :-1]
        y, begin = np.nonzero(on & change[:, :-1])
        _, end = np.nonzero(on & change[:, 1:])
        return {by: names[at[y, begin + 1]], "y": (y + top).astype(np.int32), "x0": (begin + left).astype(np.int32), "x1": (end + left).astype(np.int32)}

    # boxes without a slide or group are linked to none, and are painted by themselves
    alone = F.coalesce(F.when(F.col("slide_id").isNull() | F.col("grp").isNull(), F.col(by).cast("string")), F.lit(""))
    dealt = _cells(e, cell).select(alone.alias("alone"), F.coalesce("slide_id", F.lit(-1)).alias("slide_id"), F.coalesce("grp", F.lit("")).alias("grp"), "gx", "gy", by, "xmin", "ymin", "xmax", "ymax")
    return per_group(dealt, ["alone", *keys], paint_cell, f"{by} {dict(e.dtypes)[by]}, y int, x0 int, x1 int")


def box_runs(e: DataFrame, by: str) -> DataFrame:
    """Boxes, their rims included, as runs."""
    return e.select(by, F.explode(F.sequence("ymin", "ymax")).alias("y"), F.col("xmin").alias("x0"), F.col("xmax").alias("x1"))


def ring_edges(polygons: DataFrame, by: str, points: str = "points") -> DataFrame:
    """(by, x1, y1, x2, y2): the sides of closed rings given as arrays of (x, y)."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    side = F.explode(F.arrays_zip(F.col(points).alias("a"), after.alias("b"))).alias("s")
    return polygons.select(by, side).select(by, *(F.col(f"s.{e}.{c}").cast("double").alias(f"{c}{k}") for k, e in ((1, "a"), (2, "b")) for c in "xy"))


def region_polygons(region: list[float]) -> list[list[tuple[float, float]]]:
    """Polygons of a region argument: 4 numbers are a rectangle, 6 a centre and half sizes, others points that (-1, -1) parts; all -1 is the whole slide."""
    if not region or all(v == -1 for v in region):
        return []
    if len(region) == 4:
        x, y, w, h = region
        return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]
    if len(region) == 6:
        x, y, _, rx, ry, _ = region
        return [[(x - rx, y - ry), (x + rx, y - ry), (x + rx, y + ry), (x - rx, y + ry)]]
    if len(region) % 2:
        raise ValueError("a region has 4, 6 or an even number of values")
    out: list[list[tuple[float, float]]] = [[]]
    for x, y in zip(region[::2], region[1::2], strict=True):
        if x == -1 and y == -1:
            out.append([])
        else:
            out[-1].append((x, y))
    if any(len(p) < 3 for p in out):
        raise ValueError("a polygon has three points or more")
    return out


def region_box(region: list[float], width: int, height: int, most: int | None = None) -> dict[str, int]:
    """Bounds of a region within a slide; too large a region is an error."""
    points = [p for poly in region_polygons(region) for p in poly]
    if not points:
        return {"left": 0, "top": 0, "width": width, "height": height}
    left, top = max(0, int(min(p[0] for p in points))), max(0, int(min(p[1] for p in points)))
    right, bottom = min(width, int(max(p[0] for p in points))), min(height, int(max(p[1] for p in points)))
    if most is not None and (right - left > most or bottom - top > most):
        raise ValueError("the region is too large")
    return {"left": left, "top": top, "width": max(0, right - left), "height": max(0, bottom - top)}


def sub_tiles(rois: DataFrame, most: int) -> DataFrame:
    """Regions cut into tiles of at most ``most`` a side."""
    starts = lambda a, b: F.explode(F.sequence(F.col(a), F.greatest(F.col(b) - 1, F.col(a)), F.lit(most)))
    t = rois.withColumn("ty", starts("ymin", "ymax")).withColumn("tx", starts("xmin", "xmax"))
    return t.select("slide_id", "element_id", F.col("tx").alias("xmin"), F.col("ty").alias("ymin"), F.least(F.col("tx") + most, F.col("xmax")).alias("xmax"), F.least(F.col("ty") + most, F.col("ymax")).alias("ymax"))


def gallery(tiles: DataFrame, per_row: int = 2, per_column: int = 5, padding: int = 25) -> DataFrame:
    """(tile_id, gallery, row, col, xmin, ymin, xmax, ymax): tiles (by, tile_id, width, height) packed into galleries in order of id.

    A strip begins one pixel wide, and each tile stands ``padding`` behind what is there; strips stack alike.
    """
    n = per_row * per_column
    t = tiles.withColumn("k", F.row_number().over(Window.partitionBy("slide_id").orderBy("tile_id")) - 1)
    t = t.select("*", F.floor(F.col("k") / n).cast("int").alias("gallery"), F.floor(F.col("k") % n / per_row).cast("int").alias("row"), (F.col("k") % per_row).cast("int").alias("col"))
    strip = Window.partitionBy("slide_id", "gallery", "row").orderBy("col")
    x0 = 1 + padding * (F.col("col") + 1) + F.coalesce(F.sum("width").over(strip.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = t.groupBy("slide_id", "gallery", "row").agg(F.max("height").alias("tall"))
    y0 = 1 + padding * (F.col("row") + 1) + F.coalesce(F.sum("tall").over(Window.partitionBy("slide_id", "gallery").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("y0", y0.cast("int"))
    t = t.withColumn("x0", x0.cast("int")).join(rows.select("slide_id", "gallery", "row", "y0"), ["slide_id", "gallery", "row"])
    return t.select("slide_id", "tile_id", "gallery", "row", "col", F.col("x0").alias("xmin"), F.col("y0").alias("ymin"), (F.col("x0") + F.col("width")).cast("int").alias("xmax"), (F.col("y0") + F.col("height")).cast("int").alias("ymax"))


def product_codes(numbers: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, product), a < b in [low, high): one pair for each product, that of the least first factor. ``numbers`` has every k of the range."""
    a = numbers.where(F.col("k").between(low, high - 1)).select(F.col("k").alias("a"))
    pairs = a.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.greatest(F.lit(high - 1), F.col("a") + 1)))).where(F.col("b") < high)
    return pairs.groupBy((F.col("a") * F.col("b")).alias("product")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "product")


def object_codes(e: DataFrame, pairs: DataFrame, rest: str = "error") -> DataFrame:
    """Adds the k-th pair (a, b) of product codes to the k-th element; elements beyond the pairs are an error, or with ``rest`` "without" get no row."""
    if rest not in ("error", "without"):
        raise ValueError(f"unknown rest {rest}")
    ranked = pairs.withColumn("k", F.row_number().over(Window.orderBy("a", "b")))  # 17,437 rows at most
    if rest == "without":
        return e.join(F.broadcast(ranked.select("k", "a", "b")), "k").select(*e.columns, "a", "b")
    known = lambda c: F.when(F.col(f"__{c}").isNull(), F.raise_error(F.lit("a slide has more elements than there are codes"))).otherwise(F.col(f"__{c}")).alias(c)
    return e.join(ranked.select("k", F.col("a").alias("__a"), F.col("b").alias("__b")), "k", "left").select(*e.columns, known("a"), known("b"))


def mode_bounds(slides: DataFrame, elements: DataFrame, mode: str, region: list[float] | None = None) -> DataFrame:
    """(slide_id, xmin, ymin, xmax, ymax) of the part of each slide (slide_id, width, height) that a run covers.

    ``wsi`` is the whole slide, ``min_bounding_box`` the box of all its elements, ``manual`` the given (xmin, ymin, xmax, ymax)
    and ``polygonal`` the box of the elements that are regions; all are cut to the slide, and slides without any are left out.
    """
    box = [f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    if mode == "wsi":
        t = slides.select("slide_id", F.lit(0).alias("xmin"), F.lit(0).alias("ymin"), F.col("width").alias("xmax"), F.col("height").alias("ymax"))
    elif mode == "manual":
        if not region or len(region) != 4 or region[0] >= region[2] or region[1] >= region[3]:
            raise ValueError("a manual run needs xmin, ymin, xmax and ymax")
        t = slides.select("slide_id", *(F.lit(int(v)).alias(c) for v, c in zip(region, ("xmin", "ymin", "xmax", "ymax"), strict=True)))
    elif mode in ("min_bounding_box", "polygonal"):
        t = (elements if mode == "min_bounding_box" else elements.where("is_roi = 1")).groupBy("slide_id").agg(*box)
    else:
        raise ValueError(f"unknown mode {mode}")
    t = t.join(slides.select("slide_id", "width", "height"), "slide_id")
    cut = lambda c, side: F.least(F.greatest(F.col(c), F.lit(0)), F.col(side)).cast("int").alias(c)
    t = t.select("slide_id", cut("xmin", "width"), cut("ymin", "height"), cut("xmax", "width"), cut("ymax", "height"))
    return t.where("xmin < xmax and ymin < ymax")


SUPER_ROI = 255


def mask_codes(codes: DataFrame) -> DataFrame:
    """Group codes with one more row, ``super_roi`` of code 255 that is drawn first; codes that are null, outside 1 to 254 or without a background class are errors."""
    checked = F.when(F.col("gt_code").isNull() | (F.col("gt_code") <= 0) | (F.col("gt_code") >= SUPER_ROI), F.raise_error(F.concat(F.lit("code out of 1 to 254: "), F.coalesce("grp", F.lit("no group"))))).otherwise(F.col("gt_code"))
    t = codes.select("grp", F.col("overlay_order").cast("int").alias("overlay_order"), checked.cast("int").alias("gt_code"), "is_roi", "is_background_class")
    first = t.agg((F.coalesce(F.min("overlay_order"), F.lit(0)) - 1).alias("o"), F.coalesce(F.max("is_background_class"), F.lit(0)).alias("b"))
    extra = first.select(F.lit("super_roi").alias("grp"), F.col("o").cast("int").alias("overlay_order"), F.when(F.col("b") == 1, F.lit(SUPER_ROI)).otherwise(F.raise_error(F.lit("no background class"))).cast("int").alias("gt_code"), F.lit(1).alias("is_roi"), F.lit(0).alias("is_background_class"))
    return t.unionByName(extra)


def pyramid(px: DataFrame, levels: int) -> DataFrame:
    """(slide_id, level, y, x, r, g, b): mosaics of half the side for each level, means of the pixels below, level 0 being the image."""
    t = px.select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "y", "x", *"rgb")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(c)
    return t.groupBy("slide_id", "level", at("y"), at("x")).agg(*(F.avg(c).alias(c) for c in "rgb"))


def file_bounds(path: Column) -> list[Column]:
    """left, top, right, bottom and id in a file name like ``slide_id-X_left-1_top-2_bottom-3_right-4.png``."""
    of = lambda k: F.regexp_extract(path, rf"{k}-(-?\d+)", 1).cast("int").alias(k)
    return [F.regexp_extract(path, r"([^/_]+)_[^/]*$", 1).alias("slide_name"), F.regexp_extract(path, r"_id-([^_/]+)", 1).alias("id"), *(of(k) for k in ("left", "top", "right", "bottom"))]
