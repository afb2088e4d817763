"""Annotation documents: from JSON to tables of documents, elements and boxes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The part of a document that the tables hold.
ELEMENT = "struct<id: string, type: string, `group`: string, label: struct<value: string>, lineColor: string, points: array<array<double>>, center: array<double>, width: double, height: double, rotation: double>"
DOCUMENT = f"struct<_id: string, itemId: string, created: string, creatorId: string, updated: string, updatedId: string, public: boolean, groups: array<string>, annotation: struct<name: string, elements: array<{ELEMENT}>>, elements: array<{ELEMENT}>>"


def parsed(raw: DataFrame, column: str = "json") -> DataFrame:
    """(doc, elements): one row for each document; elements at the top or within the annotation. A text that is no JSON gives nulls."""
    doc = raw.withColumn("doc", F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"}))
    return doc.withColumn("elements", F.coalesce("doc.elements", "doc.annotation.elements", F.array().cast(f"array<{ELEMENT}>")))


def _corners(e: Column) -> Column:
    """Vertices (x, y) of an element, cut to whole numbers; points and rectangles become closed rings."""
    cut = lambda c: c.cast("int")
    cx, cy = cut(e["center"][0]), cut(e["center"][1])
    w, h = cut(e["width"] / 2), cut(e["height"] / 2)
    turn = F.coalesce(e["rotation"], F.lit(0.0))
    at = lambda a, b: F.array(cut(F.cos(turn) * (a * w) - F.sin(turn) * (b * h) + cx), cut(F.sin(turn) * (a * w) + F.cos(turn) * (b * h) + cy))
    box = F.array(*(at(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    dot = F.array(*(F.array(cx, cy) for _ in range(5)))
    return F.when(e["type"] == "polyline", F.transform(e["points"], lambda p: F.array(cut(p[0]), cut(p[1])))).when(e["type"] == "rectangle", box).when(e["type"] == "point", dot)


def elements(raw: DataFrame, column: str = "json", shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row for each element: group and label stand in for each other, turned rectangles are polylines, coordinates relative to ``shift``."""
    t = parsed(raw, column).select(F.col("doc._id").alias("annotation_id"), F.posexplode("elements").alias("element_index", "e"))
    t = t.withColumn("v", F.transform(_corners(F.col("e")), lambda p: F.array(p[0] - shift[0], p[1] - shift[1])))
    xs, ys = F.transform("v", lambda p: p[0]), F.transform("v", lambda p: p[1])
    t = t.withColumns({"xs": xs, "ys": ys}).withColumns({"xmin": F.array_min("xs"), "xmax": F.array_max("xs"), "ymin": F.array_min("ys"), "ymax": F.array_max("ys")})
    turned = (F.col("e.type") == "rectangle") & (F.coalesce("e.rotation", F.lit(0.0)) != 0)
    return t.select(
        "annotation_id", "element_index", F.col("e.id").alias("element_id"), F.when(turned, "polyline").otherwise(F.col("e.type")).alias("type"),
        F.coalesce("e.group", "e.label.value").alias("grp"), F.coalesce("e.label.value", "e.group").alias("label"), F.col("e.lineColor").alias("color"),
        "xmin", "xmax", "ymin", "ymax", ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("bbox_area"),
        F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("coords_x"), F.array_join(F.transform("ys", lambda x: x.cast("string")), ",").alias("coords_y"),
    )


def documents(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row for each document: who, when, name, and the number of elements."""
    return parsed(raw, column).select(
        F.col("doc._id").alias("annotation_id"), F.col("doc.itemId").alias("item_id"), F.col("doc.annotation.name").alias("name"), F.col("doc.created").alias("created"), F.col("doc.creatorId").alias("creator_id"),
        F.coalesce("doc.public", F.lit(False)).alias("public"), F.col("doc.updated").alias("updated"), F.col("doc.updatedId").alias("updated_id"), F.array_join(F.coalesce("doc.groups", F.array().cast("array<string>")), ",").alias("groups"), F.size("elements").alias("n_elements"),
    )


def boxes(raw: DataFrame, column: str = "json") -> DataFrame:
    """(annotation_id, element_index, type, xmin, ymin, xmax, ymax, bbox_area): points have no box."""
    dot = F.col("type") == "point"
    return elements(raw, column).select("annotation_id", "element_index", "type", *(F.when(~dot, F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "bbox_area")))


def ring(xs: Column, ys: Column, factor: float, dx: float, dy: float) -> Column:
    """JSON points (x, y, 0) of comma-joined coordinates, scaled, moved and closed."""
    num = lambda c: F.transform(F.split(c, ","), lambda t: t.cast("double"))
    pairs = F.zip_with(num(xs), num(ys), lambda x, y: F.array(x * factor + dx, y * factor + dy, F.lit(0.0)))
    return F.when(F.element_at(pairs, 1) == F.element_at(pairs, -1), pairs).otherwise(F.concat(pairs, F.slice(pairs, 1, 1)))


def from_contours(contours: DataFrame, by_group: bool = True, size: int = 1000, name: str = "contours", factor: float = 1.0, dx: float = 0.0, dy: float = 0.0, opacity: float = 0.0, id_col: str = "element_id") -> DataFrame:
    """(grp, chunk, n, json): documents of at most about ``size`` contours; the rest of a group joins its last document.

    Contours have grp, label, color, coords_x, coords_y and an id. A chunk is numbered by the rank of
    its elements, and a document is a row of bounded size.
    """
    keys = ["slide_id", "grp"] if by_group else ["slide_id"]
    w = Window.partitionBy(*keys)
    t = contours.withColumn("k", F.row_number().over(w.orderBy(id_col))).withColumn("n", F.count("*").over(w))
    chunk = F.least(F.floor((F.col("k") - 1) / size), F.greatest(F.ceil(F.col("n") / size) - 2, F.lit(0))).cast("int")
    fill = F.concat(F.regexp_replace(F.regexp_replace("color", r"^rgb\(", "rgba("), r"\)$", ""), F.lit(f",{opacity:.1f})"))
    element = F.struct(F.col(id_col).alias("k"), F.struct(
        F.col("grp").alias("group"), F.lit("polyline").alias("type"), F.col("color").alias("lineColor"), F.lit(2.0).alias("lineWidth"), F.lit(True).alias("closed"),
        ring(F.col("coords_x"), F.col("coords_y"), factor, dx, dy).alias("points"), F.struct(F.col("label").alias("value")).alias("label"), *([fill.alias("fillColor")] if opacity > 0 else []),
    ).alias("e"))
    docs = t.withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(element)).alias("es"))
    body = F.to_json(F.struct(F.concat_ws("-", F.lit(name), *([F.col("grp")] if by_group else []), F.col("chunk").cast("string")).alias("name"), F.lit("").alias("description"), F.transform("es", lambda x: x["e"]).alias("elements")))
    return docs.select(*keys, "chunk", "n", body.alias("json"))


def with_attributes(docs: DataFrame, attributes: dict[str, str], column: str = "json") -> DataFrame:
    """Adds an ``attributes`` object to the JSON of every document."""
    made = F.to_json(F.map_from_arrays(F.array(*(F.lit(k) for k in attributes)), F.array(*(F.lit(v) for v in attributes.values()))))
    return docs.withColumn(column, F.concat(F.substring(column, 1, F.length(column) - 1), F.lit(',"attributes":'), made, F.lit("}")))


def merge_access(current: DataFrame, change: DataFrame, replace: bool = False) -> DataFrame:
    """(annotation_id, user_id, level): the change's rows, and those of users that it does not name unless it replaces all."""
    if replace:
        kept = current.join(change.select("annotation_id").distinct(), "annotation_id", "left_anti")
    else:
        kept = current.join(change.select("annotation_id", "user_id"), ["annotation_id", "user_id"], "left_anti")
    return kept.unionByName(change)


def restyle(elements_: DataFrame, styles: DataFrame) -> DataFrame:
    """Elements with the group, label and colour that ``styles`` (grp, new_grp, new_color) gives their group."""
    t = elements_.join(styles, "grp", "left")
    return t.select(*(c for c in elements_.columns if c not in ("grp", "color")), F.coalesce("new_grp", "grp").alias("grp"), F.coalesce("new_color", "color").alias("color"))
