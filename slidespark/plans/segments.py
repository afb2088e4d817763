"""Queries that work on whole tiles, objects and slides, learners, readers and streams."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from slidespark import workflows
from slidespark.functions import colour
from slidespark.operators import annotations, annotations_json, features, graph, labels, learning, pixelstats, spatial, tiles, tissue
from slidespark.plans.base import Plans, as_sql_rounds
from slidespark.sources import fixtures as fx
from slidespark.sources import tables
from slidespark.sources.storage import shared_dir
from slidespark.streaming import counts

plans = Plans()
add = plans.add


def _round(t, n: int = 5):
    return t.select(*(F.round(c, n).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


add("nuclei_detect", lambda s, d: tiles.detect_nuclei(fx.pixels(s, d)))
add("nuclei_normalized", lambda s, d: _round(tiles.detect_nuclei(fx.pixels(s, d), p=tiles.Nuclei(150.0, smooth=1.0), reference=((8.63234435, -0.11501964, 0.03868433), (0.57506023, 0.10403329, 0.01364062)), drop_border=True), 4))
add("nuclei_without_overlaps", lambda s, d: annotations.remove_overlaps(tiles.detect_nuclei(fx.pixels(s, d)).withColumn("element_id", F.xxhash64("slide_id", "y", "x"))))
for kind in ("difference", "laplacian", "oriented"):
    add(f"blobs_{kind}", lambda s, d, kind=kind: _round(tiles.blobs(fx.patches(s, d), "vec_id", kind=kind)))
add("peak_labels", lambda s, d: tiles.peaks(fx.patches(s, d), "vec_id"))
for method in ("region", "edge", "flow", "rim"):
    add(f"contours_{method}", lambda s, d, method=method: tiles.contours(fx.patches(s, d), "vec_id", method=method))
add("canny_features", lambda s, d: _round(tiles.edges(fx.patches(s, d), "vec_id")))
add("vote_centres", lambda s, d: _round(tiles.vote_centres(fx.patches(s, d), "vec_id")))
add("boundary_trace", lambda s, d: tiles.boundaries(fx.blocks(s, d)))
add("mask_contours", lambda s, d: tiles.mask_contours(fx.blocks(s, d), 48, 48))
add(
    "mask_contour_flags",
    lambda s, d: tiles.mask_contours(fx.blocks(s, d), 48, 48).drop("coords_x", "coords_y"),
    fx.with_("blocks").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT slide_id, label, min(y) ymin, max(y) ymax, min(x) xmin, max(x) xmax FROM blocks GROUP BY 1, 2),
g AS (SELECT slide_id, label, y, x FROM (SELECT slide_id, label, unnest(range(ymin - 1, ymax + 2)) y, xmin, xmax FROM b) CROSS JOIN LATERAL (SELECT unnest(range(xmin - 1, xmax + 2)) x)),
e AS (SELECT g.* FROM g LEFT JOIN blocks k ON k.slide_id = g.slide_id AND k.label = g.label AND k.y = g.y AND k.x = g.x WHERE k.label IS NULL),
o(slide_id, label, y, x) AS (SELECT e.* FROM e JOIN b USING (slide_id, label) WHERE y = ymin - 1 AND x = xmin - 1 UNION SELECT e.* FROM o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx) JOIN e ON e.slide_id = o.slide_id AND e.label = o.label AND e.y = o.y + dy AND e.x = o.x + dx),
n AS (SELECT slide_id, label, count(*) n FROM e GROUP BY 1, 2), m AS (SELECT slide_id, label, count(*) m FROM o GROUP BY 1, 2)
SELECT slide_id, label, ymin, ymax, xmin, xmax, CAST(n > m AS INT) has_holes, CAST(ymin = 0 AS INT) touches_edge_top, CAST(xmin = 0 AS INT) touches_edge_left, CAST(ymax = 47 AS INT) touches_edge_bottom, CAST(xmax = 47 AS INT) touches_edge_right FROM b JOIN n USING (slide_id, label) JOIN m USING (slide_id, label)""",
)
add("object_shapes", lambda s, d: _round(tiles.shapes(fx.blocks(s, d))))
add("superpixels", lambda s, d: tiles.numbered(tiles.superpixels(fx.pixels(s, d))))
add("cell_graph", lambda s, d: _round(tiles.cell_graph(fx.points(s, d)).join(graph.wide(graph.density(fx.points(s, d)), graph.DENSITY), "label"), 4))


_nuclear = lambda s, d: fx.pixels(s, d).select("slide_id", "y", "x", F.col("r").alias("i"))
_stroma = lambda s, d: fx.pixels(s, d).select("slide_id", "y", "x", F.col("g").alias("i"))
add("nuclei_features", lambda s, d: _round(features.nuclei(_nuclear(s, d), fx.blocks(s, d), 48, 48, _stroma(s, d), 4, 8)))


def _band(prefix: str, channel: str, parts: str) -> str:
    """Tables of intensity, gradient and texture of the objects in ``parts`` over one channel."""
    p, by = prefix, "slide_id, label"
    twelve = ", ".join(f'round({e}::DOUBLE, 6) {p}intensity_{n}' for n, e in (("mean", "mu"), ("median", "med"), ("mean_median_diff", "mu - med"), ("std", "sd"), ("iqr", "iqr"), ("mad", "mad"), ("skewness", "skew"), ("kurtosis", "kurt"), ("energy", "energy"), ("entropy", "entropy")))
    six = ", ".join(f'round({e}, 6) {p}gradient_{n}' for n, e in (("mean", "mu"), ("std", "sd"), ("skewness", "skew"), ("kurtosis", "kurt"), ("entropy", "entropy"), ("energy", "energy")))
    stats = lambda v, t: f"""(SELECT *, s.skew, e.energy, e.entropy FROM (SELECT {by}, min(v) lo, max(v) hi, avg(v) mu, median(v) med, stddev_pop(v) sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iqr, kurtosis_pop(v) kurt FROM (SELECT {by}, {v} v FROM {t}) GROUP BY 1, 2) a
  JOIN (SELECT x.slide_id, x.label, avg(pow({v} - mu, 3)) / nullif(pow(any_value(sd), 3), 0) skew, median(abs({v} - med)) mad FROM {t} x JOIN (SELECT {by}, avg({v}) mu, median({v}) med, stddev_pop({v}) sd FROM {t} GROUP BY 1, 2) y ON x.slide_id = y.slide_id AND x.label = y.label GROUP BY 1, 2) s USING ({by})
  JOIN (SELECT {by}, sum(q * q) energy, sum(-q * ln(q)) entropy FROM (SELECT {by}, bin, count(*) / sum(count(*)) OVER (PARTITION BY {by}) q FROM (SELECT x.slide_id, x.label, coalesce(least(floor(({v} - lo) / nullif(hi - lo, 0) * 10), 9), 5) bin FROM {t} x JOIN (SELECT {by}, min({v}) lo, max({v}) hi FROM {t} GROUP BY 1, 2) y ON x.slide_id = y.slide_id AND x.label = y.label) GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING ({by}))"""
    return f""", {p}g AS (SELECT slide_id, y, x, {channel} i, coalesce((lead({channel}) OVER v - lag({channel}) OVER v) / 2.0::DOUBLE, lead({channel}) OVER v - {channel}, {channel} - lag({channel}) OVER v, 0.0::DOUBLE) gy,
  coalesce((lead({channel}) OVER h - lag({channel}) OVER h) / 2.0::DOUBLE, lead({channel}) OVER h - {channel}, {channel} - lag({channel}) OVER h, 0.0::DOUBLE) gx FROM pixels WINDOW v AS (PARTITION BY slide_id, x ORDER BY y), h AS (PARTITION BY slide_id, y ORDER BY x)),
{p}px AS (SELECT {by}, y, x, i, sqrt(gx * gx + gy * gy) mag FROM {p}g JOIN {parts} USING (slide_id, y, x)),
{p}in AS (SELECT {by}, lo {p}intensity_min, hi {p}intensity_max, {twelve} FROM {stats("i", p + "px")}),
{p}gr AS (SELECT {by}, {six} FROM {stats("mag", p + "px")})"""


_RING = """, o AS (SELECT slide_id, y, x, label FROM blocks), g48 AS (SELECT a.v y, b.v x FROM (SELECT CAST(range AS INT) v FROM range(48)) a CROSS JOIN (SELECT CAST(range AS INT) v FROM range(48)) b),
near AS (SELECT o.slide_id, g48.y, g48.x, (o.y - g48.y) * (o.y - g48.y) + (o.x - g48.x) * (o.x - g48.x) d2, label FROM o JOIN g48 ON abs(o.y - g48.y) <= 4 AND abs(o.x - g48.x) <= 4),
rim AS (SELECT slide_id, y, x, label FROM near WHERE d2 <= 16 AND (slide_id, y, x) NOT IN (SELECT slide_id, y, x FROM o) QUALIFY row_number() OVER (PARTITION BY slide_id, y, x ORDER BY d2, label) = 1)"""
_PARTS = [f"{side}_{kind}_{n}" for side in ("nucleus", "cytoplasm") for kind, ns in (("intensity", ("min", "max", "mean", "median", "mean_median_diff", "std", "iqr", "mad", "skewness", "kurtosis", "energy", "entropy")), ("gradient", ("mean", "std", "skewness", "kurtosis", "entropy", "energy"))) for n in ns]


def _bands(t):
    """The columns with SQL; those that come with six digits end in 5 too often for two ways of rounding."""
    t = t.select("slide_id", "label", "area", "orientation", "major_axis", *_PARTS)
    return t.select(*(as_sql_rounds(F.col(c), 5).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes))


add(
    "nuclei_feature_bands",
    lambda s, d: _bands(features.nuclei(_nuclear(s, d), fx.blocks(s, d), 48, 48, _stroma(s, d), 4, 8, shapes=False, canny=False)),
    fx.with_("pixels", "blocks") + _RING + _band("nucleus_", "r", "o") + _band("cytoplasm_", "g", "rim") + f""", m AS (SELECT slide_id, label, count(*) area, var_pop(x) + 1 / 12.0::DOUBLE a, var_pop(y) + 1 / 12.0::DOUBLE c, covar_pop(x, y) b FROM blocks GROUP BY 1, 2)
SELECT slide_id, label, area, round(CASE WHEN abs(c - a) < 1e-9 THEN CASE WHEN b > 1e-9 THEN -pi() / 4 ELSE pi() / 4 END ELSE atan2(2 * b, c - a) / 2 END, 5) orientation, round(4 * sqrt((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2), 5) major_axis, {", ".join(c if c.endswith(("_min", "_max")) else f"round({c}, 5) {c}" for c in _PARTS)}
FROM m LEFT JOIN nucleus_in USING (slide_id, label) LEFT JOIN nucleus_gr USING (slide_id, label) LEFT JOIN cytoplasm_in USING (slide_id, label) LEFT JOIN cytoplasm_gr USING (slide_id, label)""",
)


def _features(s, d):
    return pixelstats.intensity_features(fx.patches(s, d), "vec_id").join(fx.patches(s, d).groupBy("vec_id").agg(F.first("label").alias("truth")), "vec_id").withColumn("truth", (F.col("truth") % 2).cast("double"))


_NAMES = ["mean", "std", "median", "iqr"]


def _classified(s, d):
    t = _features(s, d)
    model = learning.forest(_NAMES, "truth").fit(t.na.fill(0.0, _NAMES))
    return learning.classify(t.select("vec_id", *_NAMES), model, _NAMES).select("vec_id", "class", F.round("confidence", 4).alias("confidence"))


add("classify_objects", _classified)
add("cluster_objects", lambda s, d: (t := _features(s, d)) and learning.clusterer(_NAMES).fit(t).transform(t).select("vec_id", "cluster"))
add("gmm_cellularity", lambda s, d: learning.cellularity(learning.mixture(_features(s, d), _NAMES, 3), "mean"))
add(
    "top_cellular",
    lambda s, d: learning.top_cellular(fx.pixels(s, d).join(fx.blocks(s, d), ["slide_id", "y", "x"]).groupBy("slide_id", "label").agg(F.round(F.avg("r"), 6).alias("mean")), "mean", 5),
    fx.with_("pixels", "blocks") + "SELECT slide_id, label, mean, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY mean DESC, label) AS INT) place FROM (SELECT slide_id, label, round(avg(r), 6) mean FROM pixels JOIN blocks USING (slide_id, y, x) GROUP BY 1, 2) QUALIFY place <= 5",
)


_size = lambda t: t.groupBy("slide_id", F.col("label").alias("component")).agg(F.count("*").alias("area"))
_PIECES = """, e AS (SELECT slide_id, min(v) lo, max(v) hi FROM g WHERE v > 0 GROUP BY 1),
h AS (SELECT slide_id, bin, count(*) n FROM (SELECT g.slide_id, coalesce(CAST(least(floor((v - lo) / nullif((hi - lo) / 256, 0.0)), 255) AS INT), 0) bin FROM g JOIN e USING (slide_id) WHERE v > 0) GROUP BY 1, 2),
t AS (SELECT slide_id, bin, sum(n) OVER u w0, sum(n * bin) OVER u s0, sum(n) OVER a w, sum(n * bin) OVER a s FROM h WINDOW u AS (PARTITION BY slide_id ORDER BY bin), a AS (PARTITION BY slide_id)),
l AS (SELECT t.slide_id, lo + (bin + 0.5) * (hi - lo) / 256 level FROM t JOIN e USING (slide_id) WHERE w0 < w QUALIFY row_number() OVER (PARTITION BY t.slide_id ORDER BY round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 4) DESC, bin) = 1),
m AS (SELECT g.slide_id, CAST(y AS BIGINT) * 1048576 + x p FROM g JOIN l USING (slide_id) WHERE v > 0 AND v >= level),
q AS (SELECT a.slide_id, a.p, b.p o FROM m a CROSS JOIN (VALUES (1), (-1), (1048576), (-1048576)) s(d) JOIN m b ON b.slide_id = a.slide_id AND b.p = a.p + d),
c(slide_id, p, root) USING KEY (slide_id, p) AS (SELECT slide_id, p, p FROM m UNION SELECT q.slide_id, q.o, min(c.root) FROM c JOIN q ON q.slide_id = c.slide_id AND q.p = c.p JOIN recurring.c f ON f.slide_id = q.slide_id AND f.p = q.o WHERE c.root < f.root GROUP BY 1, 2),
z AS (SELECT slide_id, root AS component, count(*) area FROM c GROUP BY 1, 2 HAVING count(*) >= {least}) """
_GREY = "255 - round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
_OD = lambda c: f"greatest(-ln(greatest({c}::DOUBLE, 1e-10) / 255.0) * 255 / {math.log(255.0)!r}, 0.0)"
_BLUE = f"255 - trunc(least(greatest(round(pow(255.0, 1 - {colour.sql_linear(np.linalg.inv(colour.stain_matrix()), [_OD(c) for c in 'rgb'])[0]} / 255), 6), 0), 255))"
_tissue_sql = lambda v, source="pixels", least=10: fx.with_("pixels").replace("WITH ", "WITH RECURSIVE ", 1) + f", g AS (SELECT slide_id, y, x, {v} v FROM {source})" + _PIECES.replace("{least}", str(least))
_TISSUE = _tissue_sql(_GREY)
add("tissue_mask", lambda s, d: _size(tissue.largest(tissue.pieces(fx.pixels(s, d), least=10))), _TISSUE + "SELECT slide_id, component, area FROM z QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY area DESC, component) = 1")
add("tissue_pieces", lambda s, d: _size(tissue.pieces(fx.pixels(s, d), least=10)), _TISSUE + "SELECT slide_id, component, area FROM z")
add("overview_tissue", lambda s, d: _size(tissue.overview(fx.pixels(s, d), 48, 16, least=4)), _tissue_sql(_GREY, "(SELECT slide_id, CAST(floor(y / 2) AS INT) y, CAST(floor(x / 2) AS INT) x, round(avg(r), 6) r, round(avg(g), 6) g, round(avg(b), 6) b FROM pixels GROUP BY 1, 2, 3)", 4) + "SELECT slide_id, component, area FROM z")
add("piece_cellularity", lambda s, d: workflows.piece_cellularity(fx.pixels(s, d), 3, 8, least=10))
add("piece_components", lambda s, d: workflows.piece_components(fx.pixels(s, d), least=10).groupBy("slide_id", "label", "part").agg(F.count("*").alias("n")), _TISSUE + ", k AS (SELECT slide_id, root, p FROM c WHERE (slide_id, root) IN (SELECT slide_id, component FROM z)) SELECT slide_id, root AS label, CASE WHEN r + g + b > 600 THEN 'white' WHEN b > r + 20 THEN 'blue' WHEN r > g + 60 THEN 'red' ELSE 'rest' END part, count(*) n FROM k JOIN pixels USING (slide_id) WHERE y = p // 1048576 AND x = p % 1048576 GROUP BY 1, 2, 3")
add("tissue_pieces_smoothed", lambda s, d: _size(tissue.pieces(fx.pixels(s, d), steps=2, sigma=1.0, least=10)))
add("tissue_pieces_by_stain", lambda s, d: _size(tissue.pieces(fx.pixels(s, d), deconvolve_first=True, least=10)), _tissue_sql(_BLUE) + "SELECT slide_id, component, area FROM z")


def _near_polygons(s, d):
    e = fx.elements(s, d)
    ring = e.select("element_id", F.concat_ws(",", "xmin", "xmax", "xmax", "xmin").alias("x"), F.concat_ws(",", "ymin", "ymin", "ymax", "ymax").alias("y"))
    pairs = spatial.gaps(e, 3).join(ring.toDF("a", "xa", "ya"), "a").join(ring.toDF("b", "xb", "yb"), "b")
    return tiles.ring_distance(pairs, 3.0).select("slide_id", "a", "b")


_GAP = "a.slide_id = b.slide_id AND a.grp = b.grp AND a.element_id < b.element_id AND pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2) < 9"
add("near_polygons", _near_polygons, fx.with_("elements") + f"SELECT a.slide_id, a.element_id a, b.element_id b FROM elements a JOIN elements b ON {_GAP}")
_rings = lambda s, d: fx.elements(s, d).select("element_id", F.concat_ws(",", "xmin", "xmax", "xmax", "xmin").alias("coords_x"), F.concat_ws(",", "ymin", "ymin", "ymax", "ymax").alias("coords_y"))
add(
    "crop_polygons",
    lambda s, d: tiles.crop(_rings(s, d), 500, 500, 1500, 1700).select("element_id", F.round("area", 6).alias("area")),
    fx.with_("elements") + "SELECT element_id, CAST(area AS DOUBLE) area FROM (SELECT element_id, (least(xmax, 1500) - greatest(xmin, 500)) * (least(ymax, 1700) - greatest(ymin, 500)) area, least(xmax, 1500) > greatest(xmin, 500) AND least(ymax, 1700) > greatest(ymin, 500) ok FROM elements) WHERE ok AND area > 2",
)


def _stored(s, d):
    """Annotation documents written as text, read, taken apart into tables, and the tables read."""
    at = f"{shared_dir(s).rstrip('/')}/slidespark-{uuid.uuid4().hex}"
    tables.write_json(fx.annotation_json(s, d), f"{at}/json")
    tables.export_annotations(s.read.text(f"{at}/json").withColumnRenamed("value", "json"), f"{at}/tables")
    return s.read.parquet(f"{at}/tables/annotation_elements").groupBy("type").agg(F.count("*").alias("n"))


add("stored_annotations", _stored, fx.with_("elements") + "SELECT CASE WHEN element_id % 10 = 0 THEN 'point' WHEN element_id % 10 <= 3 AND element_id % 4 = 0 THEN 'rectangle' ELSE 'polyline' END AS \"type\", count(*) n FROM elements GROUP BY 1")


def _features_file(s, d):
    at = f"{shared_dir(s).rstrip('/')}/slidespark-{uuid.uuid4().hex}.csv"
    tables.write_features(fx.elements(s, d).select("element_id", F.when(F.col("element_id") % 2 == 0, F.col("xmin")).alias("v")), at)
    return tables.read_features(s, at, "element_id long, v int").agg(F.sum("element_id").alias("ids"), F.sum(F.col("v").cast("long")).alias("v"))


add("feature_file", _features_file, fx.with_("elements") + "SELECT CAST(sum(element_id) AS BIGINT) ids, CAST(sum(CASE WHEN element_id % 2 = 0 THEN xmin ELSE 0 END) AS BIGINT) v FROM elements")


def _streamed(s, d):
    """Positive pixels of files that come one after another, through a memory table."""
    at = f"{shared_dir(s).rstrip('/')}/slidespark-{uuid.uuid4().hex}"
    fx.pixels(s, d).repartition(3, "slide_id", "y").write.parquet(at)
    name = f"slidespark_{uuid.uuid4().hex}"
    q = counts.running_counts(counts.read_tiles(s, at, files=1)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).select("slide_id", "n_pixels", "n_weak", "n_plain", "n_strong")


add("streamed_positive_pixels", _streamed)


def _streamed_windows(s, d):
    """Positive pixels by slide and five minutes of event time, a row of pixels being a minute."""
    at = f"{shared_dir(s).rstrip('/')}/slidespark-{uuid.uuid4().hex}"
    fx.pixels(s, d).withColumn("at", F.timestamp_seconds(F.col("y") * 60)).repartition(3, "slide_id", "y").write.parquet(at)
    name = f"slidespark_{uuid.uuid4().hex}"
    arriving = counts.read_tiles(s, at, counts.PIXELS + ", at timestamp", 1)
    q = counts.windowed_counts(arriving, "at", "1 hour").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).select("slide_id", (F.unix_timestamp("window.start") / 60).cast("int").alias("minute"), "n_pixels", "n_positive")


add("streamed_windows", _streamed_windows)
add("tissue_documents", lambda s, d: annotations_json.from_contours(tiles.boundaries(tissue.pieces(fx.pixels(s, d), least=10)).where("n > 3").select("slide_id", F.lit("tissue").alias("grp"), F.lit("tissue").alias("label"), F.lit("rgb(0,200,0)").alias("color"), "coords_x", "coords_y", F.col("label").alias("element_id")), size=20))
