"""All image and annotation queries with their SQL for DuckDB."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from slidespark.functions import colour
from slidespark.operators import annotations, graph, labels, pixelstats, stains
from slidespark.plans import annotation, colours, labelling, neighbourhood, regions, segments
from slidespark.sources import fixtures as fx
from slidespark.sources.storage import materialize

QUERIES: dict = {}
SQL: dict = {}


def _add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _r(c, name, n=6):
    return F.round(c, n).alias(name)


_xy = ["slide_id", "y", "x"]
_HSI = f"""hsi AS (SELECT *, t - floor(t) h, CASE WHEN i > 0 THEN 1 - least(r, g, b) / greatest(i, 1e-10) ELSE 0.0 END s FROM (
  SELECT slide_id, y, x, r, g, b, atan2({3**0.5!r} * (g - b), 2 * r - g - b) / {2 * math.pi!r} t, (r + g + b) / 3 i
  FROM (SELECT slide_id, y, x, r / 255.0::DOUBLE r, g / 255.0::DOUBLE g, b / 255.0::DOUBLE b FROM pixels)))"""
_P = pixelstats.PositiveParams()
_KIND = f""", kinds AS (SELECT *, CASE WHEN NOT (abs((h - {_P.hue}::DOUBLE + 0.5) - floor(h - {_P.hue}::DOUBLE + 0.5) - 0.5) <= {_P.width / 2!r} AND s >= {_P.saturation} AND i < {_P.upper} AND i >= {_P.lower}) THEN 0
  WHEN i >= {_P.weak} THEN 1 WHEN i < {_P.strong} THEN 3 ELSE 2 END kind FROM hsi)"""
_LAB = colour.sql_linear(colour.LAB, [f"ln(CASE WHEN {x} = 0 THEN {colour.TINY!r} ELSE {x} END)" for x in colour.sql_linear(colour.LMS, ["r", "g", "b"])])
_BACK = lambda v: colour.sql_linear(colour.LMS_INV, [f"exp({x})" for x in colour.sql_linear(colour.LAB_INV, v)])
_SDA = lambda c: f"greatest(-ln(greatest({c}::DOUBLE, 1e-10) / 255.0) * 255 / {math.log(255.0)!r}, 0.0)"
_W = colour.stain_matrix()
_STAIN = [f"pow(255.0, 1 - {x} / 255)" for x in colour.sql_linear(np.linalg.inv(_W), [_SDA(c) for c in "rgb"])]
rgb = lambda: (F.col("r"), F.col("g"), F.col("b"))

_add(
    "positive_pixel_count",
    lambda s, d: pixelstats.positive_counts(fx.pixels(s, d)),
    fx.with_("pixels") + ", " + _HSI + _KIND + """, t AS (SELECT slide_id, count(*) n_pixels, count(*) FILTER (kind = 1) n_weak, count(*) FILTER (kind = 2) n_plain, count(*) FILTER (kind = 3) n_strong,
  coalesce(sum(i) FILTER (kind = 1), 0) iw, coalesce(sum(i) FILTER (kind = 2), 0) ip, coalesce(sum(i) FILTER (kind = 3), 0) ist FROM kinds GROUP BY 1)
SELECT slide_id, n_pixels, n_weak, n_plain, n_strong, round(coalesce((iw + ip + ist) / nullif(n_weak + n_plain + n_strong, 0), 0.0), 6) intensity_average,
  round(coalesce(n_strong / nullif(n_weak + n_plain + n_strong, 0), 0.0), 6) ratio_strong_to_total, round(coalesce((iw + ip) / nullif(n_weak + n_plain, 0), 0.0), 6) intensity_average_weak_and_plain,
  round((n_weak + n_plain + n_strong) / n_pixels, 6) ratio_total_to_pixels FROM t""",
)
_add("ppc_label_hist", lambda s, d: pixelstats.positive_labels(fx.pixels(s, d)).groupBy("slide_id", "kind").agg(F.count("*").alias("n")), fx.with_("pixels") + ", " + _HSI + _KIND + "SELECT slide_id, kind, count(*) n FROM kinds GROUP BY 1, 2")


def _hsi(s, d):
    h, sat, i = colour.hsi(*rgb())
    return fx.pixels(s, d).select(*_xy, _r(h, "h"), _r(sat, "s"), _r(i, "i"))


_add("hsi_convert", _hsi, fx.with_("pixels") + ", " + _HSI + "SELECT slide_id, y, x, round(h, 6) h, round(s, 6) s, round(i, 6) i FROM hsi")
_add("lab_convert", lambda s, d: fx.pixels(s, d).select(*_xy, *(_r(c, n) for c, n in zip(colour.lab(*rgb()), ("l", "alpha", "beta"), strict=True))), fx.with_("pixels") + f"SELECT slide_id, y, x, round({_LAB[0]}, 6) l, round({_LAB[1]}, 6) alpha, round({_LAB[2]}, 6) beta FROM pixels")
_add("lab_roundtrip", lambda s, d: fx.pixels(s, d).where("r + g + b > 0").select(*_xy, *(F.round(c).cast("int").alias(n) for c, n in zip(colour.lab_to_rgb(*colour.lab(*rgb())), "rgb", strict=True))), fx.with_("pixels") + "SELECT slide_id, y, x, r, g, b FROM pixels WHERE r + g + b > 0")
_add("sda_convert", lambda s, d: fx.pixels(s, d).select(*_xy, *(_r(colour.sda(F.col(c)), f"{c}_sda") for c in "rgb")), fx.with_("pixels") + "SELECT slide_id, y, x, " + ", ".join(f"round({_SDA(c)}, 6) {c}_sda" for c in "rgb") + " FROM pixels")
_add("od_roundtrip", lambda s, d: fx.pixels(s, d).select(*_xy, *(F.round(colour.sda_to_rgb(colour.sda(F.col(c), None), None)).cast("int").alias(c) for c in "rgb")), fx.with_("pixels") + "SELECT slide_id, y, x, r, g, b FROM pixels")
_add("deconvolve_he", lambda s, d: fx.pixels(s, d).select(*_xy, *(_r(c, n, 4) for c, n in zip(colour.unmix(*rgb(), _W), ("hematoxylin", "eosin", "residual"), strict=True))), fx.with_("pixels") + f"SELECT slide_id, y, x, round({_STAIN[0]}, 4) hematoxylin, round({_STAIN[1]}, 4) eosin, round({_STAIN[2]}, 4) residual FROM pixels")


def _lab_px(s, d):
    return fx.pixels(s, d).select(*_xy, *rgb(), *(c.alias(n) for c, n in zip(colour.lab(*rgb()), ("l", "alpha", "beta"), strict=True)))


_LABCTE = fx.with_("pixels") + f", lab AS (SELECT slide_id, y, x, r, g, b, {_LAB[0]} l, {_LAB[1]} alpha, {_LAB[2]} beta FROM pixels) "
_add("lab_stats", lambda s, d: _lab_px(s, d).groupBy("slide_id").agg(*(_r(f(c), f"{c}_{n}", 5) for c in ("l", "alpha", "beta") for n, f in (("mu", F.avg), ("sigma", F.stddev_pop)))), _LABCTE + "SELECT slide_id, " + ", ".join(f"round(avg({c}), 5) {c}_mu, round(stddev_pop({c}), 5) {c}_sigma" for c in ("l", "alpha", "beta")) + " FROM lab GROUP BY 1")


def _sampled_stats(s, d):
    """Means and deviations in LAB of drawn foreground pixels, each as often as it was drawn."""
    px = stains.resampled(fx.pixels(s, d), F.col("r") + F.col("g") + F.col("b") < 384, 0.4, 16, 0.25, 5)
    lab = px.select("slide_id", "times", *(c.alias(n) for c, n in zip(colour.lab(*rgb()), ("l", "alpha", "beta"), strict=True)))
    return stains.weighted_stats(lab, ("l", "alpha", "beta"), "times")


_STATS = ", ".join(f"round(sum(times * {c}) / sum(times), 5) {c}_mu, round(sqrt(greatest(sum(times * {c} * {c}) / sum(times) - pow(sum(times * {c}) / sum(times), 2), 0.0)), 5) {c}_sigma" for c in ("l", "alpha", "beta"))
_add("sampled_lab_stats", _sampled_stats, f"WITH drawn AS ({colours.plans.sql['resampled_foreground']}), pixels AS ({fx.SQL['pixels']}) SELECT slide_id, {_STATS} FROM (SELECT slide_id, times, {_LAB[0]} l, {_LAB[1]} alpha, {_LAB[2]} beta FROM pixels JOIN drawn USING (slide_id, y, x)) GROUP BY 1")
_MU, _SIGMA = (8.63234435, -0.11501964, 0.03868433), (0.57506023, 0.10403329, 0.01364062)


def _reinhard(s, d):
    px = materialize(_lab_px(s, d))  # read twice
    names = ("l", "alpha", "beta")
    stats = px.groupBy("slide_id").agg(*(f(c).alias(f"{c}_{n}") for c in names for n, f in (("mu", F.avg), ("sd", F.stddev_pop))))
    moved = [(F.col(c) - F.col(f"{c}_mu")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)) * sd + mu for c, mu, sd in zip(names, _MU, _SIGMA, strict=True)]
    return px.join(stats, "slide_id").select(*_xy, *(_r(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)), n, 3) for c, n in zip(colour.lab_to_rgb(*moved), "rgb", strict=True)))


_m = [f"(({c} - {c}_mu) / nullif({c}_sd, 0.0) * {sd!r}::DOUBLE + {mu!r}::DOUBLE)" for c, mu, sd in zip(("l", "alpha", "beta"), _MU, _SIGMA, strict=True)]
_add("reinhard_normalize", _reinhard, _LABCTE + ", st AS (SELECT slide_id, " + ", ".join(f"avg({c}) {c}_mu, stddev_pop({c}) {c}_sd" for c in ("l", "alpha", "beta")) + " FROM lab GROUP BY 1) SELECT slide_id, y, x, " + ", ".join(f"round(least(greatest({c}, 0.0), 255.0), 3) {n}" for c, n in zip(_BACK(_m), "rgb", strict=True)) + " FROM lab JOIN st USING (slide_id)")
_add("background_median", lambda s, d: fx.pixels(s, d).groupBy("slide_id").agg(*(F.median(c).alias(f"{c}_median") for c in "rgb")), fx.with_("pixels") + "SELECT slide_id, " + ", ".join(f"quantile_cont({c}, 0.5)::DOUBLE {c}_median" for c in "rgb") + " FROM pixels GROUP BY 1")
_add("threshold_multichannel", lambda s, d: fx.pixels(s, d).where("r >= 50 AND r < 200 AND g >= 20 AND g < 220 AND b < 230"), fx.with_("pixels") + "SELECT * FROM pixels WHERE r >= 50 AND r < 200 AND g >= 20 AND g < 220 AND b < 230")
_add("invert_image", lambda s, d: fx.pixels(s, d).select(*_xy, *((255 - F.col(c)).alias(c) for c in "rgb")), fx.with_("pixels") + "SELECT slide_id, y, x, 255 - r r, 255 - g g, 255 - b b FROM pixels")


def _moments(s, d):
    od = fx.pixels(s, d).select("slide_id", *(colour.sda(F.col(c)).alias(c) for c in "rgb"))
    return od.groupBy("slide_id").agg(*(_r(F.sum(F.col(a) * F.col(b)) / F.count("*"), a + b, 3) for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")))


_add("macenko_moments", _moments, fx.with_("pixels") + ", od AS (SELECT slide_id, " + ", ".join(f"{_SDA(c)} {c}" for c in "rgb") + " FROM pixels) SELECT slide_id, " + ", ".join(f"round(sum({a} * {b}) / count(*), 3) {a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM od GROUP BY 1")
_add(
    "intensity_features",
    lambda s, d: pixelstats.intensity_features(fx.patches(s, d), "vec_id"),
    fx.with_("patches") + """, m AS (SELECT vec_id, median(i) med, min(i) lo, max(i) hi, avg(i) mu, count(*) n FROM patches GROUP BY 1),
t AS (SELECT p.*, m.*EXCLUDE(vec_id), coalesce(least(floor((i - lo) / nullif(hi - lo, 0) * 10), 9), 5) bin FROM patches p JOIN m USING (vec_id)),
h AS (SELECT vec_id, sum(q * q) energy, sum(-q * ln(q)) entropy FROM (SELECT vec_id, bin, count(*) / any_value(n) q FROM t GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, any_value(lo) "min", any_value(hi) "max", any_value(mu) mean, any_value(med) median, stddev_pop(i) std, quantile_cont(i, 0.75) - quantile_cont(i, 0.25) iqr, median(abs(i - med)) mad,
  avg(pow(i - mu, 3)) / nullif(pow(var_pop(i), 1.5), 0) skewness, kurtosis_pop(i) kurtosis FROM t GROUP BY 1)
SELECT vec_id, "min", "max", round(mean, 6) mean, round(median::DOUBLE, 6) median, round(mean - median, 6) mean_median_diff, round(std, 6) std, round(iqr::DOUBLE, 6) iqr, round(mad::DOUBLE, 6) mad, round(skewness, 6) skewness, round(kurtosis, 6) kurtosis, round(energy, 6) energy, round(entropy, 6) entropy FROM s JOIN h USING (vec_id)""",
)
_GLCM = """, q AS (SELECT *, CAST(round(i / 255 * 7) AS INT) q FROM patches), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) t("offset", dy, dx)),
c AS (SELECT a.label, "offset", a.q i, b.q j, count(*) n FROM q a CROSS JOIN o JOIN q b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4) """
_add("glcm_counts", lambda s, d: pixelstats.glcm(fx.patches(s, d), "label", key="vec_id"), fx.with_("patches") + _GLCM + 'SELECT label, "offset", i, j, n FROM c')
_add(
    "haralick_features",
    lambda s, d: pixelstats.texture(pixelstats.glcm(fx.patches(s, d), "label", key="vec_id"), "label"),
    fx.with_("patches") + _GLCM + """, b AS (SELECT label, "offset", i, j, sum(n) n FROM (SELECT * FROM c UNION ALL SELECT label, "offset", j, i, n FROM c) GROUP BY 1, 2, 3, 4),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY label, "offset") p FROM b),
m AS (SELECT label, "offset", sum(p * p) asm_, sum((i - j) * (i - j) * p) contrast, sum(p / (1 + (i - j) * (i - j))) idm, sum(-p * log2(p + 1e-5)) entropy, sum(i * p) mu, sum(i * i * p) ii, sum(i * j * p) ij FROM p GROUP BY 1, 2),
f AS (SELECT *, ii - mu * mu variance, coalesce((ij - mu * mu) / CASE WHEN ii - mu * mu > 1e-12 THEN ii - mu * mu END, 0.0) correlation FROM m)
SELECT label, round(avg(asm_), 6) asm_mean, round(avg(contrast), 6) contrast_mean, round(avg(correlation), 6) correlation_mean, round(avg(variance), 6) variance_mean, round(avg(idm), 6) idm_mean, round(avg(entropy), 6) entropy_mean, round(max(asm_) - min(asm_), 6) asm_range, round(max(contrast) - min(contrast), 6) contrast_range FROM f GROUP BY 1""",
)
_add(
    "otsu_threshold",
    lambda s, d: pixelstats.otsu(fx.patches(s, d), "label"),
    fx.with_("patches") + """, h AS (SELECT label, i v, count(*) n FROM patches GROUP BY 1, 2), t AS (SELECT label, v, sum(n) OVER u w0, sum(n * v) OVER u s0, sum(n) OVER a w, sum(n * v) OVER a s FROM h WINDOW u AS (PARTITION BY label ORDER BY v), a AS (PARTITION BY label)),
r AS (SELECT label, v, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 4) score FROM t WHERE w0 < w)
SELECT label, v threshold FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, v) = 1""",
)
_add(
    "tile_foreground_fraction",
    lambda s, d: fx.pixels(s, d).groupBy("slide_id", F.floor(F.col("y") / 16).cast("int").alias("ty"), F.floor(F.col("x") / 16).cast("int").alias("tx")).agg(_r(F.avg((F.col("r") + F.col("g") + F.col("b") < 384).cast("double")), "fraction")).where("fraction >= 0.25"),
    fx.with_("pixels") + "SELECT slide_id, CAST(floor(y / 16) AS INT) ty, CAST(floor(x / 16) AS INT) tx, round(avg(CASE WHEN r + g + b < 384 THEN 1.0::DOUBLE ELSE 0 END), 6) fraction FROM pixels GROUP BY 1, 2, 3 HAVING round(avg(CASE WHEN r + g + b < 384 THEN 1.0::DOUBLE ELSE 0 END), 6) >= 0.25",
)
_COND = "SELECT slide_id, y, x, CAST(dense_rank() OVER (PARTITION BY slide_id ORDER BY label) AS INT) label FROM "
_add("label_condense", lambda s, d: labels.condense(fx.blocks(s, d).withColumn("label", F.col("label") * F.col("label"))), fx.with_("blocks") + _COND + "(SELECT slide_id, y, x, label * label AS label FROM blocks)")
_add("label_delete", lambda s, d: labels.delete(fx.blocks(s, d), s.createDataFrame([(2,), (5,), (30,)], "label int")), fx.with_("blocks") + "SELECT * FROM blocks WHERE label NOT IN (2, 5, 30)")
_add("label_delete_border", lambda s, d: labels.delete_border(fx.blocks(s, d), 48, 48), fx.with_("blocks") + ", e AS (SELECT DISTINCT slide_id, label FROM blocks WHERE y IN (0, 47) OR x IN (0, 47)) " + _COND + "(SELECT * FROM blocks WHERE (slide_id, label) NOT IN (SELECT slide_id, label FROM e))")
_add("label_area_open", lambda s, d: labels.area_open(fx.blocks(s, d), 43), fx.with_("blocks") + _COND + "(SELECT *, count(*) OVER (PARTITION BY slide_id, label) n FROM blocks) WHERE n >= 43")
_N4 = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)"
_add("label_perimeter", lambda s, d: labels.perimeter(fx.blocks(s, d), 48, 48), fx.with_("blocks") + f"SELECT DISTINCT a.* FROM blocks a CROSS JOIN {_N4} LEFT JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y + dy BETWEEN 0 AND 47 AND a.x + dx BETWEEN 0 AND 47 AND b.label IS DISTINCT FROM a.label")
_add("rag_edges", lambda s, d: labels.adjacency(fx.blocks(s, d)), fx.with_("blocks") + f"SELECT DISTINCT a.slide_id, least(a.label, b.label) a, greatest(a.label, b.label) b FROM blocks a CROSS JOIN {_N4} JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> b.label")
_add("largest_regions_topn", lambda s, d: labels.largest(fx.blocks(s, d), 3), fx.with_("blocks") + "SELECT *, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY area DESC, label) AS INT) place FROM (SELECT slide_id, label, count(*) area, min(y) ymin, max(y) ymax, min(x) xmin, max(x) xmax FROM blocks GROUP BY 1, 2) QUALIFY place <= 3")
_add("radius_count_stats", lambda s, d: graph.radius_counts(fx.points(s, d), 50), fx.with_("points") + "SELECT label, count(*) n_points, round(avg(n), 6) mean, round(stddev_pop(n), 6) std, max(n) most FROM (SELECT a.label, a.vec_id, count(b.vec_id) n FROM points a LEFT JOIN points b ON a.label = b.label AND a.vec_id <> b.vec_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 2500 GROUP BY 1, 2) GROUP BY 1")
_add("element_bboxes", lambda s, d: fx.elements(s, d).groupBy("doc_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("n")), fx.with_("elements") + "SELECT doc_id, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax, count(*) n FROM elements GROUP BY 1")
_w, _h = "floor((xmax - xmin) / 2)", "floor((ymax - ymin) / 2)"
_c, _d = "floor((xmin + xmax) / 2)", "floor((ymin + ymax) / 2)"
_a = "((element_id % 4) * 0.5::DOUBLE)"
_px = ", ".join(f"trunc({_c} + cos({_a}) * ({i} * {_w}) - sin({_a}) * ({j} * {_h}))" for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)))
_py = ", ".join(f"trunc({_d} + sin({_a}) * ({i} * {_w}) + cos({_a}) * ({j} * {_h}))" for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1)))
_add("rotated_bboxes", lambda s, d: annotations.rotated_boxes(fx.elements(s, d)), fx.with_("elements") + f"SELECT element_id, CAST(least({_px}) AS INT) xmin, CAST(greatest({_px}) AS INT) xmax, CAST(least({_py}) AS INT) ymin, CAST(greatest({_py}) AS INT) ymax FROM elements")
_add("scale_elements", lambda s, d: fx.elements(s, d).select("element_id", *((F.col(c) * 0.25).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))), fx.with_("elements") + "SELECT element_id, " + ", ".join(f"CAST(trunc({c} * 0.25::DOUBLE) AS INT) {c}" for c in ("xmin", "ymin", "xmax", "ymax")) + " FROM elements")
_add("coords_to_string", lambda s, d: fx.elements(s, d).select("element_id", F.concat_ws(",", "xmin", "xmax", "xmax", "xmin").alias("coords_x"), F.concat_ws(",", "ymin", "ymin", "ymax", "ymax").alias("coords_y")), fx.with_("elements") + "SELECT element_id, concat_ws(',', xmin, xmax, xmax, xmin) coords_x, concat_ws(',', ymin, ymin, ymax, ymax) coords_y FROM elements")
_add("elements_per_group", lambda s, d: fx.elements(s, d).groupBy("slide_id", "grp").agg(F.count("*").alias("n")), fx.with_("elements") + "SELECT slide_id, grp, count(*) n FROM elements GROUP BY 1, 2")
_add("docs_summary", lambda s, d: fx.elements(s, d).groupBy("slide_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_elements"), F.countDistinct("grp").alias("n_groups")), fx.with_("elements") + "SELECT slide_id, count(DISTINCT doc_id) n_docs, count(*) n_elements, count(DISTINCT grp) n_groups FROM elements GROUP BY 1")
_add("folder_paths", lambda s, d: annotations.folder_paths(fx.folders(s, d)), fx.with_("folders") + "SELECT f.folder_id, CASE WHEN p.name IS NULL THEN f.name ELSE p.name || '/' || f.name END AS path FROM folders f LEFT JOIN folders p ON f.parent_id = p.folder_id")
_add("gtcode_lookup", lambda s, d: fx.elements(s, d).join(F.broadcast(fx.gt_codes(s)), "grp").select("element_id", "grp", "gt_code", "overlay_order", "color"), fx.with_("elements", "gt_codes") + "SELECT element_id, grp, gt_code, overlay_order, color FROM elements JOIN gt_codes USING (grp)")
_add("roi_semi_join", lambda s, d: fx.elements(s, d).join(F.broadcast(fx.gt_codes(s).where("is_roi = 1")), "grp", "left_semi"), fx.with_("elements", "gt_codes") + "SELECT * FROM elements WHERE grp IN (SELECT grp FROM gt_codes WHERE is_roi = 1)")
_HIT = "a.slide_id = b.slide_id AND a.element_id < b.element_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"
_add("bbox_iou_pairs", lambda s, d: annotations.overlaps(fx.elements(s, d)), fx.with_("elements") + f"SELECT slide_id, element_id_a, element_id_b, round(c / (p + q - c), 6) iou FROM (SELECT a.slide_id, a.element_id element_id_a, b.element_id element_id_b, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) + 1) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) + 1) c, (a.xmax - a.xmin + 1) * (a.ymax - a.ymin + 1) p, (b.xmax - b.xmin + 1) * (b.ymax - b.ymin + 1) q FROM elements a JOIN elements b ON {_HIT})")
_add("remove_overlaps", lambda s, d: annotations.remove_overlaps(fx.elements(s, d)), fx.with_("elements") + f"SELECT * FROM elements WHERE element_id NOT IN (SELECT b.element_id FROM elements a JOIN elements b ON {_HIT})")
_add("doc_chunks", lambda s, d: annotations.chunks(fx.elements(s, d), 100), fx.with_("elements") + "SELECT slide_id, element_id, CAST(least(floor((k - 1) / 100), greatest(ceil(n / 100) - 2, 0)) AS INT) chunk FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY element_id) k, count(*) OVER (PARTITION BY slide_id) n FROM elements)")
_add("latest_nonempty_version", lambda s, d: annotations.latest(fx.versions(s, d)), fx.with_("versions") + 'SELECT annotation_id, max("version") AS "version" FROM versions WHERE n_groups > 0 GROUP BY 1')


AREAS = (colours, neighbourhood, labelling, annotation, regions, segments)


def queries() -> dict:
    return {**QUERIES, **{k: q for a in AREAS for k, q in a.plans.queries.items()}}


def oracle_sql() -> dict:
    streamed = f"SELECT slide_id, n_pixels, n_weak, n_plain, n_strong FROM ({SQL['positive_pixel_count']})"
    windows = fx.with_("pixels") + ", " + _HSI + _KIND + "SELECT slide_id, CAST(y // 5 * 5 AS INT) AS \"minute\", count(*) n_pixels, count(*) FILTER (kind > 0) n_positive FROM kinds GROUP BY 1, 2"
    return {**SQL, **{k: q for a in AREAS for k, q in a.plans.sql.items()}, "streamed_positive_pixels": streamed, "streamed_windows": windows}
