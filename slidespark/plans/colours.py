"""Queries over colours and stains."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from slidespark.functions import chance, colour
from slidespark.operators import stains
from slidespark.plans.base import Plans
from slidespark.sources import fixtures as fx

plans = Plans()
add = plans.add
_xy = ["slide_id", "y", "x"]
_W = colour.stain_matrix()
_r = lambda c, n, k=4: F.round(c, k).alias(n)
_rgb = lambda: [F.col(c) for c in "rgb"]
_LN = math.log(255.0)
_SDA = lambda c: f"greatest(-ln(greatest({c}::DOUBLE, 1e-10) / 255.0) * 255 / {_LN!r}, 0.0)"
_SDAN = lambda c: f"(-ln(greatest({c}::DOUBLE, 1e-10) / 255.0) * 255 / {_LN!r})"
_BACK = lambda x: f"pow(255.0, 1 - {x} / 255)"
_UNMIX = [_BACK(x) for x in colour.sql_linear(np.linalg.inv(_W), [_SDA(c) for c in "rgb"])]
_STAINED = fx.with_("pixels") + f", s AS (SELECT slide_id, y, x, {_UNMIX[0]} h, {_UNMIX[1]} e, {_UNMIX[2]} q FROM pixels) "
_stained = lambda s, d: fx.pixels(s, d).select(*_xy, *(c.alias(n) for c, n in zip(colour.unmix(*_rgb(), _W), "heq", strict=True)))
_heq = lambda: [F.col(c) for c in "heq"]

add("reconvolve_he", lambda s, d: _stained(s, d).select(*_xy, *(_r(c, n) for c, n in zip(colour.remix(_heq(), _W), "rgb", strict=True))), _STAINED + "SELECT slide_id, y, x, " + ", ".join(f"round({_BACK(x)}, 4) {n}" for x, n in zip(colour.sql_linear(_W, [_SDAN(c) for c in "heq"]), "rgb", strict=True)) + " FROM s")
_AL, _BE = [1.1, 0.9, 1.05], [2.0, -3.0, 0.5]
add("perturb_stains", lambda s, d: _stained(s, d).select(*_xy, *(_r(c, n) for c, n in zip(colour.perturbed(_heq(), _W, _AL, _BE), "rgb", strict=True))), _STAINED + "SELECT slide_id, y, x, " + ", ".join(f"round({_BACK(x)}, 4) {n}" for x, n in zip(colour.sql_linear(_W, [f"({a!r}::DOUBLE * {_SDAN(c)} + {b!r}::DOUBLE)" for c, a, b in zip("heq", _AL, _BE, strict=True)]), "rgb", strict=True)) + " FROM s")
_T = colour.stain_matrix((0.55, 0.75, 0.36), (0.10, 0.95, 0.30))
add("deconvolution_normalize", lambda s, d: _stained(s, d).select(*_xy, *(colour.to_byte(F.round(c, 6)).alias(n) for c, n in zip(colour.remix(_heq(), _T), "rgb", strict=True))), _STAINED + "SELECT slide_id, y, x, " + ", ".join(f"CAST(trunc(least(greatest(round({_BACK(x)}, 6), 0), 255)) AS INT) {n}" for x, n in zip(colour.sql_linear(_T, [_SDAN(c) for c in "heq"]), "rgb", strict=True)) + " FROM s")
add("stain_bytes", lambda s, d: _stained(s, d).select(*_xy, *(colour.to_byte(F.round(c, 6)).alias(n) for c, n in zip(_heq(), ("hematoxylin", "eosin", "residual"), strict=True))), _STAINED + "SELECT slide_id, y, x, " + ", ".join(f"CAST(trunc(least(greatest(round({c}, 6), 0), 255)) AS INT) {n}" for c, n in zip("heq", ("hematoxylin", "eosin", "residual"), strict=True)) + " FROM s")
add("foreground_nuclear", lambda s, d: _stained(s, d).where(F.round("h", 6) < 60).groupBy("slide_id").agg(F.count("*").alias("n")), _STAINED + "SELECT slide_id, count(*) n FROM s WHERE round(h, 6) < 60 GROUP BY 1")


def _matrix(spark, w):
    return spark.createDataFrame([(i, *(round(float(x), 6) for x in w[:, i])) for i in range(3)], "stain int, r double, g double, b double")


_od = lambda s, d: fx.pixels(s, d).select(*(colour.sda(F.col(c)).alias(c) for c in "rgb"))
add("macenko_matrix", lambda s, d: _matrix(s, stains.macenko(_od(s, d))))
add("sparse_stain_matrix", lambda s, d: _matrix(s, stains.sparse_factors(_od(s, d), colour.stain_matrix())))
add("stain_map", lambda s, d: s.createDataFrame([(n, *map(float, v)) for n, v in colour.STAINS.items()], "stain string, r double, g double, b double"), "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {float(v[0])!r}::DOUBLE, {float(v[1])!r}::DOUBLE, {float(v[2])!r}::DOUBLE)" for n, v in colour.STAINS.items()) + ") t(stain, r, g, b)")
add(
    "stain_index",
    lambda s, d: plans.queries["stain_map"](s, d).where("stain <> 'null'").groupBy().agg(*(F.max_by("stain", F.abs(F.lit(v[0]) * F.col("r") + F.lit(v[1]) * F.col("g") + F.lit(v[2]) * F.col("b")) / F.sqrt(F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b"))).alias(n) for n, v in (("like_nuclei", (0.6, 0.7, 0.3)), ("like_plasma", (0.1, 0.9, 0.1)), ("like_dab", (0.3, 0.5, 0.8))))),
    "WITH m AS (" + plans.sql["stain_map"] + ") SELECT " + ", ".join(f"(SELECT stain FROM m WHERE stain <> 'null' ORDER BY abs({v[0]} * r + {v[1]} * g + {v[2]} * b) / sqrt(r * r + g * g + b * b) DESC LIMIT 1) {n}" for n, v in (("like_nuclei", (0.6, 0.7, 0.3)), ("like_plasma", (0.1, 0.9, 0.1)), ("like_dab", (0.3, 0.5, 0.8)))),
)
_h0 = 0.125
_HUES = f"SELECT n_nationkey k, {_h0} + n_nationkey * {(5**0.5 - 1) / 2!r}::DOUBLE - floor({_h0} + n_nationkey * {(5**0.5 - 1) / 2!r}::DOUBLE) h FROM nation"


def _distinct(s, d):
    h = F.lit(_h0) + F.col("n_nationkey") * F.lit((5**0.5 - 1) / 2)
    t = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), (h - F.floor(h)).alias("h"))
    return t.select(F.col("k").cast("int").alias("k"), *(_r(c, n, 6) for c, n in zip(colour.hue_to_rgb(F.col("h")), "rgb", strict=True)))


add("distinct_colours", _distinct, f"WITH t AS ({_HUES}) SELECT CAST(k AS INT) k, " + ", ".join(f"round(CASE CAST(floor(h * 6) AS INT) {cases} END, 6) {n}" for n, cases in (("r", "WHEN 0 THEN 1.0 WHEN 1 THEN 2 - h * 6 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN h * 6 - 4 ELSE 1.0"), ("g", "WHEN 0 THEN h * 6 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 4 - h * 6 WHEN 4 THEN 0.0 ELSE 0.0"), ("b", "WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN h * 6 - 2 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 6 - h * 6"))) + " FROM t")
add("fill_colour", lambda s, d: fx.gt_codes(s).select("grp", F.concat(F.regexp_replace(F.regexp_replace("color", r"^rgb\(", "rgba("), r"\)$", ""), F.lit(",0.3)")).alias("fill")), fx.with_("gt_codes") + "SELECT grp, replace(replace(color, 'rgb(', 'rgba('), ')', ',0.3)') fill FROM gt_codes")
add("drop_nonfinite", lambda s, d: stains.finite(fx.pixels(s, d).select(*_xy, *((F.ln(F.nullif(F.col(c), F.lit(0)))).alias(c) for c in "rgb"))).groupBy("slide_id").agg(F.count("*").alias("n")), fx.with_("pixels") + "SELECT slide_id, count(*) n FROM pixels WHERE r > 0 AND g > 0 AND b > 0 GROUP BY 1")
add("gray_bands", lambda s, d: fx.pixels(s, d).select(*_xy, _r(colour.gray(*_rgb()), "v", 3)).select(*_xy, F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b")), fx.with_("pixels") + "SELECT slide_id, y, x, round(v, 3) r, round(v, 3) g, round(v, 3) b FROM (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b v FROM pixels)")


def _tissue(s, d):
    g = fx.pixels(s, d).select(*_xy, colour.gray(*_rgb()).alias("v"))
    low, high = stains.tissue_threshold(g)
    return g.where((F.col("v") >= low) & (F.col("v") < high)).groupBy("slide_id").agg(F.count("*").alias("n"))


add("simple_mask", _tissue)
_STEPS = [sum(math.exp(-0.4) * 0.4**k / math.factorial(k) for k in range(n + 1)) for n in range(64)]
_STEPS = _STEPS[: next(i for i, b in enumerate(_STEPS) if b >= 1 - 1e-9) + 1]
_DRAWN = " + ".join(f"CAST(u >= {b!r} AS INT)" for b in _STEPS)
add(
    "resampled_foreground",
    lambda s, d: stains.resampled(fx.pixels(s, d), F.col("r") + F.col("g") + F.col("b") < 384, 0.4, 16, 0.25, 5).select("slide_id", "y", "x", "times"),
    fx.with_("pixels") + f""", t AS (SELECT *, r + g + b < 384 fore, floor(y / 16) ty, floor(x / 16) tx FROM pixels),
f AS (SELECT slide_id, ty, tx FROM t GROUP BY 1, 2, 3 HAVING avg(CASE WHEN fore THEN 1.0::DOUBLE ELSE 0 END) >= 0.25),
n AS (SELECT slide_id, y, x, {_DRAWN} times FROM (SELECT slide_id, y, x, ty, tx, {chance.mixed_sql("slide_id", "y", "x", seed=5)} / {chance.PRIME}.0::DOUBLE u FROM t WHERE fore) JOIN f USING (slide_id, ty, tx))
SELECT slide_id, y, x, times FROM n WHERE times > 0""",
)
add("sampled_pixels", lambda s, d: stains.sampled(fx.pixels(s, d), 0.25, 3), fx.with_("pixels") + f"SELECT * FROM pixels WHERE {chance.mixed_sql('slide_id', 'y', 'x', seed=3)} < {int(0.25 * chance.PRIME)}")
add("channel_rank", lambda s, d: stains.angle_percentile(fx.pixels(s, d).select("slide_id", F.col("r").alias("v")), "slide_id", "v", 0.99), fx.with_("pixels") + "SELECT slide_id, v FROM (SELECT slide_id, r v, row_number() OVER (PARTITION BY slide_id ORDER BY r) - 1 k, count(*) OVER (PARTITION BY slide_id) n FROM pixels) WHERE k = least(floor(0.99::DOUBLE * n + 0.5), n - 1)")
_CASC = "CASE WHEN r + g + b > 600 THEN 'white' WHEN b > r + 20 THEN 'blue' WHEN r > g + 60 THEN 'red' ELSE 'rest' END"
add("threshold_components", lambda s, d: fx.pixels(s, d).select("slide_id", F.expr(_CASC).alias("part")).groupBy("slide_id", "part").agg(F.count("*").alias("n")), fx.with_("pixels") + f"SELECT slide_id, {_CASC} part, count(*) n FROM pixels GROUP BY 1, 2")
