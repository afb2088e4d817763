"""Queries over neighbourhoods: gradients, curvature, texture, and graphs of points and labels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from slidespark.operators import graph, labels, pixelstats, stencil, texture
from slidespark.plans.base import Plans
from slidespark.sources import fixtures as fx

plans = Plans()
add = plans.add
KEY = ("vec_id",)


def _r(name: str, n: int = 6):
    return F.round(F.col(name), n).alias(name)


_GRAD = fx.with_("patches") + """, g AS (SELECT vec_id, y, x,
  coalesce((lead(i) OVER v - lag(i) OVER v) / 2.0::DOUBLE, lead(i) OVER v - i, i - lag(i) OVER v, 0.0::DOUBLE) gy,
  coalesce((lead(i) OVER h - lag(i) OVER h) / 2.0::DOUBLE, lead(i) OVER h - i, i - lag(i) OVER h, 0.0::DOUBLE) gx
  FROM patches WINDOW v AS (PARTITION BY vec_id, x ORDER BY y), h AS (PARTITION BY vec_id, y ORDER BY x)) """
add("pixel_gradient", lambda s, d: stencil.gradient(fx.patches(s, d), KEY).select("vec_id", "y", "x", "gy", "gx"), _GRAD + "SELECT vec_id, y, x, gy, gx FROM g")


def _gradient_features(s, d):
    px = stencil.gradient(fx.patches(s, d), KEY).select("vec_id", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"))
    out = pixelstats.intensity_features(px, "vec_id", "mag")
    return out.select("vec_id", "mean", "std", "skewness", "kurtosis", "entropy", "energy")


add(
    "gradient_features",
    _gradient_features,
    _GRAD + """, p AS (SELECT vec_id, sqrt(gx * gx + gy * gy) m FROM g),
a AS (SELECT vec_id, min(m) lo, max(m) hi, avg(m) mu, count(*) n, stddev_pop(m) sd, avg(m * m) m2, kurtosis_pop(m) kurt FROM p GROUP BY 1),
t AS (SELECT p.vec_id, m, a.* EXCLUDE (vec_id), coalesce(least(floor((m - lo) / nullif(hi - lo, 0) * 10), 9), 5) bin FROM p JOIN a USING (vec_id)),
e AS (SELECT vec_id, sum(q * q) energy, sum(-q * ln(q)) entropy FROM (SELECT vec_id, bin, count(*) / any_value(n) q FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(any_value(mu), 6) mean, round(any_value(sd), 6) std, round(avg(pow(m - mu, 3)) / nullif(pow(any_value(sd), 3), 0), 6) skewness, round(any_value(kurt), 6) kurtosis,
  round(any_value(entropy), 6) entropy, round(any_value(energy), 6) energy FROM t JOIN e USING (vec_id) GROUP BY 1""",
)

_AXIS = """SELECT *, CASE WHEN pos = 0 THEN CASE WHEN n > 3 THEN 2 * s1 - s2 WHEN n = 3 THEN s1 ELSE 0 END WHEN pos = n - 1 THEN CASE WHEN n > 3 THEN 2 * b1 - b2 WHEN n = 3 THEN b1 ELSE 0 END ELSE s END d
  FROM (SELECT *, lead(s, 1) OVER w s1, lead(s, 2) OVER w s2, lag(s, 1) OVER w b1, lag(s, 2) OVER w b2 FROM (SELECT *, (lead(i) OVER w - 2 * i + lag(i) OVER w) / 2.0::DOUBLE s, row_number() OVER w - 1 pos, count(*) OVER (PARTITION BY vec_id, {o}) n FROM patches WINDOW w AS (PARTITION BY vec_id, {o} ORDER BY {a})) WINDOW w AS (PARTITION BY vec_id, {o} ORDER BY {a}))"""
add(
    "laplacian",
    lambda s, d: stencil.laplacian(fx.patches(s, d), KEY).select("vec_id", "y", "x", _r("lap")),
    fx.with_("patches") + f", v AS ({_AXIS.format(o='x', a='y')}), h AS ({_AXIS.format(o='y', a='x')}) SELECT v.vec_id, v.y, v.x, round((v.d + h.d) / 2, 6) lap FROM v JOIN h ON v.vec_id = h.vec_id AND v.y = h.y AND v.x = h.x",
)


def _kernel_sql(taps: dict[str, list[tuple[int, int, float]]]) -> str:
    """Convolution of all images with full two-dimensional kernels, by a join on shifted coordinates."""
    rows = ", ".join(f"('{n}', {dy}, {dx}, {w!r}::DOUBLE)" for n, ts in taps.items() for dy, dx, w in ts)
    sums = ", ".join(f"coalesce(sum(w * b.i) FILTER (name = '{n}'), 0.0) {n}" for n in taps)
    return f", k(name, dy, dx, w) AS (VALUES {rows}), c AS (SELECT a.vec_id, a.y, a.x, {sums} FROM patches a CROSS JOIN k JOIN patches b ON b.vec_id = a.vec_id AND b.y = a.y - k.dy AND b.x = a.x - k.dx GROUP BY 1, 2, 3) "


def _derivative_taps(sigma: float) -> dict[str, list[tuple[int, int, float]]]:
    h = math.ceil(6 * sigma) // 2
    g = lambda t: math.exp(-(t**2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    grid = [(y, x) for y in range(-h, h + 1) for x in range(-h, h + 1)]
    return {"dx": [(y, x, g(y) * 2 * x / sigma**2 * g(x)) for y, x in grid], "dy": [(y, x, 2 * y / sigma**2 * g(y) * g(x)) for y, x in grid]}


def _hessian_taps(sigma: float) -> dict[str, list[tuple[int, int, float]]]:
    h = round(3 * sigma)
    e = lambda y, x: math.exp(-(y * y + x * x) / (2 * sigma**2))
    grid = [(y, x) for y in range(-h, h + 1) for x in range(-h, h + 1)]
    two, mixed = 2 * math.pi * sigma**4, 2 * math.pi * sigma**6
    return {"dyy": [(y, x, ((y / sigma) ** 2 - 1) * e(y, x) / two) for y, x in grid], "dxy": [(y, x, y * x * e(y, x) / mixed) for y, x in grid], "dxx": [(y, x, ((x / sigma) ** 2 - 1) * e(y, x) / two) for y, x in grid]}


add("gaussian_gradient", lambda s, d: stencil.gaussian_gradient(fx.patches(s, d), KEY, 1.0).select("vec_id", "y", "x", _r("dx", 5), _r("dy", 5)), fx.with_("patches") + _kernel_sql(_derivative_taps(1.0)) + "SELECT vec_id, y, x, round(dx, 5) dx, round(dy, 5) dy FROM c")
add("hessian", lambda s, d: stencil.hessian(fx.patches(s, d), KEY, 1.0).select("vec_id", "y", "x", _r("dyy", 5), _r("dxy", 5), _r("dxx", 5)), fx.with_("patches") + _kernel_sql(_hessian_taps(1.0)) + "SELECT vec_id, y, x, round(dyy, 5) dyy, round(dxy, 5) dxy, round(dxx, 5) dxx FROM c")
_EIGEN = """, r AS (SELECT *, sqrt(pow(dyy - dxx, 2) + 4 * dxy * dxy) q FROM c), e AS (SELECT *, CASE WHEN abs((dyy + dxx + q) / 2) > abs((dyy + dxx - q) / 2) THEN (dyy + dxx - q) / 2 ELSE (dyy + dxx + q) / 2 END e1,
  CASE WHEN abs((dyy + dxx + q) / 2) > abs((dyy + dxx - q) / 2) THEN (dyy + dxx + q) / 2 ELSE (dyy + dxx - q) / 2 END e2 FROM r) """
add("hessian_eigen", lambda s, d: stencil.hessian_eigen(fx.patches(s, d), KEY, 1.0).select("vec_id", "y", "x", _r("e1", 4), _r("e2", 4)), fx.with_("patches") + _kernel_sql(_hessian_taps(1.0)) + _EIGEN + "SELECT vec_id, y, x, round(e1, 4) e1, round(e2, 4) e2 FROM e")
add("vesselness", lambda s, d: stencil.vesselness(fx.patches(s, d), KEY, 1.0).select("vec_id", "y", "x", _r("frobenius", 4), F.round(F.when(F.abs("e2") > 0.01, F.col("deviation")), 4).alias("deviation")), fx.with_("patches") + _kernel_sql(_hessian_taps(1.0)) + _EIGEN + f"SELECT vec_id, y, x, round(sqrt(e1 * e1 + e2 * e2), 4) frobenius, round(CASE WHEN abs(e2) > 0.01 THEN e1 / (e2 + {2.0**-52!r}) END, 4) deviation FROM e")

_GLCM = """, q AS (SELECT *, CAST(round(i / 255 * 7) AS INT) q FROM patches), o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) t("offset", dy, dx)),
c AS (SELECT a.label, "offset", a.q i, b.q j, count(*) n FROM q a CROSS JOIN o JOIN q b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4),
b AS (SELECT label, "offset", i, j, sum(n) n FROM (SELECT * FROM c UNION ALL SELECT label, "offset", j, i, n FROM c) GROUP BY 1, 2, 3, 4),
p AS (SELECT label, "offset", i, j, n / sum(n) OVER (PARTITION BY label, "offset") p FROM b) """
_counts = lambda s, d: pixelstats.glcm(fx.patches(s, d), "label", key="vec_id")
add("glcm_normed_symmetric", lambda s, d: texture.normed(_counts(s, d), "label").select("label", "offset", "i", "j", _r("p", 9)), fx.with_("patches") + _GLCM + 'SELECT label, "offset", i, j, round(p, 9) p FROM p')
add(
    "glcm_marginals",
    lambda s, d: texture.marginals(texture.normed(_counts(s, d), "label"), "label").select("label", "offset", "kind", "k", _r("p", 9)),
    fx.with_("patches") + _GLCM + """SELECT label, "offset", kind, k, round(sum(p), 9) p FROM (SELECT label, "offset", 'row' kind, i k, p FROM p UNION ALL SELECT label, "offset", 'sum', i + j, p FROM p UNION ALL SELECT label, "offset", 'difference', abs(i - j), p FROM p) GROUP BY 1, 2, 3, 4""",
)
_rows = ", ".join(f"round(avg({n}), 5) {n}_mean, round(max({n}) - min({n}), 5) {n}_range" for n in texture.NAMES)
add(
    "haralick_thirteen",
    lambda s, d: texture.haralick(_counts(s, d), "label"),
    fx.with_("patches") + _GLCM + f""", px AS (SELECT label, "offset", i k, sum(p) p FROM p GROUP BY 1, 2, 3), ps AS (SELECT label, "offset", i + j k, sum(p) p FROM p GROUP BY 1, 2, 3), pd AS (SELECT label, "offset", abs(i - j) k, sum(p) p FROM p GROUP BY 1, 2, 3),
x AS (SELECT label, "offset", sum(k * p) mu, sum(k * k * p) ii, -sum(p * log2(p + 1e-5)) hx FROM px GROUP BY 1, 2),
s AS (SELECT label, "offset", sum(k * p) sum_average, sum(k * k * p) ss, -sum(p * log2(p + 1e-5)) sum_entropy FROM ps GROUP BY 1, 2),
d AS (SELECT label, "offset", sum(k * k * p) contrast, sum(p * p) / 8 - 1.0::DOUBLE / 64 difference_variance, -sum(p * log2(p + 1e-5)) difference_entropy FROM pd GROUP BY 1, 2),
h AS (SELECT a.label, a."offset", -sum(a.p * b.p * log2(a.p * b.p + 1e-5)) hxy2 FROM px a JOIN px b ON a.label = b.label AND a."offset" = b."offset" GROUP BY 1, 2),
m AS (SELECT p.label, p."offset", sum(p.p * p.p) asm, sum(p.p / (1 + (p.i - p.j) * (p.i - p.j))) idm, -sum(p.p * log2(p.p + 1e-5)) entropy, sum(p.i * p.j * p.p) ij, -sum(p.p * log2(a.p * b.p + 1e-5)) hxy1 FROM p JOIN px a ON a.label = p.label AND a."offset" = p."offset" AND a.k = p.i JOIN px b ON b.label = p.label AND b."offset" = p."offset" AND b.k = p.j GROUP BY 1, 2),
f AS (SELECT *, ii - mu * mu sum_of_squares, coalesce((ij - mu * mu) / CASE WHEN ii - mu * mu > 1e-12 THEN ii - mu * mu END, 0.0) correlation, ss - sum_average * sum_average sum_variance, coalesce((entropy - hxy1) / CASE WHEN abs(hx) > 1e-12 THEN hx END, 0.0) imc1, CASE WHEN sqrt(greatest(0.0, 1 - exp(-2 * (hxy2 - entropy)))) > 1e-3 THEN sqrt(greatest(0.0, 1 - exp(-2 * (hxy2 - entropy)))) ELSE 0.0 END imc2
  FROM x JOIN s USING (label, "offset") JOIN d USING (label, "offset") JOIN h USING (label, "offset") JOIN m USING (label, "offset"))
SELECT label, {_rows} FROM f GROUP BY 1""",
)
add(
    "poisson_threshold",
    lambda s, d: pixelstats.poisson_threshold(fx.patches(s, d), "label"),
    fx.with_("patches") + f""", h AS (SELECT label, i, count(*) / sum(count(*)) OVER (PARTITION BY label) h FROM patches GROUP BY 1, 2),
c AS (SELECT label, i, sum(h) OVER w p, sum(i * h) OVER w m, sum(i * h) OVER (PARTITION BY label) mu FROM h WINDOW w AS (PARTITION BY label ORDER BY i)),
e AS (SELECT *, greatest(p, {2.0**-52!r}) p0, CASE WHEN 1 - p <= 1e-12 THEN {2.0**-52!r} ELSE 1 - p END p1 FROM c),
g AS (SELECT label, i, mu, p0, p1, m / p0 + {2.0**-52!r} m0, greatest(mu - m, 0.0) / p1 + {2.0**-52!r} m1 FROM e),
k AS (SELECT *, round(mu - p0 * (ln(p0) + m0 * ln(m0)) - p1 * (ln(p1) + CASE WHEN p1 < 1e-12 THEN 0 ELSE m1 * ln(m1) END), 9) cost FROM g)
SELECT label, i threshold, round(m0, 6) low_mean, round(CASE WHEN p1 < 1e-12 THEN 0.0 ELSE m1 END, 6) high_mean FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY cost, i) = 1""",
)
_HOP = fx.with_("blocks") + """, n AS (SELECT DISTINCT a.slide_id, a.label a, b.label b FROM blocks a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx) JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> b.label) """
add("rag_two_hop", lambda s, d: graph.two_hop(labels.adjacency(fx.blocks(s, d))), _HOP + "SELECT slide_id, a, b FROM n WHERE a <= b UNION SELECT p.slide_id, p.a, q.b FROM n p JOIN n q ON p.slide_id = q.slide_id AND p.b = q.a WHERE p.a <= q.b")
_KNN = fx.with_("points") + ", k AS (SELECT a.label, a.vec_id, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) d2, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), b.vec_id) place, b.vec_id other FROM points a JOIN points b ON a.label = b.label AND a.vec_id <> b.vec_id) "
add("knn_pairs", lambda s, d: graph.nearest(fx.points(s, d), 3).withColumn("d2", F.col("d2").cast("long")), _KNN + "SELECT label, vec_id, CAST(place AS INT) place, other, CAST(d2 AS BIGINT) d2 FROM k WHERE place <= 3")


def _trim_sql(source: str, by: str, rounds: int = 8) -> str:
    """``source`` has (by, v): each round is one more pair of tables."""
    parts = [f"t0 AS ({source})"]
    for k in range(rounds):
        parts.append(f"b{k} AS (SELECT {by}, avg(v) m, stddev_pop(v) s FROM t{k} GROUP BY ALL)")
        parts.append(f"t{k + 1} AS (SELECT t{k}.* FROM t{k} JOIN b{k} USING ({by}) WHERE abs(v - m) <= 3 * s * (1 + 1e-12) + 1e-12)")
    return ", " + ", ".join(parts) + f" SELECT {by}, count(*) n, round(avg(v), 5) mean, round(stddev_pop(v), 5) std, round(coalesce(min(v)::DOUBLE / nullif(max(v), 0), 0.0), 5) min_max_ratio, round(coalesce(stddev_pop(v) / nullif(avg(v) + stddev_pop(v), 0), 0.0), 5) disorder FROM t{rounds} GROUP BY ALL"


_stat = lambda t, by: graph.trimmed_stats(t, by).select(*by, "n", *(_r(c, 5) for c in ("mean", "std", "min_max_ratio", "disorder")))
add("knn_distance_stats", lambda s, d: _stat(graph.nearest(fx.points(s, d), 7).where(F.col("place").isin(3, 5, 7)).select("label", "place", F.sqrt("d2").alias("v")), ["label", "place"]), _KNN + _trim_sql("SELECT label, CAST(place AS INT) place, sqrt(d2) v FROM k WHERE place IN (3, 5, 7)", "label, place"))
add("trimmed_pop_stats", lambda s, d: _stat(fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").cast("double").alias("v")), ["grp"]), "WITH z AS (SELECT 1)" + _trim_sql("SELECT o_orderpriority grp, CAST(o_totalprice AS DOUBLE) v FROM orders", "grp"))
_DENSE = fx.with_("points") + """, u AS (SELECT label, cx, cy, min(vec_id) vec_id FROM points GROUP BY 1, 2, 3),
d AS (SELECT a.label, a.vec_id, b.vec_id other, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) d2 FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT range i, (range + 1) * 10 reach FROM range(5)), k AS (SELECT label, d2, row_number() OVER (PARTITION BY label, vec_id ORDER BY d2, other) place FROM d),
c AS (SELECT u.label, 'neighbors_in_distance_' || i AS name, CAST(count(d.other) AS DOUBLE) v FROM u CROSS JOIN r LEFT JOIN d ON d.label = u.label AND d.vec_id = u.vec_id AND d2 <= reach * reach GROUP BY u.label, u.vec_id, i
  UNION ALL SELECT label, 'distance_for_neighbors_' || (place - 3) // 2, sqrt(d2) FROM k WHERE place IN (3, 5, 7)) """
add("cell_density", lambda s, d: _stat(graph.density_values(fx.points(s, d)), ["label", "name"]), _DENSE + _trim_sql("SELECT label, name, v FROM c", "label, name"))
