"""Queries over label images."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidespark.functions import chance
from slidespark.operators import labels
from slidespark.plans.base import Plans, as_sql_rounds
from slidespark.sources import fixtures as fx

plans = Plans()
add = plans.add
SIDE = 48
_FOUR = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)"
_COND = "SELECT slide_id, y, x, CAST(dense_rank() OVER (PARTITION BY slide_id ORDER BY label) AS INT) label FROM "

add(
    "label_delete_margin",
    lambda s, d: labels.delete_margin(fx.blocks(s, d), SIDE, SIDE, {"left": 5, "top": 3, "right": 0, "bottom": 1}),
    fx.with_("blocks") + f", e AS (SELECT DISTINCT slide_id, label FROM blocks WHERE x < 2 OR y < 1) {_COND} (SELECT * FROM blocks WHERE (slide_id, label) NOT IN (SELECT slide_id, label FROM e))",
)
add(
    "ring_labels",
    lambda s, d: labels.ring(fx.blocks(s, d), SIDE, SIDE, 4),
    fx.with_("blocks") + """, o AS (SELECT * FROM blocks), g AS (SELECT a.v y, b.v x FROM (SELECT CAST(range AS INT) v FROM range(48)) a CROSS JOIN (SELECT CAST(range AS INT) v FROM range(48)) b),
c AS (SELECT o.slide_id, g.y, g.x, (o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x) d2, label FROM o JOIN g ON abs(o.y - g.y) <= 4 AND abs(o.x - g.x) <= 4)
SELECT slide_id, y, x, label FROM c WHERE d2 <= 16 AND (slide_id, y, x) NOT IN (SELECT slide_id, y, x FROM o) QUALIFY row_number() OVER (PARTITION BY slide_id, y, x ORDER BY d2, label) = 1""",
)
_REACH = """, b AS (SELECT slide_id, y, x, CAST(dense_rank() OVER (PARTITION BY slide_id ORDER BY label) AS INT) label FROM blocks), e AS (SELECT a.slide_id, a.label, a.y * 1048576 + a.x p, c.y * 1048576 + c.x q FROM b a JOIN b c ON a.slide_id = c.slide_id AND a.label = c.label AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1),
r(slide_id, label, p, root) AS (SELECT DISTINCT slide_id, label, p, p FROM e UNION SELECT e.slide_id, e.label, e.q, r.root FROM r JOIN e ON e.slide_id = r.slide_id AND e.label = r.label AND e.p = r.p WHERE r.root < e.q),
m AS (SELECT slide_id, label, p, min(root) root FROM r GROUP BY 1, 2, 3) """
_WITH = fx.with_("blocks").replace("WITH ", "WITH RECURSIVE ", 1)
add("label_components", lambda s, d: labels.connected(labels.condense(fx.blocks(s, d)), conn=8, same="label"), _WITH + _REACH + "SELECT slide_id, label, CAST(p // 1048576 AS INT) y, CAST(p % 1048576 AS INT) x, CAST(root AS BIGINT) component FROM m")
add(
    "label_split",
    lambda s, d: labels.split(fx.blocks(s, d)),
    _WITH + _REACH + """, k AS (SELECT *, row_number() OVER (PARTITION BY slide_id, label ORDER BY root) k FROM (SELECT DISTINCT slide_id, label, root FROM m)),
n AS (SELECT slide_id, label, root, row_number() OVER (PARTITION BY slide_id ORDER BY label, root) + (SELECT max(label) FROM b WHERE b.slide_id = k.slide_id) fresh FROM k WHERE k > 1)
SELECT m.slide_id, CAST(p // 1048576 AS INT) y, CAST(p % 1048576 AS INT) x, CAST(coalesce(fresh, m.label) AS INT) label FROM m LEFT JOIN n ON n.slide_id = m.slide_id AND n.label = m.label AND n.root = m.root""",
)
_DEPTH = f""", d1 AS (SELECT * FROM blocks), d2 AS (SELECT a.* FROM d1 a CROSS JOIN {_FOUR} JOIN d1 b ON b.slide_id = a.slide_id AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 4),
d3 AS (SELECT a.* FROM d2 a CROSS JOIN {_FOUR} JOIN d2 b ON b.slide_id = a.slide_id AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 4) """
add("label_width_open", lambda s, d: labels.width_open(fx.blocks(s, d), 3), fx.with_("blocks") + _DEPTH + f"{_COND} (SELECT * FROM blocks WHERE (slide_id, label) IN (SELECT slide_id, label FROM d3))")
add(
    "label_compact",
    lambda s, d: labels.compact(fx.blocks(s, d), 2),
    fx.with_("blocks") + f""", d2 AS (SELECT a.slide_id, a.y, a.x FROM blocks a CROSS JOIN {_FOUR} JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 4)
SELECT DISTINCT a.slide_id, a.y, a.x, a.label FROM blocks a WHERE (slide_id, y, x) IN (SELECT slide_id, y, x FROM d2 UNION SELECT slide_id, y + dy, x + dx FROM d2 CROSS JOIN {_FOUR})""",
)
add(
    "label_colours",
    lambda s, d: labels.colour(labels.adjacency(fx.blocks(s, d)), fx.blocks(s, d)),
    _WITH + f""", e AS (SELECT DISTINCT a.slide_id, a.label v, b.label u FROM blocks a CROSS JOIN {_FOUR} JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.label < a.label),
k AS (SELECT slide_id, label, row_number() OVER (PARTITION BY slide_id ORDER BY label) k FROM (SELECT DISTINCT slide_id, label FROM blocks)),
p AS (SELECT k.slide_id, k.label, k.k, coalesce(list(j.k) FILTER (j.k IS NOT NULL), []) before FROM k LEFT JOIN e ON e.slide_id = k.slide_id AND e.v = k.label LEFT JOIN k j ON j.slide_id = e.slide_id AND j.label = e.u GROUP BY 1, 2, 3),
r(slide_id, k, cs) AS (SELECT DISTINCT slide_id, CAST(0 AS BIGINT), CAST([] AS INT[]) FROM k UNION ALL
  SELECT r.slide_id, p.k, list_append(r.cs, CAST(list_min(list_filter(range(1, 60), lambda c: NOT list_contains(list_transform(p.before, lambda b: r.cs[b]), CAST(c AS INT)))) AS INT)) FROM r JOIN p ON p.slide_id = r.slide_id AND p.k = r.k + 1),
f AS (SELECT slide_id, cs FROM r QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY k DESC) = 1)
SELECT k.slide_id, k.label, cs[k.k] colour FROM k JOIN f USING (slide_id)""",
)
add("label_shuffle", lambda s, d: labels.shuffle(fx.blocks(s, d), 7), fx.with_("blocks") + f", i AS (SELECT DISTINCT slide_id, label FROM blocks), a AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY label) k FROM i), b AS (SELECT slide_id, label fresh, row_number() OVER (PARTITION BY slide_id ORDER BY {chance.mixed_sql('label', 'slide_id', seed=7)}, label) k FROM i) SELECT slide_id, y, x, fresh AS label FROM blocks JOIN a USING (slide_id, label) JOIN b USING (slide_id, k)")
add("embed_boundaries", lambda s, d: labels.embed(fx.pixels(s, d), labels.perimeter(fx.blocks(s, d), SIDE, SIDE), (0, 255, 0)), fx.with_("pixels", "blocks") + f", p AS (SELECT DISTINCT a.slide_id, a.y, a.x FROM blocks a CROSS JOIN {_FOUR} LEFT JOIN blocks b ON b.slide_id = a.slide_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y + dy BETWEEN 0 AND 47 AND a.x + dx BETWEEN 0 AND 47 AND b.label IS DISTINCT FROM a.label) SELECT q.slide_id, q.y, q.x, CASE WHEN p.y IS NULL THEN r ELSE 0 END r, CASE WHEN p.y IS NULL THEN g ELSE 255 END g, CASE WHEN p.y IS NULL THEN b ELSE 0 END b FROM pixels q LEFT JOIN p ON p.slide_id = q.slide_id AND p.y = q.y AND p.x = q.x")
add(
    "region_moments",
    lambda s, d: labels.moments(fx.blocks(s, d)),
    fx.with_("blocks") + """, m AS (SELECT slide_id, label, count(*) area, min(y) ymin, max(y) ymax, min(x) xmin, max(x) xmax, avg(y) cy, avg(x) cx, var_pop(x) + 1 / 12.0::DOUBLE a, var_pop(y) + 1 / 12.0::DOUBLE c, covar_pop(x, y) b FROM blocks GROUP BY 1, 2),
e AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 l1, greatest((a + c - sqrt(pow(a - c, 2) + 4 * b * b)) / 2, 0.0) l2 FROM m)
SELECT slide_id, label, area, ymin, ymax, xmin, xmax, round(cy, 5) cy, round(cx, 5) cx, round(CASE WHEN abs(c - a) < 1e-9 THEN CASE WHEN b > 1e-9 THEN -pi() / 4 ELSE pi() / 4 END ELSE atan2(2 * b, c - a) / 2 END, 5) orientation, round(4 * sqrt(l1), 5) major_axis, round(4 * sqrt(l2), 5) minor_axis, round(sqrt(greatest(1 - l2 / l1, 0.0)), 5) eccentricity, round(sqrt(4 * area / pi()), 5) equivalent_diameter,
  round(area / ((ymax - ymin + 1) * (xmax - xmin + 1)), 5) extent, round(sqrt(l2) / sqrt(l1), 5) axis_ratio FROM e""",
)
add("region_counts_capped", lambda s, d: fx.blocks(s, d).groupBy("slide_id").agg(F.countDistinct("label").alias("n")).select("slide_id", "n", F.assert_true(F.col("n") <= 17437).isNull().alias("fits")), fx.with_("blocks") + "SELECT slide_id, count(DISTINCT label) n, true fits FROM blocks GROUP BY 1")
_W3 = [(p, q) for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))]


def _hu_sql(prefix: str, weight: str, source: str) -> str:
    sums = ", ".join(f"sum({weight} * pow(x - cx, {p}) * pow(y - cy, {q})) / pow(any_value(m), {1 + (p + q) / 2}) n{p}{q}" for p, q in _W3)
    terms = ["n20 + n02", "g * g + 4 * n11 * n11", "c * c + d * d", "a * a + b * b", "c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b)", "g * (a * a - b * b) + 4 * n11 * a * b", "d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)"]
    return f""", {prefix}c AS (SELECT slide_id, label, sum({weight}) m, sum({weight} * x) / nullif(sum({weight}), 0) cx, sum({weight} * y) / nullif(sum({weight}), 0) cy FROM {source} GROUP BY 1, 2),
{prefix}n AS (SELECT slide_id, label, {sums} FROM {source} JOIN {prefix}c USING (slide_id, label) GROUP BY 1, 2),
{prefix}h AS (SELECT slide_id, label, {", ".join(f"round(coalesce({t}, 0.0), 6) {prefix}hu{k}" for k, t in enumerate(terms, 1))} FROM (SELECT *, n30 + n12 a, n21 + n03 b, n30 - 3 * n12 c, 3 * n21 - n03 d, n20 - n02 g FROM {prefix}n))"""


def _hu(s, d):
    one = labels.invariants(fx.blocks(s, d))
    two = labels.invariants(fx.blocks(s, d).join(fx.pixels(s, d), ["slide_id", "y", "x"]), "r")
    # twelve digits first: sums in another order differ in the last bits, which would decide ties at six
    named = lambda t, p: t.select("slide_id", "label", *(as_sql_rounds(F.round(f"hu{k}", 12), 6).alias(f"{p}hu{k}") for k in range(1, 8)))
    return named(one, "").join(named(two, "weighted_"), ["slide_id", "label"])


add("region_invariants", _hu, fx.with_("pixels", "blocks") + ", o AS (SELECT slide_id, label, y::DOUBLE y, x::DOUBLE x, r::DOUBLE r FROM blocks JOIN pixels USING (slide_id, y, x))" + _hu_sql("", "1.0::DOUBLE", "o") + _hu_sql("weighted_", "r", "o") + " SELECT * FROM h JOIN weighted_h USING (slide_id, label)")
