"""Queries over annotations, regions and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.operators import annotations, annotations_json, spatial, tiles
from slidespark.operators.components import components
from slidespark.plans.base import Plans
from slidespark.sources import fixtures as fx
from slidespark.sources.storage import grown

plans = Plans()
add = plans.add

# --- documents and elements
_TYPE = "CASE WHEN element_id % 10 = 0 THEN 'point' WHEN element_id % 10 <= 3 THEN 'rectangle' ELSE 'polyline' END"
_HALF = "CAST(trunc((xmax - xmin) / 2.0::DOUBLE) AS INT) w, CAST(trunc((ymax - ymin) / 2.0::DOUBLE) AS INT) h, CAST(trunc((xmin + xmax) / 2.0::DOUBLE) AS INT) cx, CAST(trunc((ymin + ymax) / 2.0::DOUBLE) AS INT) cy"
_SIGNS = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
_TURN = "(element_id % 4 * 0.5::DOUBLE)"
_XS = ", ".join(f"CAST(trunc(cos({_TURN}) * ({a} * w) - sin({_TURN}) * ({b} * h) + cx) AS INT)" for a, b in _SIGNS)
_YS = ", ".join(f"CAST(trunc(sin({_TURN}) * ({a} * w) + cos({_TURN}) * ({b} * h) + cy) AS INT)" for a, b in _SIGNS)
_JSON = fx.with_("elements") + f""", t AS (SELECT *, {_TYPE} kind, {_HALF}, row_number() OVER (PARTITION BY doc_id ORDER BY element_id) - 1 k FROM elements),
v AS (SELECT *, CASE kind WHEN 'point' THEN [cx, cx, cx, cx, cx] WHEN 'rectangle' THEN [{_XS}] ELSE [xmin, xmax, xmax, xmin, xmin] END xs, CASE kind WHEN 'point' THEN [cy, cy, cy, cy, cy] WHEN 'rectangle' THEN [{_YS}] ELSE [ymin, ymin, ymax, ymax, ymin] END ys FROM t),
e AS (SELECT 'doc-' || doc_id annotation_id, CAST(k AS INT) element_index, CAST(element_id AS VARCHAR) element_id, CASE WHEN kind = 'rectangle' AND element_id % 4 <> 0 THEN 'polyline' ELSE kind END "type",
  coalesce(CASE WHEN element_id % 7 <> 0 THEN grp END, CASE WHEN element_id % 5 <> 0 THEN 'l-' || grp END) grp, coalesce(CASE WHEN element_id % 5 <> 0 THEN 'l-' || grp END, CASE WHEN element_id % 7 <> 0 THEN grp END) "label", 'rgb(1,2,3)' color,
  list_min(xs) xmin, list_max(xs) xmax, list_min(ys) ymin, list_max(ys) ymax, (list_max(xs) - list_min(xs)) * (list_max(ys) - list_min(ys)) bbox_area, array_to_string(xs, ',') coords_x, array_to_string(ys, ',') coords_y FROM v) """
_raw = fx.annotation_json
add("annotation_elements", lambda s, d: annotations_json.elements(_raw(s, d)), _JSON + "SELECT * FROM e")
add("annotation_elements_shifted", lambda s, d: annotations_json.elements(_raw(s, d), shift=(100, 50)).select("element_id", "xmin", "ymax"), _JSON + "SELECT element_id, xmin - 100 xmin, ymax - 50 ymax FROM e")
add("annotation_boxes", lambda s, d: annotations_json.boxes(_raw(s, d)), _JSON + 'SELECT annotation_id, element_index, "type", ' + ", ".join(f"CASE WHEN \"type\" <> 'point' THEN {c} END {c}" for c in ("xmin", "ymin", "xmax", "ymax", "bbox_area")) + " FROM e")
add(
    "annotation_documents",
    lambda s, d: annotations_json.documents(_raw(s, d)).select("annotation_id", "item_id", "name", "created", "public", "groups", "n_elements"),
    fx.with_("elements") + "SELECT 'doc-' || doc_id annotation_id, CAST(any_value(slide_id) AS VARCHAR) item_id, 'name ' || doc_id AS \"name\", '2020-01-01' created, false AS \"public\", '' AS \"groups\", CAST(count(*) AS INT) n_elements FROM elements GROUP BY doc_id",
)


def _contours(s, d) -> DataFrame:
    e = fx.elements(s, d)
    return e.select("slide_id", "element_id", "grp", F.concat(F.lit("l"), F.col("grp")).alias("label"), F.lit("rgb(9,8,7)").alias("color"), F.concat_ws(",", "xmin", "xmax", "xmax", "xmin").alias("coords_x"), F.concat_ws(",", "ymin", "ymin", "ymax", "ymax").alias("coords_y"))


def _made(s, d):
    docs = annotations_json.from_contours(_contours(s, d), size=50, factor=2.0, dx=10.0, dy=20.0, opacity=0.3)
    return docs.select("slide_id", "grp", "chunk", F.size(F.from_json("json", "elements array<struct<type: string>>")["elements"]).cast("long").alias("n_elements"))


_CHUNK = fx.with_("elements") + ", c AS (SELECT slide_id, grp, element_id, xmin, xmax, ymin, ymax, CAST(least(floor((k - 1) / 50), greatest(ceil(n / 50) - 2, 0)) AS INT) chunk FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, grp ORDER BY element_id) k, count(*) OVER (PARTITION BY slide_id, grp) n FROM elements)) "
add("documents_from_contours", _made, _CHUNK + "SELECT slide_id, grp, chunk, count(*) n_elements FROM c GROUP BY ALL")
add(
    "documents_round_trip",
    lambda s, d: annotations_json.elements(annotations_json.from_contours(_contours(s, d), size=50, factor=2.0, dx=10.0, dy=20.0)).groupBy("grp", "label").agg(F.count("*").alias("n"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax"), F.sum(F.col("xmax").cast("long")).alias("x_sum")),
    fx.with_("elements") + "SELECT grp, 'l' || grp AS \"label\", count(*) n, min(xmin * 2 + 10) xmin, max(ymax * 2 + 20) ymax, CAST(sum(xmax * 2 + 10) AS BIGINT) x_sum FROM elements GROUP BY 1",
)
add("document_attributes", lambda s, d: annotations_json.with_attributes(_raw(s, d), {"cli": "nuclei", "version": "1"}).select(F.get_json_object("json", "$._id").alias("annotation_id"), F.get_json_object("json", "$.attributes.cli").alias("cli")), fx.with_("elements") + "SELECT DISTINCT 'doc-' || doc_id annotation_id, 'nuclei' cli FROM elements")

# --- access, styles, folders
_access = lambda s, d: fx.table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("annotation_id"), (F.col("o_custkey") % 20).alias("user_id")).distinct().withColumn("level", F.lit(1))
_change = lambda s, d: fx.table(s, d, "nation").select((F.col("n_nationkey") * 2).cast("long").alias("annotation_id"), F.col("n_nationkey").cast("long").alias("user_id"), F.lit(2).alias("level"))
_ACL = "WITH a AS (SELECT DISTINCT o_orderkey % 50 annotation_id, o_custkey % 20 user_id, 1 AS \"level\" FROM orders), c AS (SELECT CAST(n_nationkey * 2 AS BIGINT) annotation_id, CAST(n_nationkey AS BIGINT) user_id, 2 AS \"level\" FROM nation) "
add("merge_acl", lambda s, d: annotations_json.merge_access(_access(s, d), _change(s, d)), _ACL + "SELECT * FROM a WHERE (annotation_id, user_id) NOT IN (SELECT annotation_id, user_id FROM c) UNION ALL SELECT * FROM c")
add("replace_acl", lambda s, d: annotations_json.merge_access(_access(s, d), _change(s, d), True), _ACL + "SELECT * FROM a WHERE annotation_id NOT IN (SELECT annotation_id FROM c) UNION ALL SELECT * FROM c")
_styles = lambda s: s.createDataFrame([("1-URGENT", "first", "rgb(1,1,1)"), ("5-LOW", None, "rgb(2,2,2)")], "grp string, new_grp string, new_color string")
add("restyle_groups", lambda s, d: annotations_json.restyle(_contours(s, d).select("element_id", "grp", "color"), _styles(s)), fx.with_("elements") + "SELECT element_id, CASE grp WHEN '1-URGENT' THEN 'first' ELSE grp END grp, CASE grp WHEN '1-URGENT' THEN 'rgb(1,1,1)' WHEN '5-LOW' THEN 'rgb(2,2,2)' ELSE 'rgb(9,8,7)' END color FROM elements")
add("delete_slide_documents", lambda s, d: fx.elements(s, d).where("slide_id <> 3").groupBy("slide_id").agg(F.countDistinct("doc_id").alias("n_docs")), fx.with_("elements") + "SELECT slide_id, count(DISTINCT doc_id) n_docs FROM elements WHERE slide_id <> 3 GROUP BY 1")


def _walk(s, d):
    fx.folders(s, d).createOrReplaceTempView("slidespark_folders")
    return s.sql("""WITH RECURSIVE w(folder_id, depth, path) AS (
      SELECT folder_id, 0, name FROM slidespark_folders WHERE parent_id IS NULL
      UNION ALL SELECT f.folder_id, w.depth + 1, concat_ws('/', w.path, f.name) FROM w JOIN slidespark_folders f ON f.parent_id = w.folder_id)
    SELECT folder_id, depth, path FROM w""")


add("folder_walk", _walk, fx.with_("folders").replace("WITH ", "WITH RECURSIVE ", 1) + ", w(folder_id, depth, path) AS (SELECT folder_id, 0, name FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, w.depth + 1, w.path || '/' || f.name FROM w JOIN folders f ON f.parent_id = w.folder_id) SELECT folder_id, depth, path FROM w")
add("folder_items", lambda s, d: fx.table(s, d, "customer").where("c_nationkey = 7").join(fx.table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("item_id")), "SELECT c_custkey item_id FROM customer WHERE c_nationkey = 7 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")


def _report(s, d):
    fx.elements(s, d).createOrReplaceTempView("slidespark_elements")
    return s.sql('SELECT slide_id, grp, count(*) n, min(xmin) xmin FROM slidespark_elements GROUP BY GROUPING SETS ((slide_id, grp), (slide_id), ())')


add("annotation_report", _report, fx.with_("elements") + "SELECT slide_id, grp, count(*) n, min(xmin) xmin FROM elements GROUP BY GROUPING SETS ((slide_id, grp), (slide_id), ())")

# --- tiles and regions
_slides = lambda s, d: fx.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("slide_id"), (1000 + F.col("n_nationkey") * 37).cast("int").alias("width"), (700 + F.col("n_nationkey") * 53).cast("int").alias("height"))
add(
    "tile_grid",
    lambda s, d: spatial.tile_grid(_slides(s, d), 256, 32),
    """WITH s AS (SELECT CAST(n_nationkey AS INT) slide_id, CAST(1000 + n_nationkey * 37 AS INT) w, CAST(700 + n_nationkey * 53 AS INT) h FROM nation), r AS (SELECT CAST(range AS INT) k FROM range(0, 20)),
g AS (SELECT slide_id, w, h, a.k * 224 y, b.k * 224 x, b.k c, a.k r FROM s CROSS JOIN r a CROSS JOIN r b WHERE a.k * 224 <= h - 1 - 32 AND b.k * 224 <= w - 1 - 32)
SELECT slide_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY y, x) - 1 AS INT) "position", x, y, least(256, w - x) width, least(256, h - y) height FROM g""",
)
add("tile_lookup", lambda s, d: spatial.tile_grid(_slides(s, d), 256, 32).where("position = 7").select("slide_id", "x", "y"), "WITH s AS (SELECT CAST(n_nationkey AS INT) slide_id, CAST(1000 + n_nationkey * 37 AS INT) w FROM nation), g AS (SELECT slide_id, CAST(floor((w - 33) / 224) AS INT) + 1 n FROM s) SELECT slide_id, CAST(7 % n AS INT) * 224 x, CAST(floor(7 / n) AS INT) * 224 y FROM g")
add("thumbnail_downsample", lambda s, d: spatial.thumbnail(fx.pixels(s, d), 8), fx.with_("pixels") + "SELECT slide_id, CAST(floor(y / 8) AS INT) y, CAST(floor(x / 8) AS INT) x, round(avg(r), 6) r, round(avg(g), 6) g, round(avg(b), 6) b FROM pixels GROUP BY 1, 2, 3")
_ask = lambda s, d: fx.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("slide_id"), F.col("n_nationkey").cast("int").alias("window_id"), F.lit(500).alias("xmin"), F.lit(900).alias("ymin"), F.lit(1500).alias("xmax"), F.lit(2100).alias("ymax"))
add("window_intersects", lambda s, d: spatial.intersecting(fx.elements(s, d), _ask(s, d)), fx.with_("elements") + "SELECT slide_id window_id, element_id FROM elements WHERE xmin < 1500 AND xmax > 500 AND ymin < 2100 AND ymax > 900")
add("contour_size_filter", lambda s, d: fx.elements(s, d).where("xmax - xmin >= 30 AND ymax - ymin >= 30 AND xmax - xmin <= 80").select("element_id"), fx.with_("elements") + "SELECT element_id FROM elements WHERE xmax - xmin >= 30 AND ymax - ymin >= 30 AND xmax - xmin <= 80")
_held = lambda s, d: fx.elements(s, d).withColumn("has_holes", (F.col("element_id") % 2 == 0).cast("int"))
add("enclosed_background", lambda s, d: spatial.drop_open_background(_held(s, d), "5-LOW").select("element_id", "grp"), fx.with_("elements") + "SELECT element_id, grp FROM elements a WHERE grp <> '5-LOW' OR EXISTS (SELECT 1 FROM elements b WHERE b.slide_id = a.slide_id AND b.grp <> '5-LOW' AND b.element_id % 2 = 0 AND b.xmin <= a.xmin AND b.ymin <= a.ymin AND b.xmax >= a.xmax AND b.ymax >= a.ymax)")
_tiles = lambda s, d: fx.table(s, d, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("slide_id"), F.col("s_suppkey").alias("tile_id"), *((F.col("s_suppkey") * a % 7 * 100 + b).cast("int").alias(n) for n, a, b in (("left", 3, 0), ("top", 5, 0))), *((F.col("s_suppkey") * a % 7 * 100 + 99 + F.col("s_suppkey") % 3).cast("int").alias(n) for n, a in (("right", 3), ("bottom", 5))))
_TILES = "WITH t AS (SELECT CAST(s_suppkey % 3 AS INT) slide_id, s_suppkey tile_id, s_suppkey * 3 % 7 * 100 l, s_suppkey * 5 % 7 * 100 t, s_suppkey * 3 % 7 * 100 + 99 + s_suppkey % 3 r, s_suppkey * 5 % 7 * 100 + 99 + s_suppkey % 3 b FROM supplier) "
_EDGES = " UNION ALL ".join(f"SELECT a.slide_id, a.tile_id a, '{n}' edge_a, b.tile_id b, '{m}' edge_b FROM t a JOIN t b ON a.slide_id = b.slide_id AND a.tile_id < b.tile_id WHERE abs(a.{n[0]} - b.{m[0]}) < 2 AND greatest(a.{e}, b.{e}) - least(a.{s}, b.{s}) < a.{e} - a.{s} + b.{e} - b.{s}" for n, m, s, e in (("left", "right", "t", "b"), ("right", "left", "t", "b"), ("top", "bottom", "l", "r"), ("bottom", "top", "l", "r")))
add("shared_tile_edges", lambda s, d: spatial.shared_edges(_tiles(s, d)), _TILES + _EDGES)
_GAP = "a.slide_id = b.slide_id AND a.grp = b.grp AND a.element_id < b.element_id AND pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2) < 9"
add("merge_pairs", lambda s, d: spatial.gaps(fx.elements(s, d), 3), fx.with_("elements") + f"SELECT a.slide_id, a.element_id a, b.element_id b FROM elements a JOIN elements b ON {_GAP}")


def _clusters(s, d):
    roots = components(spatial.near_forest(fx.elements(s, d), 3))
    e = fx.elements(s, d).join(grown(roots.select(F.col("v").alias("element_id"), "root")), "element_id", "left")
    return e.select("slide_id", "grp", "element_id", F.coalesce("root", "element_id").alias("cluster"), "xmin", "ymin", "xmax", "ymax")


_CLUSTER = fx.with_("elements").replace("WITH ", "WITH RECURSIVE ", 1) + f", p AS (SELECT a.element_id a, b.element_id b FROM elements a JOIN elements b ON {_GAP}), q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), c(v, root) AS (SELECT element_id, element_id FROM elements UNION SELECT q.b, c.root FROM c JOIN q ON q.a = c.v), m AS (SELECT v, min(root) root FROM c GROUP BY 1) "
add("merge_clusters", lambda s, d: _clusters(s, d).select("element_id", "cluster"), _CLUSTER + "SELECT v element_id, root AS \"cluster\" FROM m")
add("merged_boxes", lambda s, d: _clusters(s, d).groupBy("cluster").agg(F.count("*").alias("n"), *(f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax")))), _CLUSTER + "SELECT root AS \"cluster\", count(*) n, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax FROM m JOIN elements ON v = element_id GROUP BY 1")
_unions = lambda s, d: spatial.union_runs(_clusters(s, d), "cluster")
add("merged_areas", lambda s, d: _unions(s, d).groupBy("cluster").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area")), _CLUSTER + ", w AS (SELECT root, y, xmin x0, xmax x1, max(xmax) OVER (PARTITION BY root, y ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM (SELECT root, xmin, xmax, unnest(range(ymin, ymax + 1)) y FROM m JOIN elements ON v = element_id)) SELECT root AS \"cluster\", CAST(sum(greatest(0, x1 - greatest(x0, coalesce(reach + 1, x0)) + 1)) AS BIGINT) area FROM w GROUP BY 1")
add("merged_outlines", lambda s, d: tiles.run_outlines(_unions(s, d), "cluster"))
_PAINT = fx.with_("elements", "gt_codes") + ", g AS (SELECT CAST(range AS INT) k FROM range(0, 300)), c AS (SELECT e.slide_id, y.k y, x.k x, gt_code, element_id, overlay_order, (ymax - ymin) * (xmax - xmin) a FROM elements e JOIN gt_codes USING (grp) JOIN g y ON y.k * 16 BETWEEN e.ymin AND e.ymax JOIN g x ON x.k * 16 BETWEEN e.xmin AND e.xmax) "
add("painter_mask", lambda s, d: spatial.paint(fx.elements(s, d), fx.gt_codes(s), 16), _PAINT + "SELECT slide_id, y, x, gt_code, element_id FROM c QUALIFY row_number() OVER (PARTITION BY slide_id, y, x ORDER BY overlay_order DESC, a, element_id DESC) = 1")
add("painter_areas", lambda s, d: spatial.paint(fx.elements(s, d), fx.gt_codes(s), 16).groupBy("gt_code").agg(F.count("*").alias("n")), _PAINT + "SELECT gt_code, count(*) n FROM (SELECT gt_code FROM c QUALIFY row_number() OVER (PARTITION BY slide_id, y, x ORDER BY overlay_order DESC, a, element_id DESC) = 1) GROUP BY 1")


def _triangles(e):
    """A triangle of each element as a ring."""
    return e.withColumn("points", F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax")))))


def _masks(s, d):
    runs = spatial.spans(spatial.ring_edges(_triangles(fx.elements(s, d)), "element_id"), "element_id")
    return runs.groupBy("element_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("n"))


_BOUND = "xmax + (y - ymin) * (xmin - xmax)::DOUBLE / (ymax - ymin)"
_ROWS = f", t AS (SELECT *, CAST(ceil({_BOUND}) AS INT) - 1 x1 FROM (SELECT *, unnest(range(ymin, ymax)) y FROM elements)) "
add("polygon_mask", _masks, fx.with_("elements") + _ROWS + "SELECT element_id, CAST(sum(x1 - xmin + 1) AS BIGINT) n FROM t WHERE x1 >= xmin GROUP BY 1")
add("roi_subtiles", lambda s, d: spatial.sub_tiles(fx.elements(s, d), 40), fx.with_("elements") + ", g AS (SELECT CAST(range AS INT) k FROM range(0, 10)) SELECT slide_id, element_id, xmin + b.k * 40 xmin, ymin + a.k * 40 ymin, least(xmin + b.k * 40 + 40, xmax) xmax, least(ymin + a.k * 40 + 40, ymax) ymax FROM elements JOIN g a ON ymin + a.k * 40 <= greatest(ymax - 1, ymin) JOIN g b ON xmin + b.k * 40 <= greatest(xmax - 1, xmin)")
_cards = lambda e: e.select("slide_id", F.col("element_id").alias("tile_id"), (F.col("xmax") - F.col("xmin")).alias("width"), (F.col("ymax") - F.col("ymin")).alias("height"))
add(
    "gallery_layout",
    lambda s, d: spatial.gallery(_cards(fx.elements(s, d))),
    fx.with_("elements") + """, t AS (SELECT slide_id, element_id tile_id, xmax - xmin w, ymax - ymin h, row_number() OVER (PARTITION BY slide_id ORDER BY element_id) - 1 k FROM elements),
p AS (SELECT *, CAST(k // 10 AS INT) gallery, CAST(k % 10 // 2 AS INT) r, CAST(k % 2 AS INT) c FROM t), q AS (SELECT *, CAST(1 + 25 * (c + 1) + coalesce(lag(w) OVER (PARTITION BY slide_id, gallery, r ORDER BY c), 0) AS INT) x0 FROM p),
s AS (SELECT slide_id, gallery, r, max(h) tall FROM p GROUP BY ALL), y AS (SELECT slide_id, gallery, r, CAST(1 + 25 * (r + 1) + coalesce(sum(tall) OVER (PARTITION BY slide_id, gallery ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) y0 FROM s)
SELECT slide_id, tile_id, gallery, r AS "row", c AS col, x0 xmin, y0 ymin, x0 + w xmax, y0 + h ymax FROM q JOIN y USING (slide_id, gallery, r)""",
)
add("unique_product_codes", lambda s, d: spatial.product_codes(s.range(0, 256).select(F.col("id").cast("int").alias("k")), 1, 256), "WITH n AS (SELECT CAST(range AS INT) k FROM range(1, 256)) SELECT a.k a, b.k b, a.k * b.k product FROM n a JOIN n b ON a.k < b.k QUALIFY row_number() OVER (PARTITION BY a.k * b.k ORDER BY a.k, b.k) = 1")
add("label_bytes", lambda s, d: fx.elements(s, d).select("element_id", (F.col("element_id") % 256).cast("int").alias("b0"), (F.floor(F.col("element_id") / 256) % 256).cast("int").alias("b1"), (F.floor(F.col("element_id") / 65536) % 256).cast("int").alias("b2")), fx.with_("elements") + "SELECT element_id, CAST(element_id % 256 AS INT) b0, CAST(element_id // 256 % 256 AS INT) b1, CAST(element_id // 65536 % 256 AS INT) b2 FROM elements")
_names = lambda s, d: fx.elements(s, d).select("element_id", F.format_string("/masks/s%d_id-%d_left-%d_top-%d_bottom-%d_right-%d.png", "slide_id", "element_id", "xmin", "ymin", "ymax", "xmax").alias("path"))
add("bounds_from_names", lambda s, d: _names(s, d).select("element_id", *spatial.file_bounds(F.col("path"))), fx.with_("elements") + "SELECT element_id, 's' || slide_id slide_name, CAST(element_id AS VARCHAR) id, xmin AS \"left\", ymin AS top, xmax AS \"right\", ymax AS bottom FROM elements")
add("object_rectangles", lambda s, d: fx.elements(s, d).select("element_id", *(F.bround((F.col(a) + F.col(b)) / 2 * 1.5, 2).alias(n) for n, a, b in (("cx", "xmin", "xmax"), ("cy", "ymin", "ymax"))), *(F.bround((F.col(b) - F.col(a) + 1) * 1.5, 2).alias(n) for n, a, b in (("width", "xmin", "xmax"), ("height", "ymin", "ymax")))), fx.with_("elements") + "SELECT element_id, (xmin + xmax) * 0.75::DOUBLE cx, (ymin + ymax) * 0.75::DOUBLE cy, (xmax - xmin + 1) * 1.5::DOUBLE width, (ymax - ymin + 1) * 1.5::DOUBLE height FROM elements")


def _areas(s, d):
    """Shoelace area and perimeter of rings given vertex by vertex."""
    e = fx.elements(s, d)
    v = e.select("element_id", F.posexplode(F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))))).alias("k", "p"))
    w = Window.partitionBy("element_id").orderBy("k")
    nx, ny = F.coalesce(F.lead("p.x").over(w), F.first("p.x").over(w)), F.coalesce(F.lead("p.y").over(w), F.first("p.y").over(w))
    t = v.select("element_id", (F.col("p.x") * ny - nx * F.col("p.y")).alias("cross"), F.sqrt((nx - F.col("p.x")) * (nx - F.col("p.x")) + (ny - F.col("p.y")) * (ny - F.col("p.y"))).alias("side"))
    return t.groupBy("element_id").agg((F.abs(F.sum("cross")) / 2).alias("area"), F.round(F.sum("side"), 6).alias("perimeter"))


add("polygon_areas", _areas, fx.with_("elements") + "SELECT element_id, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) area, CAST(2 * (xmax - xmin + ymax - ymin) AS DOUBLE) perimeter FROM elements")


def _colinear(s, d):
    """Rings with a repeated vertex and one in the middle of a side, merged."""
    e = fx.elements(s, d)
    points = [("xmin", "ymin"), ("xmin", "ymin"), ("__m", "ymin"), ("xmax", "ymin"), ("xmax", "ymax")]
    v = e.withColumn("__m", F.floor((F.col("xmin") + F.col("xmax")) / 2).cast("int")).select("element_id", F.posexplode(F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in points))).alias("k", "p"))
    return annotations.merge_colinear(v.select("element_id", "k", "p.x", "p.y"), "element_id").groupBy("element_id").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"))


add("merge_colinear", _colinear, fx.with_("elements") + "SELECT element_id, CAST(3 AS BIGINT) n, CAST(xmin + xmax + xmax AS BIGINT) x_sum FROM elements")
_box = lambda: [f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
add("bounding_box_mode", lambda s, d: fx.elements(s, d).groupBy("slide_id").agg(*_box()), fx.with_("elements") + "SELECT slide_id, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax FROM elements GROUP BY 1")
