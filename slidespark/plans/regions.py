"""Queries over regions of interest: masks by run mode, codes of objects, mask algebra, and readers of small files."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from slidespark.operators import annotations, spatial, stains, tiles
from slidespark.plans.base import Plans
from slidespark.sources import fixtures as fx
from slidespark.sources import tables
from slidespark.sources.storage import shared_dir

plans = Plans()
add = plans.add
STEP = 16
_place = lambda s: f"{shared_dir(s).rstrip('/')}/slidespark-{uuid.uuid4().hex}"


def _rois(s, d):
    """The first element of every slide's region group."""
    e = fx.elements(s, d).join(fx.gt_codes(s).where("is_roi = 1").select("grp"), "grp", "left_semi")
    return e.groupBy("slide_id").agg(F.min_by(F.struct("element_id", "xmin", "ymin", "xmax", "ymax"), "element_id").alias("r")).select("slide_id", *(F.col(f"r.{c}").alias(f"roi_{c}") for c in ("element_id", "xmin", "ymin", "xmax", "ymax")))


_ROI = fx.with_("elements", "gt_codes") + ", roi AS (SELECT slide_id, element_id roi_id, xmin x0, ymin y0, xmax x1, ymax y1 FROM elements WHERE grp IN (SELECT grp FROM gt_codes WHERE is_roi = 1) QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY element_id) = 1) "
_HIT = "e.xmin <= x1 + 1 AND x0 <= e.xmax + 1 AND e.ymin <= y1 + 1 AND y0 <= e.ymax + 1 AND element_id <> roi_id"


def _inside(s, d):
    """Elements whose boxes, one pixel wider, meet the region's; the region itself is left out."""
    e = fx.elements(s, d).join(_rois(s, d), "slide_id")
    hit = (F.col("xmin") <= F.col("roi_xmax") + 1) & (F.col("roi_xmin") <= F.col("xmax") + 1) & (F.col("ymin") <= F.col("roi_ymax") + 1) & (F.col("roi_ymin") <= F.col("ymax") + 1)
    return e.where(hit & (F.col("element_id") != F.col("roi_element_id")))


add("roi_elements", lambda s, d: _inside(s, d).groupBy("slide_id", "doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("element_id")).alias("ids")).select("slide_id", "doc_id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")), _ROI + f"SELECT e.slide_id, doc_id, count(*) n, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY element_id) ids FROM elements e JOIN roi USING (slide_id) WHERE {_HIT} GROUP BY 1, 2")


def _roi_mask(s, d):
    """Codes at every pixel of each region: the region's own group draws the background code first, others over it."""
    roi = _rois(s, d)
    grid = lambda a, b, n: F.explode(F.sequence(F.col(a), F.col(b))).alias(n)
    base = roi.select("slide_id", grid("roi_ymin", "roi_ymax", "y"), "roi_xmin", "roi_xmax").select("slide_id", "y", grid("roi_xmin", "roi_xmax", "x"))
    e = _inside(s, d).where("grp <> '1-URGENT'")
    cut = e.select("slide_id", "grp", "element_id", F.greatest("xmin", "roi_xmin").alias("xmin"), F.least("xmax", "roi_xmax").alias("xmax"), F.greatest("ymin", "roi_ymin").alias("ymin"), F.least("ymax", "roi_ymax").alias("ymax")).where("xmin <= xmax and ymin <= ymax")
    top = spatial.paint(cut, fx.gt_codes(s), 1)
    return base.join(top, ["slide_id", "y", "x"], "left").groupBy("slide_id", F.coalesce("gt_code", F.lit(2)).alias("code")).agg(F.count("*").alias("n"))


add(
    "roi_mask_codes",
    _roi_mask,
    _ROI + f""", g AS (SELECT CAST(range AS INT) k FROM range(0, 6000)), b AS (SELECT slide_id, y.k y, x.k x FROM roi JOIN g y ON y.k BETWEEN y0 AND y1 JOIN g x ON x.k BETWEEN x0 AND x1),
c AS (SELECT e.slide_id, grp, element_id, greatest(xmin, x0) xa, least(xmax, x1) xb, greatest(ymin, y0) ya, least(ymax, y1) yb FROM elements e JOIN roi USING (slide_id) WHERE {_HIT} AND grp <> '1-URGENT'),
t AS (SELECT b.slide_id, b.y, b.x, gt_code FROM b JOIN c ON b.slide_id = c.slide_id AND b.y BETWEEN ya AND yb AND b.x BETWEEN xa AND xb JOIN gt_codes USING (grp) QUALIFY row_number() OVER (PARTITION BY b.slide_id, b.y, b.x ORDER BY overlay_order DESC, (yb - ya) * (xb - xa), element_id DESC) = 1)
SELECT slide_id, coalesce(gt_code, 2) code, count(*) n FROM b LEFT JOIN t USING (slide_id, y, x) GROUP BY 1, 2""",
)


def _ring_mask(s, d):
    """Codes at every pixel of each region under rings: triangles filled row by row, cut to the region, drawn over one another."""
    roi = _rois(s, d)
    e = _inside(s, d).where("grp <> '1-URGENT'").join(fx.gt_codes(s), "grp")
    ring = F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmin", "ymax"))))
    e = e.select("slide_id", "element_id", "gt_code", "overlay_order", ((F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))).alias("a"), ring.alias("points"))
    runs = spatial.spans(spatial.ring_edges(e, "element_id"), "element_id").join(e.drop("points"), "element_id").join(roi.select("slide_id", "roi_xmin", "roi_xmax", "roi_ymin", "roi_ymax"), "slide_id")
    runs = runs.where("y between roi_ymin and roi_ymax").withColumns({"x0": F.greatest("x0", "roi_xmin"), "x1": F.least("x1", "roi_xmax")}).where("x0 <= x1")
    px = runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).groupBy("slide_id", "y", "x").agg(F.max_by("gt_code", F.struct("overlay_order", (-F.col("a")).alias("a"), "element_id")).alias("code"))
    drawn = px.groupBy("slide_id", "code").agg(F.count("*").alias("n"))
    sizes = roi.groupBy("slide_id").agg(F.first((F.col("roi_xmax") - F.col("roi_xmin") + 1) * (F.col("roi_ymax") - F.col("roi_ymin") + 1)).cast("long").alias("whole"))
    rest = sizes.join(drawn.groupBy("slide_id").agg(F.sum("n").alias("n")), "slide_id", "left").select("slide_id", F.lit(2).alias("code"), (F.col("whole") - F.coalesce("n", F.lit(0))).alias("n"))
    return drawn.union(rest).groupBy("slide_id", "code").agg(F.sum("n").alias("n")).where("n > 0")


_BOUND = "xmax + (y - ymin) * (xmin - xmax)::DOUBLE / (ymax - ymin)"
add(
    "roi_ring_codes",
    _ring_mask,
    _ROI + f""", t AS (SELECT e.slide_id, element_id, gt_code, overlay_order, (ymax - ymin) * (xmax - xmin) a, y, greatest(xmin, x0) xa, least(CAST(ceil({_BOUND}) AS INT) - 1, x1) xb FROM (SELECT *, unnest(range(ymin, ymax)) y FROM elements) e JOIN roi USING (slide_id) JOIN gt_codes USING (grp) WHERE {_HIT} AND grp <> '1-URGENT' AND y BETWEEN y0 AND y1),
p AS (SELECT slide_id, y, unnest(range(xa, xb + 1)) x, gt_code, overlay_order, a, element_id FROM t WHERE xa <= xb),
q AS (SELECT slide_id, y, x, gt_code FROM p QUALIFY row_number() OVER (PARTITION BY slide_id, y, x ORDER BY overlay_order DESC, a, element_id DESC) = 1),
n AS (SELECT slide_id, gt_code code, count(*) n FROM q GROUP BY 1, 2), w AS (SELECT slide_id, any_value((x1 - x0 + 1) * (y1 - y0 + 1)) whole FROM roi GROUP BY 1)
SELECT slide_id, code, CAST(sum(n) AS BIGINT) n FROM (SELECT * FROM n UNION ALL SELECT slide_id, 2, whole - coalesce((SELECT sum(n) FROM n WHERE n.slide_id = w.slide_id), 0) FROM w) GROUP BY 1, 2 HAVING sum(n) > 0""",
)


def _codes(s, d):
    """Two codes with a product of their own for the elements of a slide in drawing order, as in the SQL as long as there are codes."""
    e = fx.elements(s, d).join(fx.gt_codes(s), "grp")
    area = (F.col("ymax") - F.col("ymin")) * (F.col("xmax") - F.col("xmin"))
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("slide_id").orderBy("overlay_order", F.desc(area), "element_id")))
    pairs = spatial.product_codes(s.range(0, 256).select(F.col("id").cast("int").alias("k")), 1, 256)
    return spatial.object_codes(e, pairs, rest="without").select("slide_id", "element_id", "gt_code", "a", "b")


add(
    "object_mask_codes",
    _codes,
    fx.with_("elements", "gt_codes") + """, n AS (SELECT CAST(range AS INT) k FROM range(1, 256)), p AS (SELECT a.k a, b.k b FROM n a JOIN n b ON a.k < b.k QUALIFY row_number() OVER (PARTITION BY a.k * b.k ORDER BY a.k, b.k) = 1), q AS (SELECT a, b, row_number() OVER (ORDER BY a, b) k FROM p),
e AS (SELECT slide_id, element_id, gt_code, row_number() OVER (PARTITION BY slide_id ORDER BY overlay_order, (ymax - ymin) * (xmax - xmin) DESC, element_id) k FROM elements JOIN gt_codes USING (grp)) SELECT slide_id, element_id, gt_code, a, b FROM e JOIN q USING (k)""",
)
_frames = lambda s, d: fx.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("slide_id"), (3000 + F.col("n_nationkey") * 37).cast("int").alias("width"), (2500 + F.col("n_nationkey") * 53).cast("int").alias("height"))
_FRAMES = fx.with_("elements", "gt_codes") + ", f AS (SELECT CAST(n_nationkey AS INT) slide_id, CAST(3000 + n_nationkey * 37 AS INT) width, CAST(2500 + n_nationkey * 53 AS INT) height FROM nation), "
_BOX = "min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax FROM elements"
for mode, source in (("wsi", "SELECT slide_id, 0 xmin, 0 ymin, width xmax, height ymax FROM f"), ("manual", "SELECT slide_id, 100 xmin, 2400 ymin, 3100 xmax, 2700 ymax FROM f"), ("min_bounding_box", f"SELECT slide_id, {_BOX} GROUP BY 1"), ("polygonal", f"SELECT slide_id, {_BOX} WHERE grp IN (SELECT grp FROM gt_codes WHERE is_roi = 1) GROUP BY 1")):
    add(
        f"bounds_{mode}",
        lambda s, d, mode=mode: spatial.mode_bounds(_frames(s, d), fx.elements(s, d).join(fx.gt_codes(s), "grp"), mode, [100, 2400, 3100, 2700]),
        _FRAMES + f"b AS ({source}), c AS (SELECT slide_id, CAST(least(greatest(xmin, 0), width) AS INT) xmin, CAST(least(greatest(ymin, 0), height) AS INT) ymin, CAST(least(greatest(xmax, 0), width) AS INT) xmax, CAST(least(greatest(ymax, 0), height) AS INT) ymax FROM b JOIN f USING (slide_id)) SELECT * FROM c WHERE xmin < xmax AND ymin < ymax",
    )
add("mask_codes", lambda s, d: spatial.mask_codes(fx.gt_codes(s)), fx.with_("gt_codes") + "SELECT grp, overlay_order, gt_code, is_roi, is_background_class FROM gt_codes UNION ALL SELECT 'super_roi', (SELECT min(overlay_order) - 1 FROM gt_codes), 255, 1, 0")
add("pyramid", lambda s, d: spatial.pyramid(fx.pixels(s, d), 4).select("slide_id", "level", "y", "x", *(F.round(c, 6).alias(c) for c in "rgb")), fx.with_("pixels") + "SELECT slide_id, CAST(l.range AS INT) AS \"level\", CAST(floor(y / pow(2, l.range)) AS INT) y, CAST(floor(x / pow(2, l.range)) AS INT) x, round(avg(r), 6) r, round(avg(g), 6) g, round(avg(b), 6) b FROM pixels CROSS JOIN range(0, 4) l GROUP BY 1, 2, 3, 4")


def _mask_files(s, d):
    """Masks of regions as files, named by their bounds, written, read and counted."""
    px = fx.blocks(s, d).withColumns({"top": F.floor(F.col("y") / 24) * 24, "left": F.floor(F.col("x") / 24) * 24})
    at = _place(s)
    tables.write_masks(px.select("slide_id", F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"), "y", "x", F.col("label").alias("code")), at, 24)
    back = tables.read_masks(s, at)
    return back.groupBy("slide_name", "left", "top", "right", "bottom").agg(F.count("*").alias("n"), F.sum("code").alias("codes"))


add("mask_files", _mask_files, fx.with_("blocks") + "SELECT 's' || slide_id slide_name, CAST(x // 24 * 24 AS INT) AS \"left\", CAST(y // 24 * 24 AS INT) top, CAST(x // 24 * 24 + 24 AS INT) AS \"right\", CAST(y // 24 * 24 + 24 AS INT) bottom, count(*) n, CAST(sum(label) AS BIGINT) codes FROM blocks GROUP BY 1, 2, 3, 4, 5")
_dark = lambda s, d: fx.pixels(s, d).where("r < 128").select("slide_id", "y", "x")
_on = lambda s, d: fx.blocks(s, d).select("slide_id", "y", "x")
_MASKS = fx.with_("pixels", "blocks") + ", a AS (SELECT slide_id, y, x FROM pixels WHERE r < 128), b AS (SELECT slide_id, y, x FROM blocks) "
add("mask_and", lambda s, d: _dark(s, d).intersect(_on(s, d)), _MASKS + "SELECT * FROM a INTERSECT SELECT * FROM b")
add("mask_or", lambda s, d: _dark(s, d).union(_on(s, d)).distinct(), _MASKS + "SELECT * FROM a UNION SELECT * FROM b")
add("mask_xor", lambda s, d: _dark(s, d).unionAll(_on(s, d)).groupBy("slide_id", "y", "x").agg(F.count("*").alias("n")).where("n = 1").drop("n"), _MASKS + "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
add("mask_minus", lambda s, d: _dark(s, d).exceptAll(_on(s, d)), _MASKS + "SELECT * FROM a EXCEPT ALL SELECT * FROM b")
_slides = lambda s, d: fx.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("slide_id"), F.when(F.col("n_nationkey") % 3 != 0, (1 + F.col("n_nationkey")) / 10000.0).alias("mm_x"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") + 20.0).alias("magnification"))
add(
    "scale_factors",
    lambda s, d: _slides(s, d).select("slide_id", F.round(F.coalesce(F.col("mm_x") / 0.00025, 10.0 / F.col("magnification"), F.lit(1.0)), 6).alias("factor")),
    "SELECT CAST(n_nationkey AS INT) slide_id, round(CASE WHEN n_nationkey % 3 <> 0 THEN (1 + n_nationkey) / 10000.0::DOUBLE / 0.00025::DOUBLE WHEN n_nationkey % 4 <> 0 THEN 10.0::DOUBLE / (n_nationkey + 20) ELSE 1.0 END, 6) factor FROM nation",
)
add("overview_factors", lambda s, d: s.createDataFrame([(k, stains.low_resolution(1000 * (k + 1) ** 3)) for k in range(20)], "slide_id int, factor int"), "SELECT CAST(range AS INT) slide_id, CAST(pow(2, greatest(0, floor(log2(1000 * pow(range + 1, 3) / 2048)))) AS INT) factor FROM range(0, 20)")
add("zoomed_out_bounds", lambda s, d: fx.elements(s, d).select("element_id", *(F.greatest(F.lit(0), F.col(c) - 2 * (F.col(b) - F.col(c))).alias(c) for c, b in (("xmin", "xmax"), ("ymin", "ymax"))), *(F.least(F.lit(4096), F.col(b) + 2 * (F.col(b) - F.col(c))).alias(b) for c, b in (("xmin", "xmax"), ("ymin", "ymax")))), fx.with_("elements") + "SELECT element_id, greatest(0, xmin - 2 * (xmax - xmin)) xmin, greatest(0, ymin - 2 * (ymax - ymin)) ymin, least(4096, xmax + 2 * (xmax - xmin)) xmax, least(4096, ymax + 2 * (ymax - ymin)) ymax FROM elements")


def _gt_file(s, d):
    at = _place(s)
    rows = [(g, o, c, r, b, color, "note, quoted") for g, o, c, r, b, color in fx.GT_ROWS]
    s.createDataFrame(rows, tables.GT_SCHEMA).write.csv(at, header=True, quoteAll=True)
    return tables.read_gt_codes(s, at).select(F.col("group").alias("grp"), "GT_code", "color", "comments")


add("gt_codes_file", _gt_file, fx.with_("gt_codes") + "SELECT grp, gt_code \"GT_code\", color, 'note, quoted' comments FROM gt_codes")


def _png(s, d):
    """Patches encoded as pictures, and their pixels read again."""

    def encode(t: pd.DataFrame) -> pd.DataFrame:
        im = np.zeros((int(t.y.max()) + 1, int(t.x.max()) + 1), np.uint8)
        im[t.y, t.x] = t.i
        return pd.DataFrame({"path": [f"{t.vec_id.iloc[0]}.png"], "content": [tiles.encode_png(im)]})

    def decode(batches):
        for t in batches:
            for name, raw in zip(t.path, t.content, strict=True):
                p = tiles.decode_png(raw)[:, :, 0]
                yield pd.DataFrame({"vec_id": [int(name.split(".")[0])], "total": [int(p.sum())], "corner": [int(p[-1, -1])]})

    pictures = fx.patches(s, d).groupBy("vec_id").applyInPandas(encode, "path string, content binary")
    return pictures.mapInPandas(decode, "vec_id long, total long, corner int")


add("png_pixels", _png, fx.with_("patches") + "SELECT vec_id, CAST(sum(i) AS BIGINT) total, max(CASE WHEN y = 7 AND x = 7 THEN i END) corner FROM patches GROUP BY 1")
add("matched_nucleus_cytoplasm", lambda s, d: fx.blocks(s, d).groupBy("slide_id", "label").agg(F.count("*").alias("nucleus")).join(fx.blocks(s, d).where("x % 2 = 0 and label % 3 <> 0").groupBy("slide_id", "label").agg(F.count("*").alias("cytoplasm")), ["slide_id", "label"], "left"), fx.with_("blocks") + "SELECT slide_id, label, nucleus, cytoplasm FROM (SELECT slide_id, label, count(*) nucleus FROM blocks GROUP BY 1, 2) LEFT JOIN (SELECT slide_id, label, count(*) cytoplasm FROM blocks WHERE x % 2 = 0 AND label % 3 <> 0 GROUP BY 1, 2) USING (slide_id, label)")
add("annotation_callback", lambda s, d: annotations.latest(fx.versions(s, d)).join(fx.versions(s, d).groupBy("annotation_id").agg(F.count("*").alias("n")), "annotation_id"), fx.with_("versions") + 'SELECT annotation_id, max("version") FILTER (n_groups > 0) AS "version", count(*) n FROM versions GROUP BY 1 HAVING max(n_groups) > 0')
