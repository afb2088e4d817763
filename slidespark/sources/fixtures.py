"""Image and annotation tables derived from the shared star-schema tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, x, y, r, g, b): one row for each pixel."""
    whole = lambda c, k: F.max(F.floor(F.col(c) * k).cast("int"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.floor(F.col("l_suppkey") / 10).cast("int").alias("slide_id"), (F.col("l_orderkey") % 48).cast("int").alias("x"), (F.col("l_partkey") % 48).cast("int").alias("y"))
        .agg(whole("l_quantity", 5).alias("r"), whole("l_discount", 2550).alias("g"), whole("l_tax", 3187).alias("b"))
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, y, x, i): dense 8 x 8 grey patches."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.5) * 255))).cast("int")
    return t.select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), grey.alias("i"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, y, x, label): a sparse label image."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_suppkey") / 10).cast("int").alias("slide_id"), (F.col("l_orderkey") % 48).cast("int").alias("x"), (F.col("l_partkey") % 48).cast("int").alias("y")).agg(F.max("l_quantity").alias("q"))
    return t.where("q >= 30").select("slide_id", "y", "x", (1 + F.floor(F.col("x") / 8) + 6 * F.floor(F.col("y") / 8)).cast("int").alias("label"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, doc_id, element_id, grp, xmin, ymin, xmax, ymax): annotation rectangles."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("int").alias("slide_id"), F.col("o_custkey").alias("doc_id"), k.alias("element_id"), F.col("o_orderpriority").alias("grp"),
        ((k * 37) % 4096).cast("int").alias("xmin"), ((k * 101) % 4096).cast("int").alias("ymin"),
        ((k * 37) % 4096 + 8 + F.floor(F.col("o_totalprice") / 5000)).cast("int").alias("xmax"), ((k * 101) % 4096 + 8 + k % 61).cast("int").alias("ymax"),
    )


GT_ROWS = [("1-URGENT", 0, 254, 1, 0, "rgb(200,0,150)"), ("2-HIGH", 1, 1, 0, 0, "rgb(255,0,0)"), ("3-MEDIUM", 2, 2, 0, 1, "rgb(255,125,0)"), ("4-NOT SPECIFIED", 1, 3, 0, 0, "rgb(0,0,255)"), ("5-LOW", 3, 7, 0, 0, "rgb(0,0,0)")]


def gt_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GT_ROWS, "grp string, overlay_order int, gt_code int, is_roi int, is_background_class int, color string")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, cx, cy): centroids, labels as slides."""
    at = lambda k: F.floor((F.element_at("embedding", k).cast("double") + 0.5) * 1000).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("cx"), at(2).alias("cy"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("annotation_id"), F.col("event_id").alias("version"), "event_type", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n_groups"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("folder_id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    return r.unionAll(table(spark, sf_dir, "nation").select((100 + F.col("n_nationkey")).cast("int"), F.col("n_regionkey").cast("int"), "n_name"))


SQL = {
    "pixels": "SELECT CAST(floor(l_suppkey / 10) AS INT) slide_id, CAST(l_orderkey % 48 AS INT) x, CAST(l_partkey % 48 AS INT) y, max(CAST(floor(l_quantity * 5) AS INT)) r, max(CAST(floor(l_discount * 2550) AS INT)) g, max(CAST(floor(l_tax * 3187) AS INT)) b FROM lineitem GROUP BY 1, 2, 3",
    "patches": "SELECT vec_id, label, CAST(floor(p / 8) AS INT) y, CAST(p % 8 AS INT) x, CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT) i FROM (SELECT vec_id, label, unnest(range(64)) p, unnest(embedding) v FROM embeddings)",
    "blocks": "SELECT slide_id, y, x, CAST(1 + floor(x / 8) + 6 * floor(y / 8) AS INT) label FROM (SELECT CAST(floor(l_suppkey / 10) AS INT) slide_id, CAST(l_orderkey % 48 AS INT) x, CAST(l_partkey % 48 AS INT) y, max(l_quantity) q FROM lineitem GROUP BY 1, 2, 3) WHERE q >= 30",
    "elements": "SELECT CAST(c_nationkey AS INT) slide_id, o_custkey doc_id, o_orderkey element_id, o_orderpriority grp, CAST((o_orderkey * 37) % 4096 AS INT) xmin, CAST((o_orderkey * 101) % 4096 AS INT) ymin, CAST((o_orderkey * 37) % 4096 + 8 + floor(o_totalprice / 5000) AS INT) xmax, CAST((o_orderkey * 101) % 4096 + 8 + o_orderkey % 61 AS INT) ymax FROM orders JOIN customer ON o_custkey = c_custkey",
    "gt_codes": "SELECT * FROM (VALUES " + ", ".join(str(x) for x in GT_ROWS) + ") t(grp, overlay_order, gt_code, is_roi, is_background_class, color)",
    "points": "SELECT vec_id, label, CAST(floor((CAST(embedding[1] AS DOUBLE) + 0.5) * 1000) AS INT) cx, CAST(floor((CAST(embedding[2] AS DOUBLE) + 0.5) * 1000) AS INT) cy FROM embeddings",
    "versions": "SELECT user_id annotation_id, event_id \"version\", event_type, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END n_groups FROM events",
    "folders": "SELECT CAST(r_regionkey AS INT) folder_id, CAST(NULL AS INT) parent_id, r_name AS name FROM region UNION ALL SELECT CAST(100 + n_nationkey AS INT), CAST(n_regionkey AS INT), n_name FROM nation",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(json): one annotation document for each customer; an element is a point, a turned rectangle or a polyline by its id."""
    e = elements(spark, sf_dir)
    k, f = F.col("element_id"), lambda c: F.col(c).cast("double")
    none = lambda t: F.lit(None).cast(t)
    ring = F.array(*(F.array(f(a), f(b), F.lit(0.0)) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))))
    kind = F.when(k % 10 == 0, "point").when(k % 10 <= 3, "rectangle").otherwise("polyline")
    box = F.col("__type") == "rectangle"
    middle = F.array((f("xmin") + f("xmax")) / 2, (f("ymin") + f("ymax")) / 2, F.lit(0.0))
    element = F.struct(
        k.cast("string").alias("id"), F.col("__type").alias("type"), F.when(k % 7 != 0, F.col("grp")).alias("group"), F.when(k % 5 != 0, F.struct(F.concat(F.lit("l-"), F.col("grp")).alias("value"))).alias("label"), F.lit("rgb(1,2,3)").alias("lineColor"),
        F.when(F.col("__type") == "polyline", ring).alias("points"), F.when(F.col("__type") != "polyline", middle).alias("center"),
        F.when(box, f("xmax") - f("xmin")).otherwise(none("double")).alias("width"), F.when(box, f("ymax") - f("ymin")).otherwise(none("double")).alias("height"), F.when(box, (k % 4) * 0.5).otherwise(none("double")).alias("rotation"),
    )
    docs = e.withColumn("__type", kind).groupBy("doc_id").agg(F.first("slide_id").alias("slide_id"), F.sort_array(F.collect_list(F.struct(k.alias("k"), element.alias("e")))).alias("es"))
    body = F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("_id"), F.col("slide_id").cast("string").alias("itemId"), F.lit("2020-01-01").alias("created"), F.struct(F.concat(F.lit("name "), F.col("doc_id").cast("string")).alias("name"), F.transform("es", lambda x: x["e"]).alias("elements")).alias("annotation"))
    return docs.select(F.to_json(body).alias("json"))
