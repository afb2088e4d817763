"""Reading and writing of annotation, feature and pixel tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.operators import annotations_json, spatial, tiles

GT_SCHEMA = "`group` string, overlay_order int, GT_code int, is_roi int, is_background_class int, color string, comments string"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): whole files of annotation documents; a file that holds an array gives a row for each of its documents."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    many = F.from_json("json", "array<string>")
    docs = F.when(F.ltrim("json").startswith("["), many).otherwise(F.array("json"))
    return t.select("path", F.explode(docs).alias("json"))


def read_gt_codes(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth codes; a code must lie between 0 and 255."""
    t = spark.read.schema(GT_SCHEMA).csv(path, header=True, quote='"', escape='"')
    return t.where(F.coalesce(F.assert_true((F.col("GT_code") > 0) & (F.col("GT_code") < 255), "codes lie between 0 and 255").isNull(), F.lit(True)))


def read_features(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Feature tables from CSV or Parquet, missing numbers as 0."""
    t = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else (spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True))
    return t.na.fill(0)


def write_features(t: DataFrame, path: str) -> None:
    """CSV or Parquet by the path's ending."""
    if path.rstrip("/").endswith(".csv"):
        t.write.mode("overwrite").csv(path, header=True)
    else:
        t.write.mode("overwrite").parquet(path)


def export_annotations(raw: DataFrame, path: str, column: str = "json") -> None:
    """Appends the tables ``annotation_docs`` and ``annotation_elements`` under a path; documents that are no JSON go to ``rejected``."""
    ok = annotations_json.parsed(raw, column).where("doc._id is not null").select(column)
    annotations_json.documents(ok, column).write.mode("append").parquet(f"{path}/annotation_docs")
    annotations_json.elements(ok, column).write.mode("append").parquet(f"{path}/annotation_elements")
    annotations_json.parsed(raw, column).where("doc._id is null").select(column).write.mode("append").parquet(f"{path}/rejected")


def write_json(docs: DataFrame, path: str, column: str = "json") -> None:
    """One document to a line."""
    docs.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_pixels(px: DataFrame, path: str) -> None:
    """A mosaic as Parquet, a folder for each slide."""
    px.repartition("slide_id", F.floor(F.col("y") / 1024), F.floor(F.col("x") / 1024)).write.mode("overwrite").partitionBy("slide_id").parquet(path)


_SQLITE = {"string": "TEXT", "boolean": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "double": "REAL"}


def append_sqlite(t: DataFrame, database: str, table: str) -> int:
    """Appends rows to a SQLite table by streaming them through the driver, a partition at a time; columns that the table lacks are dropped."""
    with sqlite3.connect(database) as con:
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(f"\"{c}\" {_SQLITE.get(k, "TEXT")}" for c, k in t.dtypes)})')
        there = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
        names = [c for c in t.columns if c in there]
        rows: Iterator = t.select(*(f"`{c}`" for c in names)).toLocalIterator()
        done = con.executemany(f'INSERT INTO "{table}" ({", ".join(f"\"{c}\"" for c in names)}) VALUES ({", ".join("?" * len(names))})', (tuple(r) for r in rows))
        return done.rowcount


def write_masks(px: DataFrame, path: str, size: int) -> None:
    """Masks of regions (slide_id, top, left, y, x, code below 256): a row for each, its file name with the bounds and its PNG, in a folder for each slide."""

    def f(t: pd.DataFrame) -> pd.DataFrame:
        slide, top, left = (int(t[c].iloc[0]) for c in ("slide_id", "top", "left"))
        m = np.zeros((size, size), np.uint8)
        m[t.y - top, t.x - left] = t.code
        name = f"s{slide}_id-{top}x{left}_left-{left}_top-{top}_bottom-{top + size}_right-{left + size}.png"
        return pd.DataFrame({"slide_id": [slide], "path": [name], "content": [tiles.encode_png(m)]})

    px.groupBy("slide_id", "top", "left").applyInPandas(f, "slide_id int, path string, content binary").write.mode("overwrite").partitionBy("slide_id").parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(slide_name, left, top, right, bottom, y, x, code) of such masks; 0 is left out."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for name, raw in zip(t.path, t.content, strict=True):
                m = tiles.decode_png(bytes(raw))[:, :, 0]
                y, x = np.nonzero(m)
                yield pd.DataFrame({"path": name, "y": y.astype(np.int32), "x": x.astype(np.int32), "code": m[y, x].astype(np.int32)})

    t = spark.read.parquet(path).select("path", "content").mapInPandas(f, "path string, y int, x int, code int")
    bounds = dict(zip(("slide_name", "id", "left", "top", "right", "bottom"), spatial.file_bounds(F.concat(F.lit("/"), F.col("path"))), strict=True))
    return t.select(*(bounds[c].alias(c) for c in ("slide_name", "left", "top", "right", "bottom")), (F.col("y") + bounds["top"]).alias("y"), (F.col("x") + bounds["left"]).alias("x"), "code")
