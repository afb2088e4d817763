"""Positive-pixel counts of tiles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.operators import pixelstats

PIXELS = "slide_id int, x int, y int, r int, g int, b int"


def read_tiles(spark: SparkSession, path: str, schema: str = PIXELS, files: int | None = None) -> DataFrame:
    """A stream of Parquet files of pixels."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def running_counts(pixels: DataFrame) -> DataFrame:
    """Counts by slide over all that has come; for output mode complete or update."""
    return pixelstats.positive_counts(pixels)


def windowed_counts(pixels: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Positive pixels by slide and window of event time; rows later than ``late`` are left out."""
    t = pixelstats.positive_labels(pixels.withWatermark(time, late))
    return t.groupBy(F.window(time, width), "slide_id").agg(F.count("*").alias("n_pixels"), F.sum((F.col("kind") > 0).cast("long")).alias("n_positive"))
