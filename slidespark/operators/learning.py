"""Object classifiers and mixtures with Spark's own learners, and cellularity."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clusterer(features: list[str], k: int = 5, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True), KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="cluster")])


def forest(features: list[str], label: str, trees: int = 20, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__f"), RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="__f", labelCol=label, probabilityCol="probability", predictionCol="prediction")])


def classify(objects: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """Adds class and its probability; missing features count as 0, and too few or other ones are an error."""
    missing = [c for c in features if c not in objects.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    t = model.transform(objects.na.fill(0.0, features))
    p = vector_to_array("probability")
    best = F.array_max(p)
    return t.select(*objects.columns, (F.array_position(p, best) - 1).cast("int").alias("class"), best.alias("confidence"))


def mixture(objects: DataFrame, features: list[str], k: int = 5, seed: int = 7) -> DataFrame:
    """Adds component of a Gaussian mixture."""
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(objects.na.fill(0.0, features))
    return GaussianMixture(k=k, seed=seed, featuresCol="__x", predictionCol="component").fit(data).transform(data).select(*objects.columns, "component")


def cellularity(objects: DataFrame, intensity: str, by: str = "component") -> DataFrame:
    """(by, n, cellularity): median intensity of each component as a share of 255, darker being more cellular."""
    t = objects.groupBy(by).agg(F.count("*").alias("n"), F.median(intensity).alias("m"))
    return t.select(by, "n", (100 - F.floor(F.col("m") / 255 * 100)).cast("int").alias("cellularity"))


def top_cellular(regions: DataFrame, intensity: str, n: int, by: str = "slide_id") -> DataFrame:
    """The n regions of highest intensity of each slide."""
    w = Window.partitionBy(by).orderBy(F.desc(intensity), "label")
    return regions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
