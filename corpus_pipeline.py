"""A corpus pipeline of five stages, each over all that the one before has kept.

Every stage takes the columns of documents and returns them, rows in no order. Null and empty texts are not
toxic, have no copies to cut and no passage of the benchmark, and weigh nothing in the mix; rows alike without a word
count as copies. Ids may be null or shared: rows are told apart by a number of their own or by a digest of
all that the stage looks at, never by the id alone. Of copies the one of least id stays, then of the first row.
Texts of any length are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidespark.llm import decontam, mixing, order_minhash, suffix_dedup, toxicity
from slidespark.sources.storage import materialize, release, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; learns from all labelled documents of its input, up to the sample bound."""
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, scorer, to="__score").where("__score < 0.5").drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the least id, one without an id only where none has one; of rows alike without a word, one."""
    key = F.xxhash64("doc_id", "text", "lang", "source", "n_chars")
    held = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("__row").alias("row"))

    def best() -> DataFrame:
        classes = order_minhash.near_duplicates(held, id_col="__row").select(F.col("id").alias("__id"), "class_id")
        return held.select("doc_id", "__row").join(classes, F.col("__row") == F.col("__id")).groupBy("class_id").agg(F.min(lead).alias("lead")).select(F.col("lead.row").alias("__id"))

    # the sketches go before texts move, by merging at any size, so that disk grows in proportion
    kept = held.join(settled(spark, best).hint("merge"), F.col("__row") == F.col("__id"), "left_semi")
    return kept.withColumn("__row", F.struct(key.alias("k"), F.col("doc_id").alias("d"))).dropDuplicates(["__row"]).drop("__row")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages; documents of which nothing remains go."""
    # rows without an id come first, in an order of their own, so that one of them is the earliest
    own = F.pmod(F.xxhash64("text"), F.lit(2**62)) + F.lit(-(2**63))
    cut = suffix_dedup.remove_repeats(docs.withColumn("__rank", F.coalesce("doc_id", own)), id_col="__rank", keep_first=True, as_text=True)
    changed = F.col("n_removed") > 0
    cut = cut.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Trained scores, sketches and suffix order have no SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, old = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir)), docs
        release(old)
    return STAGES[-1][1](spark, docs, sf_dir)
