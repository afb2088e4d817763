"""Intermediate tables are deleted once nothing reads them."""

import os
import time

from pyspark.sql import functions as F

from slidespark.operators.components import components
from slidespark.sources import storage


def test_components_leave_their_result_only(spark):
    at = storage.shared_dir(spark).removeprefix("file://")
    storage.release_all(spark)
    before = set(os.listdir(at))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7], "a long, b long")
    out = components(edges)
    assert len(set(os.listdir(at)) - before) == 1
    want = {}
    for i in range(40):
        if i % 7:
            want[i] = want.get(i, i)
            want[i + 1] = want[i]
    assert {r.v: r.root for r in out.collect()} == want
    storage.release_all(spark)
    assert set(os.listdir(at)) == before


def test_settled_keeps_the_result_only(spark):
    at = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))

    def make():
        a = storage.materialize(spark.range(5).toDF("a"))
        inner = storage.settled(spark, lambda: storage.materialize(spark.range(3).toDF("a")))
        return storage.materialize(a.union(a)).union(inner)

    out = storage.settled(spark, make)
    assert len(set(os.listdir(at)) - before) == 1 and out.count() == 13
    storage.release(out)
    assert set(os.listdir(at)) == before


def test_materialize_leaves_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(conf, None)
    before = files()
    out = storage.materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert out.count() == 7 and spark.conf.get(conf, None) == held
    storage.release(out)
