"""Connected components of an edge table, by hooking and shortcutting in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.sources.storage import grown, materialize, release


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, root) for every end of an edge (a, b); the root is the least vertex of its component.

    Each round hooks every remaining root to its least neighbour, follows pointers to the
    end, and contracts the edges to their roots, so that the edge table shrinks by a constant
    factor or more. Sums and minima by vertex are pre-aggregated, joins on a hub split.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = materialize(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct().withColumn("root", F.col("v")))
    for _ in range(rounds):
        if edges.isEmpty():
            release(edges)
            return labels
        up = materialize(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        while True:  # pointers always fall, so this ends; the depth halves each time
            far = up.join(grown(up.select(F.col("v").alias("p"), F.col("p").alias("pp"))), "p", "left")
            if far.where("pp is not null").isEmpty():
                break
            up, old = materialize(far.select("v", F.coalesce("pp", "p").alias("p"))), up
            release(old)
        to = up.select(F.col("v").alias("root"), "p")
        a, b = (up.select(F.col("v").alias(x), F.col("p").alias(f"{x}p")) for x in "ab")
        moved = edges.join(grown(a), "a", "left").join(grown(b), "b", "left").select(F.coalesce("ap", "a").alias("x"), F.coalesce("bp", "b").alias("y")).where("x <> y")
        old = (labels, edges, up)
        labels = materialize(labels.join(grown(to), "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        edges = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(*old)
    raise RuntimeError("components did not settle")
