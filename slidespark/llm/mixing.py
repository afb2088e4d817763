"""Mixing sources to target weights by systematic sampling. [DataFrame functions only]

Every source has a target of words. Its documents stand in one order: tiers by size, those of
more than an eighth of the target first, then of a fortieth, of a two-hundredth, and all others; within a
tier by size, then by a hash of the id. All documents of a tier have the same expected number of copies:
the words that the target still lacks when the tier begins, over the words of all documents from there on. With the running
sum of those numbers plus one random offset per source, a document is emitted once for each integer
boundary that its step crosses. A long document that chance takes or leaves is made up for by the shorter ones behind it,
and as sizes rise within a tier, what is missed in the end is at most about the longest document of the last.

Running sums are dealt out: ranks come from counts by (source, size), by (source, size,
slot) and a row number within a slot, where 4096 slots are a hash of the id, or of the text if it is null; a source or a
size that holds a third of all rows never meets in one task, while its counts do.

Null texts have size 0; a null source is the last source; repeated rows are documents of
their own; an empty table gives an empty result; source sizes of 0 give target 0.
Reruns agree: offset and order are functions of source and id. (Rows alike in id and size
may swap their copies; the rows of the result are the same.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidespark.sources.storage import materialize


WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: A document belongs to the first tier of which its size times this is more than its source's target, else to one more.
TIERS = (8, 40, 200)
_HEX = 16.0**13
#: Sources up to which their rows travel with every task (10 MB).
MANY = 50_000


def words(text: Column) -> Column:
    """Number of maximal runs other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, most: int = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last: shares by weight, stopped at ``most`` times the size, the excess shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    total = float(sum(s for _, s in order))
    open_, target = list(range(len(order))), [0.0] * len(order)
    while open_:
        share = sum(weight[i] for i in open_)
        rest = total - sum(float(most * order[i][1]) for i in range(len(order)) if i not in set(open_))
        over = [i for i in open_ if rest * weight[i] / share > most * order[i][1]]
        for i in open_:
            target[i] = float(most * order[i][1]) if i in over else rest * weight[i] / share
        if not over:
            break
        open_ = [i for i in open_ if i not in set(over)]
    return [(s, n, t) for (s, n), t in zip(order, target, strict=True)]


def offset(source: str | None) -> float:
    """The random offset of a source, in [0, 1)."""
    return int(hashlib.md5(f"{SEED}/{chr(0) if source is None else source}".encode()).hexdigest()[:13], 16) / _HEX


def _copies() -> Column:
    """Boundaries crossed by the k-th document of a tier, whose running sum begins at ``base``."""
    k = F.col("rank") - F.col("before")
    at = lambda k: F.floor(F.col("base") + F.col("rate") * k + F.col("start"))
    return (at(k) - at(k - 1)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies, rank) of every document.

    Sources are a small dimension: their sizes, and nothing else, come to the driver.
    """
    spark = docs.sparkSession
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), digest.alias("digest"))
    sized = materialize(sized.withColumn("slot", F.substring("digest", 1, 3)))  # texts are read once
    by_slot = sized.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    by_size = by_slot.groupBy("source", "size").agg(F.sum("n").alias("n"))
    table = targets([(r.source, r.words) for r in by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()], weights, most)
    keyed = lambda df: F.broadcast(df) if len(table) <= MANY else df  # noqa: E731  one row for each source, or for each and a tier
    aims = keyed(spark.createDataFrame(table, "t_source string, source_size long, target double"))
    tier = F.coalesce(*(F.when(F.col("size") * m > F.col("target"), F.lit(i)) for i, m in enumerate(TIERS)), F.lit(len(TIERS)))
    tiered = lambda df: df.join(aims, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("tier", tier)
    inside = {(r.source, r.tier): (r.n, r.words) for r in tiered(by_size).groupBy("source", "tier").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))
    low = by_size.withColumn("below", F.coalesce(before("source", "size"), F.lit(0))).select(F.col("source").alias("a_source"), F.col("size").alias("a_size"), "below")
    mid = by_slot.withColumn("within", F.coalesce(before("source", "size", "slot"), F.lit(0))).select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("slot").alias("b_slot"), "within")
    out = sized.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("digest", "id")))
    out = out.join(mid, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("slot") == F.col("b_slot")))
    out = out.join(low, F.col("source").eqNullSafe(F.col("a_source")) & (F.col("size") == F.col("a_size")))
    out = out.select("id", "source", "size", (F.col("below") + F.col("within") + F.col("place")).cast("long").alias("rank"))
    out = materialize(tiered(out))
    plan: list[tuple] = []
    state = {x: (0.0, 0, n, sum(inside.get((x, i), (0, 0))[0] for i in range(len(TIERS) + 1))) for x, n, _ in table}  # base, taken, words and documents from here on
    for i in range(len(TIERS) + 1):
        step = []
        for x, _, aim in table:
            base, taken, rest, left = state[x]
            n, words_ = inside.get((x, i), (0, 0))
            rate = min(float(most), max(0.0, (aim - taken) / rest)) if rest else 0.0
            step.append((x, i, rate, base, left - n, offset(x)))
            state[x] = (base + rate * n, taken, rest - words_, left - n)
        plan += step
        if i < len(TIERS):
            rates = keyed(spark.createDataFrame(step, _PLAN))
            drawn = out.where(F.col("tier") == i).join(rates, F.col("source").eqNullSafe(F.col("p_source"))).groupBy("source").agg(F.sum(_copies() * F.col("size")).alias("words"))
            for row in drawn.collect():  # one row for each source
                base, taken, rest, left = state[row.source]
                state[row.source] = (base, taken + row.words, rest, left)
    rates = keyed(spark.createDataFrame(plan, _PLAN))
    out = out.join(rates, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("tier") == F.col("p_tier")))
    return out.select("id", "source", "size", "source_size", "target", _copies().alias("copies"), "rank")


_PLAN = "p_source string, p_tier int, rate double, base double, before long, start double"


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns.

    Ids that several rows share are told apart by a hash of text and source; rows alike in all three
    are emitted as often as their copies add up to: each as often as all can be, and one of them as often as is left.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))
    with_key = docs.withColumn("__key", key)
    taken = mix(docs.select(F.struct(id_col, key.alias("k")).alias("id"), text_col, source_col), "id", text_col, source_col).where("copies > 0")
    total = taken.groupBy(F.col("id.k").alias("__key")).agg(F.sum("copies").alias("__copies"))
    alike = with_key.groupBy("__key").agg(F.count("*").alias("__n"))
    held = with_key.join(total.join(alike, "__key"), "__key")
    every, left = F.floor(F.col("__copies") / F.col("__n")), F.col("__copies") % F.col("__n")
    one = held.where((F.col("__n") > 1) & (left > 0)).dropDuplicates(["__key"])
    parts = held.withColumn("__times", every).union(one.withColumn("__times", left)).where("__times > 0")
    return parts.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*docs.columns)


def oracle(weights: Sequence[int] = WEIGHTS, most: int = MOST, rounds: int = 40) -> str:
    """The same in DuckDB; sharing again takes as many rounds as sources stop."""
    tier = "CASE " + " ".join(f"WHEN d.size * {m} > t.target THEN {i}" for i, m in enumerate(TIERS)) + f" ELSE {len(TIERS)} END"
    steps = ""
    for i in range(len(TIERS)):
        steps += f""",
c{i} AS (SELECT r.source, sum((floor(base + rate * k + u) - floor(base + rate * (k - 1) + u)) * size) AS words FROM r JOIN p{i} ON r.source IS NOT DISTINCT FROM p{i}.source WHERE tier = {i} GROUP BY r.source),
p{i + 1} AS (
  SELECT source, target, rest, base, taken, CASE WHEN rest > 0 THEN least({most}.0, greatest(0.0, (target - taken) / rest)) ELSE 0.0 END AS rate, u
  FROM (SELECT p.source, p.target, p.rest - coalesce(g.w, 0) AS rest, p.base + p.rate * coalesce(g.n, 0) AS base, p.taken + coalesce(c.words, 0) AS taken, p.u
        FROM p{i} p LEFT JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.tier = {i} LEFT JOIN c{i} c ON c.source IS NOT DISTINCT FROM p.source))"""
    every = " UNION ALL ".join(f"SELECT source, {i} AS tier, base, rate, u FROM p{i}" for i in range(len(TIERS) + 1))
    w = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(weights)) + " END"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, {w} AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS i, source, n, w, false AS full_ FROM s
  UNION ALL
  SELECT i + 1, source, n, w,
         full_ OR ((SELECT sum(n) FROM s)::DOUBLE - sum(CASE WHEN full_ THEN {most} * n ELSE 0 END) OVER ()) * w
                  / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0) > {most} * n
  FROM fill WHERE i < {rounds}),
t AS (
  SELECT source, n, CASE WHEN full_ THEN CAST({most} * n AS DOUBLE)
    ELSE ((SELECT sum(n) FROM s)::DOUBLE - sum(CASE WHEN full_ THEN {most} * n ELSE 0 END) OVER ()) * w
         / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0) END AS target
  FROM fill WHERE i = {rounds}),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source, tier ORDER BY size, digest, doc_id) AS k
  FROM (SELECT d.doc_id, d.source, d.size, d.digest, t.n AS source_size, t.target, {tier} AS tier FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)),
g AS (SELECT source, tier, count(*) AS n, sum(size) AS w FROM r GROUP BY source, tier),
p0 AS (
  SELECT source, target, n AS rest, 0.0::DOUBLE AS base, 0 AS taken, CASE WHEN n > 0 THEN least({most}.0, greatest(0.0, target / n)) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('{SEED}/' || coalesce(source, chr(0))), 1, 13) AS BIGINT) AS DOUBLE) / {_HEX!r} AS u
  FROM t){steps}
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST((floor(p.base + p.rate * k + u) - floor(p.base + p.rate * (k - 1) + u)) * r.size AS BIGINT) AS taken
FROM r JOIN ({every}) p ON r.source IS NOT DISTINCT FROM p.source AND r.tier = p.tier"""
