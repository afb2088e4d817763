"""Grey-level pair matrices, their marginals, and thirteen texture features with mean and range over offsets.

A matrix has at most ``levels`` squared cells; its cells meet in one row, so that marginals and
sums need no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

E = 1e-5
NAMES = ("asm", "contrast", "correlation", "sum_of_squares", "idm", "sum_average", "sum_variance", "sum_entropy", "entropy", "difference_variance", "difference_entropy", "imc1", "imc2")


def normed(counts: DataFrame, by: str) -> DataFrame:
    """(by, offset, i, j, p): counts made symmetric, and shares of their sum."""
    flip = counts.select(by, "offset", F.col("j").alias("i"), F.col("i").alias("j"), "n")
    both = counts.select(by, "offset", "i", "j", "n").unionByName(flip).groupBy(by, "offset", "i", "j").agg(F.sum("n").alias("n"))
    return both.select(by, "offset", "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy(by, "offset"))).alias("p"))


def marginals(p: DataFrame, by: str) -> DataFrame:
    """(by, offset, kind, k, p) with kind row, sum or difference, by one pass over the cells."""
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), k.cast("int").alias("k")) for n, k in (("row", F.col("i")), ("sum", F.col("i") + F.col("j")), ("difference", F.abs(F.col("i") - F.col("j"))))))
    return p.select(by, "offset", F.explode(kinds).alias("m"), "p").groupBy(by, "offset", "m.kind", "m.k").agg(F.sum("p").alias("p"))


def _total(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def haralick(counts: DataFrame, by: str, levels: int = 8) -> DataFrame:
    """Thirteen features, ``_mean`` and ``_range`` over offsets, from (by, offset, i, j, n)."""
    cells = normed(counts, by).groupBy(by, "offset").agg(F.collect_list(F.struct("i", "j", "p")).alias("c"))
    spread = lambda n, k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda at: _total(F.filter("c", lambda x: k(x) == at), lambda x: x.p))
    t = cells.withColumns({"px": spread(levels, lambda x: x.i), "ps": spread(2 * levels - 1, lambda x: x.i + x.j), "pd": spread(levels, lambda x: F.abs(x.i - x.j))})
    over = lambda f: _total(F.col("c"), f)
    log = lambda x: F.log2(x + F.lit(E))
    indexed = lambda a: F.transform(a, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    px, ps, pd = F.col("px"), F.col("ps"), F.col("pd")
    at = lambda x: F.element_at(px, x + 1)
    t = t.withColumns({
        "mu": _total(indexed(px), lambda x: x.k * x.p),
        "ii": _total(indexed(px), lambda x: x.k * x.k * x.p),
        "ij": over(lambda x: x.i * x.j * x.p),
        "asm": over(lambda x: x.p * x.p),
        "contrast": _total(indexed(pd), lambda x: x.k * x.k * x.p),
        "idm": over(lambda x: x.p / (1 + (x.i - x.j) * (x.i - x.j))),
        "sum_average": _total(indexed(ps), lambda x: x.k * x.p),
        "sum_square": _total(indexed(ps), lambda x: x.k * x.k * x.p),
        "sum_entropy": -_total(ps, lambda p: p * log(p)),
        "entropy": -over(lambda x: x.p * log(x.p)),
        "difference_variance": _total(pd, lambda p: p * p) / levels - F.lit(1.0 / levels**2),
        "difference_entropy": -_total(pd, lambda p: p * log(p)),
        "hx": -_total(px, lambda p: p * log(p)),
        "hxy1": -over(lambda x: x.p * log(at(x.i) * at(x.j))),
        "hxy2": -_total(px, lambda p: _total(px, lambda q: p * q * log(p * q))),
    })
    var = F.col("ii") - F.col("mu") * F.col("mu")
    t = t.withColumns({
        "sum_of_squares": var,
        "correlation": F.coalesce((F.col("ij") - F.col("mu") * F.col("mu")) / F.when(var > 1e-12, var), F.lit(0.0)),
        "sum_variance": F.col("sum_square") - F.col("sum_average") * F.col("sum_average"),
        "imc1": F.coalesce((F.col("entropy") - F.col("hxy1")) / F.when(F.abs("hx") > 1e-12, F.col("hx")), F.lit(0.0)),
        "imc2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (F.col("hxy2") - F.col("entropy"))))),
    })
    # a flat object has only rounding left in imc2, below what its root can tell
    t = t.withColumn("imc2", F.when(F.col("imc2") > 1e-3, F.col("imc2")).otherwise(0.0))
    made = reduce(lambda a, n: [*a, F.round(F.avg(n), 5).alias(f"{n}_mean"), F.round(F.max(n) - F.min(n), 5).alias(f"{n}_range")], NAMES, [])
    return t.groupBy(by).agg(*made)
