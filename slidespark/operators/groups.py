"""Groups as numpy arrays, many of them in one call of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]


def per_group(t: DataFrame, keys: Sequence[str], f: Callable[[Arrays], Arrays | None], schema: str) -> DataFrame:
    """``f`` of the columns of every group, as ``applyInPandas`` would give; it returns columns of equal length, or None for no rows.

    Groups lie one after another in sorted partitions, so thousands of small ones cost one call and no tables of their own;
    a group is held whole in one task. Keys are never null.
    """
    keys, names = list(keys), [c.strip().split()[0] for c in schema.split(",")]

    def whole(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        cols = {c: d[c].to_numpy() for c in d.columns}
        new = np.flatnonzero(np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])) + 1
        made = [f({c: v[a:b] for c, v in cols.items()}) for a, b in zip([0, *new], [*new, len(d)], strict=True)]
        made = [m for m in made if m is not None]
        if made:
            yield pd.DataFrame({c: np.concatenate([np.asarray(m[c]) for m in made]) for c in names})

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for d in batches:
            if not len(d):
                continue
            last = np.flatnonzero(~(d[keys] == d[keys].iloc[-1]).all(axis=1).to_numpy())
            ends = int(last[-1]) + 1 if len(last) else 0  # where the last group of the batch begins
            if ends:
                yield from whole([*held, d.iloc[:ends]])
                held = [d.iloc[ends:]]
            elif held and (held[-1][keys].iloc[-1] != d[keys].iloc[0]).any():
                yield from whole(held)
                held = [d]
            else:
                held.append(d)
        if held:
            yield from whole(held)

    # a given number, as Spark would join small partitions to few tasks, and Python's time does not go by bytes
    spark = t.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return t.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(g, schema)
