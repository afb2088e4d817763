"""Spark results against the same query in DuckDB: rows, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "smallint": "SMALLINT", "array<int>": "INTEGER[]", "array<bigint>": "BIGINT[]", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def compare(df, con, sql: str) -> str:
    """Empty if alike, else what differs."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    mine = {c: KINDS.get(t, t) for c, t in df.dtypes}
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} and {sorted(theirs)}"
    if off := [(c, mine[c], theirs[c]) for c in mine if mine[c] != theirs[c] and not theirs[c].startswith("DECIMAL")]:
        return f"types {off}"
    names = sorted(mine)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_plain(r[c]) for c in names) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=key)
    at = [rel.columns.index(c) for c in names]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}; {[x for x in a if x not in set(b)][:3]} {[x for x in b if x not in set(a)][:3]}"
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x)))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(close(p, q) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} of {len(a)} rows, {names}: {bad[:2]}" if bad else ""
