"""Numbers that look drawn, made from whole numbers by exact arithmetic, so that reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column

PRIME = 1_000_003
WEIGHTS = (7919, 104_729, 1_299_709)
SEED = 15_485_863


def mixed(*parts: Column, seed: int = 0) -> Column:
    """A number from 0 to ``PRIME - 1`` made of up to three whole numbers that are not negative."""
    a = sum((p.cast("long") * w for p, w in zip(parts[1:], WEIGHTS[1:], strict=False)), parts[0].cast("long") * WEIGHTS[0]) + seed * SEED
    a = a % PRIME
    return (a * a % PRIME * 31 + a * 17) % PRIME


def mixed_sql(*parts: str, seed: int = 0) -> str:
    a = "((" + " + ".join(f"CAST({p} AS BIGINT) * {w}" for p, w in zip(parts, WEIGHTS, strict=False)) + f" + {seed * SEED}) % {PRIME})"
    return f"(({a} * {a} % {PRIME} * 31 + {a} * 17) % {PRIME})"
