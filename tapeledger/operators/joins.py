"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A broadcast table of narrow rows stays in the low hundreds of MB below this count.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table of at most ``rows`` rows, if that is few; else leave it to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which a NULL key matches a NULL key; right keys are dropped."""
    other = {k: f"__r_{k}" for k in keys}
    condition = " AND ".join(f"`{k}` <=> `{o}`" for k, o in other.items())
    joined = left.join(right.withColumnsRenamed(other), F.expr(condition), how)
    return joined.drop(*other.values())
