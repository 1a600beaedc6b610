"""Rounding and guarded division, as SQL expression text.

Formulas are written as SQL text throughout the library: one expression is one call into the
JVM, where the same formula built from Column objects is dozens.
"""

from __future__ import annotations

INF = "double('inf')"


def half_even(value: str, places: int) -> str:
    """Round half to even, as a double. Infinite or oversized values pass through unrounded."""
    return (
        f"coalesce(cast(bround(try_cast({value} AS DECIMAL(38,12)), {places}) AS DOUBLE), "
        f"cast({value} AS DOUBLE))"
    )


def half_up(value: str, places: int) -> str:
    """Round half away from zero, as a double."""
    return (
        f"coalesce(cast(round(try_cast({value} AS DECIMAL(38,12)), {places}) AS DOUBLE), "
        f"cast({value} AS DOUBLE))"
    )


def ratio(numerator: str, denominator: str, otherwise: str = "NULL") -> str:
    """numerator / denominator where the denominator is positive, else ``otherwise``."""
    return (
        f"CASE WHEN ({denominator}) > 0 THEN cast({numerator} AS DOUBLE) / "
        f"cast({denominator} AS DOUBLE) ELSE cast({otherwise} AS DOUBLE) END"
    )


def quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]


def listed(names) -> str:
    return ", ".join(quoted(names))
