"""Failure of one key kept apart from the others.

Under ANSI rules a sum that does not fit raises an error, which ends the whole job. Every sum of a key, over any of its
trades, stays below the sum of their absolute values; so a key for which that fits cannot fail, and one for which it
does not is reported instead of computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import quoted
from tapeledger.operators.joins import join_on_keys
from tapeledger.session import durable

# columns that are summed, and the type of the sums
SUMMED = ["net_profit", "profit", "commission", "swap"]
# sums are folded with the balance and with each other, so they get a digit less than their type holds
SUM_TYPE, LIMIT = "DECIMAL(38,4)", "cast('1e33' AS DECIMAL(38,4))"


def failing_keys(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, errors: of every key with a sum that does not fit, which ones. One map-side combined aggregate."""
    totals = [f"try_sum(abs(cast(`{c}` AS {SUM_TYPE}))) AS `{c}`" for c in SUMMED]
    counts = [f"count(`{c}`) AS `n_{c}`" for c in SUMMED]
    per_key = prepared.groupBy(*keys).agg(*[F.expr(e) for e in totals + counts])
    tests = ", ".join(f"CASE WHEN `n_{c}` > 0 AND coalesce(`{c}` >= {LIMIT}, true) THEN '{c}: sum out of range' END" for c in SUMMED)
    return per_key.selectExpr(*quoted(keys), f"array_compact(array({tests})) AS errors").where("size(errors) > 0")


def apart(prepared: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(trades of the keys that can be computed, the other keys with their errors)."""
    failing = durable(failing_keys(prepared, keys))
    return join_on_keys(prepared, failing.select(*keys), keys, "left_anti"), failing
