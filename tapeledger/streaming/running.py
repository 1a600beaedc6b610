"""Running metrics: fold new trades into one stored summary of each key instead of reading the history again.

A batch of trades that all close after the summary is one more chunk, so summary and batch merge like chunks. Keys with
a late trade in the batch are summed up again from their history; operators.history reads only the months of late trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.operators import path as P
from tapeledger.operators.history import LAST, folded, summarised
from tapeledger.operators.ingest import restrict_to
from tapeledger.operators.joins import join_on_keys
from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy, figures
from tapeledger.plans.reports import with_metrics
from tapeledger.session import durable

summarise = summarised


def fold(earlier: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """State after both: every trade of ``later`` closes after those of ``earlier``."""
    return folded(earlier.withColumn("__at", F.lit(0)).unionByName(later.withColumn("__at", F.lit(1))), keys, "__at")


def advance(
    state: DataFrame,
    batch: DataFrame,
    history: DataFrame,
    keys: list[str],
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """State after a batch; history is the full prepared history including the batch.

    Any keys do, pairs and NULL included. The history is read for keys with late trades only, and
    not at all where there are none.
    """
    first = batch.groupBy(*keys).agg(F.expr("min(struct(close_time, id)) AS first_position"))
    late = durable(
        join_on_keys(first, state.select(*keys, LAST), keys)
        .where(f"first_position <= {LAST}")
        .select(*keys)
    )
    late_rows = late.count()
    if not late_rows:
        return fold(state, summarise(batch, keys, policy), keys)
    kept = join_on_keys(state, late, keys, "left_anti")
    on_time = summarise(join_on_keys(batch, late, keys, "left_anti"), keys, policy)
    again = summarise(restrict_to(history, late, late_rows, keys), keys, policy)
    return fold(kept, on_time, keys).unionByName(again)


def running_metrics(
    state: DataFrame,
    keys: list[str],
    initial: float | str = P.INITIAL_BALANCE,
    risk_free_rate: float = 0.0,
) -> DataFrame:
    """The figures of plans.reports.full_metrics, from the state."""
    path = figures(state.select(*keys, "path.*"), keys)
    return with_metrics(state.drop("path", LAST), path, keys, initial, risk_free_rate)
