"""Recurring jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tapeledger.operators.enrich import prepare
from tapeledger.operators.guarded import apart
from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy
from tapeledger.operators.path import INITIAL_BALANCE
from tapeledger.plans.reports import EA
from tapeledger.plans.snapshot import merge_snapshots, snapshot_rows
from tapeledger.session import durable
from tapeledger.sources.sinks import read_snapshots, upsert_snapshot_day
from tapeledger.sources.trades import closed_strategy_trades


def run_snapshot(
    spark: SparkSession,
    trades: DataFrame,
    root: str,
    target_date: date | str | None = None,
    initial: float = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
    on_errors: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Snapshot all strategies under a date (default today), merged into what that date holds.

    Only the folder of that date is read and written. When to run it, hourly or daily, is up to the caller; running it
    again is harmless, also after a run that died half-way, and so is running it twice at the same time. A strategy whose
    sums do not fit keeps what that date holds of it; ``on_errors`` gets these strategies and what is wrong with them.
    """
    day = str(target_date or date.today())
    sound, failing = apart(prepare(closed_strategy_trades(trades)), EA)
    if on_errors:
        on_errors(failing)
    rows = durable(snapshot_rows(sound, day, initial, policy))
    upsert_snapshot_day(rows, root, day, merge_snapshots)
    return read_snapshots(spark, root)
