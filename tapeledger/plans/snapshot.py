"""Dated metric snapshots and their merge into the stored table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy
from tapeledger.operators.path import INITIAL_BALANCE
from tapeledger.plans.reports import EA, full_metrics
from tapeledger.schema import SNAPSHOT_COLUMNS, SNAPSHOT_KEY, SNAPSHOT_REFRESHED


def snapshot_rows(
    prepared: DataFrame,
    target_date: date | str,
    initial: float | str = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All strategies under one date. The date is a label; it cuts off no trades."""
    return (
        full_metrics(prepared, EA, initial, policy=policy)
        .selectExpr("*", f"date'{target_date}' AS snapshot_date")
        .select(*SNAPSHOT_COLUMNS)
    )


def merge_snapshots(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored snapshots after the fresh ones came in.

    A new key is inserted whole; a known key gets the refreshed columns and keeps the others.
    """
    values = [c for c in SNAPSHOT_COLUMNS if c not in SNAPSHOT_KEY]
    old = stored.selectExpr(*SNAPSHOT_COLUMNS, "true AS is_old")
    new = fresh.selectExpr(
        *SNAPSHOT_KEY, *[f"{c} AS new_{c}" for c in values], "true AS is_new"
    )
    merged = [
        f"CASE WHEN is_new THEN new_{c} ELSE {c} END AS {c}"
        if c in SNAPSHOT_REFRESHED
        else f"CASE WHEN is_old THEN {c} ELSE new_{c} END AS {c}"
        for c in values
    ]
    return old.join(new, SNAPSHOT_KEY, "full_outer").selectExpr(*SNAPSHOT_KEY, *merged)
