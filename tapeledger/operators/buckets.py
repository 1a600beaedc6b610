"""Calendar breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import half_even, listed, quoted, ratio
from tapeledger.operators.enrich import DAY_KEY, weekday_name

_SUMS = [
    "count(net_profit) AS trades",
    "coalesce(sum(net_profit), 0) AS net",
    "count_if(is_win) AS wins",
    "count(1) AS rows",
]
_MEAN = ratio("net", "trades")
BUCKET = ["trades", f"{half_even('net', 2)} AS profit", f"{half_even(_MEAN, 2)} AS avg"]

# Buckets are grouped by cheap integers and named only after the aggregation.
_WEEKDAY_NO = "weekday(close_time) AS weekday_no"
_MONTH_START = "trunc(to_date(close_time), 'month') AS month_start"
_WEEKDAY = f"{weekday_name('weekday_no')} AS weekday"
_MONTH = "date_format(month_start, 'yyyy-MM') AS month"


def _sums(grouped) -> DataFrame:
    return grouped.agg(*[F.expr(e) for e in _SUMS])


def by_hour(prepared: DataFrame, keys: list[str]) -> DataFrame:
    return _sums(prepared.groupBy(*keys, "hour")).selectExpr(*quoted(keys), "hour", *BUCKET)


def by_weekday(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """weekday_no runs from 0 (Monday) to 6 (Sunday)."""
    return _sums(prepared.groupBy(*keys, F.expr(_WEEKDAY_NO))).selectExpr(
        *quoted(keys), _WEEKDAY, "weekday_no", *BUCKET
    )


def by_month(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Also the month's win rate, which the strategy page shows."""
    win_rate = ratio("wins * 100D", "rows", "0")
    return _sums(prepared.groupBy(*keys, F.expr(_MONTH_START))).selectExpr(
        *quoted(keys), _MONTH, *BUCKET, f"{half_even(win_rate, 2)} AS win_rate"
    )


def bucket_table(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Hour, weekday and month buckets of every key from one scan.

    Each row has exactly one of hour / weekday / month set. Grouping sets keep the shuffle at
    one row per bucket and map task; the combination of all three would be far larger.
    """
    by = [F.col(k) for k in keys]
    parts = [F.col("hour"), F.col("weekday_no"), F.col("month_start")]
    rows = prepared.selectExpr(
        *quoted(keys), "hour", _WEEKDAY_NO, _MONTH_START, "net_profit", "is_win"
    )
    return _sums(rows.groupingSets([by + [p] for p in parts], *by, *parts)).selectExpr(
        "*", _WEEKDAY, _MONTH
    )


def _best_worst() -> list[str]:
    out = []
    for name in ("hour", "weekday", "month"):
        for label, rank in (("best", "-net"), ("worst", "net")):
            order = f"CASE WHEN {name} IS NOT NULL THEN struct({rank}, {name}) END"
            out.append(f"min_by({name}, {order}) AS {label}_{name}")
    return out


# over bucket_table: best and worst bucket by total net; ties go to the smallest key
BEST_WORST = _best_worst()


def best_worst(buckets: DataFrame, keys: list[str]) -> DataFrame:
    return buckets.groupBy(*keys).agg(*[F.expr(e) for e in BEST_WORST])


def first_months(prepared: DataFrame, keys: list[str], limit: int = 6) -> DataFrame:
    """The first months of every key, with their profit."""
    nth = f"row_number() OVER (PARTITION BY {listed(keys)} ORDER BY month)"
    return (
        by_month(prepared, keys)
        .selectExpr(*quoted(keys), "month", "profit", f"{nth} AS nth")
        .where(f"nth <= {limit}")
        .drop("nth")
    )


def daily_calendar(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Profit and number of trades per day, with the cell class of the calendar."""
    return (
        trades.groupBy(*keys, F.expr(f"{DAY_KEY} AS day"))
        .agg(F.expr("coalesce(sum(profit), 0) AS profit"), F.expr("count(1) AS trades"))
        .selectExpr("*", "CASE WHEN profit >= 0 THEN 'profit' ELSE 'loss' END AS cell")
    )
