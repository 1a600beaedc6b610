"""Row-level filters and derived columns of a trade, as SQL expressions over its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeledger.schema import WEEKDAYS

IS_CLOSED = "close_time IS NOT NULL AND close_price > 0"
HAS_STRATEGY = "magic_number IS NOT NULL"

# one missing fee makes the strict net missing; the live net reads missing fees as zero
STRICT_NET = "profit + commission + swap"
LIVE_NET = "profit + coalesce(commission, 0) + coalesce(swap, 0)"

# only a non-missing, non-zero magic number triggers a recompute
RECOMPUTE_GATE = "coalesce(magic_number <> 0, false)"

DAY_KEY = "to_date(coalesce(close_time, open_time))"

BADGE_LABEL = "coalesce(nullif(phase, ''), nullif(type, ''), '—')"
BADGE_CLASS = """CASE WHEN phase = 'Fondeada' THEN 'badge-funded'
    WHEN startswith(phase, 'Fase') THEN 'badge-phase'
    WHEN type = 'Propfirm' THEN 'badge-propfirm' ELSE 'badge-default' END"""


def weekday_name(number: str) -> str:
    """Name of a weekday number, 0 for Monday."""
    names = ", ".join(f"'{d}'" for d in WEEKDAYS)
    return f"get(array({names}), {number})"


def iso_time(column: str) -> str:
    return f"date_format({column}, \"yyyy-MM-dd'T'HH:mm:ss\")"


def iso_day(column: str) -> str:
    return f"date_format({column}, 'yyyy-MM-dd')"


def prepare(trades: DataFrame) -> DataFrame:
    """Add net_profit, is_win, duration_min, weekday, hour and month."""
    return trades.selectExpr("*", f"{STRICT_NET} AS net_profit").selectExpr(
        "*",
        "coalesce(net_profit > 0, false) AS is_win",
        "timestampdiff(MICROSECOND, open_time, close_time) / 6e7D AS duration_min",
        f"{weekday_name('weekday(close_time)')} AS weekday",
        "hour(close_time) AS hour",
        "date_format(close_time, 'yyyy-MM') AS month",
    )


def with_strategy(trades: DataFrame) -> DataFrame:
    """Trades that belong to a strategy; those without a magic number are left out."""
    return trades.where(HAS_STRATEGY)
