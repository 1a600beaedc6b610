"""Reports: the operators put together, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import half_even, listed, quoted, ratio
from tapeledger.functions.ratings import rating_columns
from tapeledger.operators import buckets as B
from tapeledger.operators import path as P
from tapeledger.operators import stats as S
from tapeledger.operators.enrich import iso_time
from tapeledger.operators.joins import join_on_keys
from tapeledger.operators.ordered import (
    DEFAULT_POLICY, FIRST_COMMENT, ChunkPolicy, Extra, path_figures,
)

EA = ["magic_number"]

FULL = [
    *S.BASIC,
    *P.DRAWDOWN,
    *S.RISK,
    *S.EXPECTANCY,
    *P.STREAKS,
    "first_open AS date_from",
    "last_close AS date_to",
]


def with_metrics(
    stats: DataFrame,
    figures: DataFrame,
    keys: list[str],
    initial: float | str = P.INITIAL_BALANCE,
    risk_free_rate: float = 0.0,
    extras: tuple[Extra, ...] = (),
) -> DataFrame:
    """All summary and advanced figures, from statistics and path figures of the keys."""
    both = join_on_keys(stats, figures.drop("n"), keys)
    measured = P.with_drawdown(S.with_ratios(both, risk_free_rate), initial)
    return measured.selectExpr(*quoted(keys), *FULL, *[extra.name for extra in extras])


def full_metrics(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = P.INITIAL_BALANCE,
    risk_free_rate: float = 0.0,
    policy: ChunkPolicy = DEFAULT_POLICY,
    extras: tuple[Extra, ...] = (),
) -> DataFrame:
    """All summary and advanced figures of every key, and the extras of its path pass.

    The order-free half is combined map-side and moves one row per key and task; only the
    narrow path half (key, order, net) is shuffled row by row.
    """
    stats = S.trade_stats(prepared, keys)
    figures = path_figures(prepared, keys, policy, extras)
    return with_metrics(stats, figures, keys, initial, risk_free_rate, extras)


def strategy_summary(
    prepared: DataFrame,
    initial: float | str = P.INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One line per strategy: name, headline figures, date range."""
    metrics = full_metrics(prepared, EA, initial, policy=policy, extras=(FIRST_COMMENT,))
    return metrics.selectExpr(
        "magic_number",
        "comment",
        "total_trades",
        "total_net_profit AS net_profit",
        "win_rate_pct AS win_rate",
        "profit_factor",
        "max_drawdown_pct",
        "sharpe_ratio",
        "date_from",
        "date_to",
    )


def by_symbol(
    prepared: DataFrame,
    initial: float | str = P.INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Headline figures per strategy and symbol, all in one plan."""
    keys = ["magic_number", "symbol"]
    return full_metrics(prepared, keys, initial, policy=policy).selectExpr(
        *keys,
        "total_trades",
        "total_net_profit AS net_profit",
        "win_rate_pct AS win_rate",
        "profit_factor",
        "max_drawdown_pct",
        "expectancy",
    )


def ratings(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.selectExpr(*quoted(keys), *rating_columns())


def _bucket_map(order: str, key: str) -> str:
    """Bucket rows of one kind as a map, key -> (trades, profit, avg), in bucket order."""
    mean = half_even(ratio("net", "trades"), 2)
    value = f"named_struct('trades', trades, 'profit', {half_even('net', 2)}, 'avg', {mean})"
    entry = f"CASE WHEN {order} IS NOT NULL THEN struct({order}, {key} AS key, {value} AS value) END"
    pairs = f"transform(array_sort(collect_list({entry})), e -> struct(e.key, e.value))"
    return f"map_from_entries({pairs})"


def time_analysis(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket maps plus best and worst buckets, as one struct per key.

    A key has at most 24 hours, 7 weekdays and its calendar months, so the lists stay short
    however many trades it has.
    """
    parts = [
        f"{_bucket_map('hour', 'hour')} AS by_hour",
        f"{_bucket_map('weekday_no', 'weekday')} AS by_weekday",
        f"{_bucket_map('month_start', 'month')} AS by_month",
        *B.BEST_WORST,
    ]
    fields = [part.rsplit(" ", 1)[1] for part in parts]
    return (
        B.bucket_table(prepared, keys)
        .groupBy(*keys)
        .agg(*[F.expr(e) for e in parts])
        .selectExpr(*quoted(keys), f"struct({listed(fields)}) AS time_analysis")
    )


SUMMARY_FIELDS = [
    "total_trades", "winning_trades", "losing_trades", "win_rate_pct", "profit_factor",
    "total_net_profit", "gross_profit", "gross_loss", "avg_win", "avg_loss", "avg_trade",
    "best_trade", "worst_trade", "payoff_ratio", "total_commissions", "total_swaps",
    "avg_duration_min", "max_drawdown_usd", "max_drawdown_pct", "recovery_factor",
    "initial_balance", "final_balance", "return_pct", "sharpe_ratio", "sortino_ratio",
    "calmar_ratio",
]
ADVANCED_FIELDS = [
    "expectancy", "expectancy_per_dollar", "max_consecutive_wins", "max_consecutive_losses",
    "current_streak", "current_streak_type", "profit_std_dev", "coefficient_of_variation",
]


def report_documents(
    prepared: DataFrame,
    initial: float | str = P.INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One JSON document per strategy: summary, advanced, time analysis, range.

    The curve of a strategy has one point per trade and no bound; it is delivered in pages of a
    fixed size by curve_pages.
    """
    metrics = full_metrics(prepared, EA, initial, policy=policy, extras=(FIRST_COMMENT,))
    named = metrics.selectExpr("*", f"{S.LABEL} AS ea_name")
    whole = join_on_keys(named, time_analysis(prepared, EA), EA)
    sections = [
        "magic_number",
        "ea_name",
        f"struct({listed(SUMMARY_FIELDS)}) AS summary",
        f"struct({listed(ADVANCED_FIELDS)}) AS advanced",
        "time_analysis",
        "total_trades AS trade_count",
        f"named_struct('from', {iso_time('date_from')}, 'to', {iso_time('date_to')}) AS date_range",
    ]
    return whole.selectExpr("magic_number", f"to_json(struct({', '.join(sections)})) AS document")


def curve_pages(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = P.INITIAL_BALANCE,
    page_rows: int = 10_000,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The equity curve as arrays of {time, equity}, page_rows points per array."""
    curve = P.equity_curve(prepared, keys, initial, policy)
    points = "array_sort(collect_list(struct(seq, time, equity)))"
    return curve.groupBy(*keys, F.expr(f"(seq - 1) div {page_rows} AS page")).agg(
        F.expr(f"transform({points}, p -> named_struct('time', p.time, 'equity', p.equity)) AS equity_curve")
    )
