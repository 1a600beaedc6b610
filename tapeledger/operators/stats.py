"""Order-free figures: one map-side combined aggregate per key, then expressions over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import INF, half_even, listed, quoted, ratio
from tapeledger.operators.joins import join_on_keys

LABEL = "coalesce(comment, concat('EA ', magic_number))"

# Every buffer is fixed width, so this hash-aggregates.
_STATISTICS = [
    "count(1) AS n",
    "count(net_profit) AS n_net",
    "count_if(is_win) AS n_win",
    "count(CASE WHEN NOT is_win THEN net_profit END) AS n_loss_net",
    "sum(net_profit) AS net",
    "sum(CASE WHEN is_win THEN net_profit END) AS win_net",
    "sum(CASE WHEN NOT is_win THEN net_profit END) AS loss_net",
    "max(net_profit) AS best",
    "min(net_profit) AS worst",
    "sum(commission) AS commissions",
    "sum(swap) AS swaps",
    "count(duration_min) AS n_timed",
    "avg(duration_min) AS duration",
    "stddev_samp(cast(net_profit AS DOUBLE)) AS std",
    "count_if(net_profit < 0) AS n_down",
    "sum(CASE WHEN net_profit < 0 THEN net_profit END) AS down_net",
    "stddev_samp(CASE WHEN net_profit < 0 THEN cast(net_profit AS DOUBLE) END) AS down_std",
    "min(open_time) AS first_open",
    "max(close_time) AS last_close",
]
STATS_FIELDS = [text.rsplit(" ", 1)[1] for text in _STATISTICS]


def trade_stats(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of a key."""
    return prepared.groupBy(*keys).agg(*[F.expr(e) for e in _STATISTICS])


def with_squares(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of trade_stats with their sums of squares around the common mean of their key."""
    whole = f"OVER (PARTITION BY {listed(keys)})"

    def around_common_mean(count: str, total: str, std: str) -> str:
        own = f"cast({total} AS DOUBLE) / nullif({count}, 0)"
        shared = f"cast(sum({total}) {whole} AS DOUBLE) / nullif(sum({count}) {whole}, 0)"
        return (
            f"coalesce({std} * {std} * ({count} - 1), 0D) + "
            f"coalesce({count} * pow({own} - {shared}, 2), 0D)"
        )

    return parts.selectExpr(
        "*",
        f"{around_common_mean('n_net', 'net', 'std')} AS squares",
        f"{around_common_mean('n_down', 'down_net', 'down_std')} AS down_squares",
    )


def _std(count: str, squares: str) -> str:
    return f"CASE WHEN sum({count}) > 1 THEN sqrt(sum({squares}) / (sum({count}) - 1)) END"


STATS_COUNTS = ["n", "n_net", "n_win", "n_loss_net", "n_down", "n_timed"]
STATS_SUMS = ["net", "win_net", "loss_net", "down_net", "commissions", "swaps"]
# over the rows of ``with_squares``: statistics of disjoint trade sets as those of their union
FOLDED_STATS = [
    *[f"sum({c}) AS {c}" for c in STATS_COUNTS],
    *[f"cast(sum({c}) AS DECIMAL(38,4)) AS {c}" for c in STATS_SUMS],
    "max(best) AS best",
    "min(worst) AS worst",
    "CASE WHEN sum(n_timed) > 0 THEN sum(duration * n_timed) / sum(n_timed) END AS duration",
    f"{_std('n_net', 'squares')} AS std",
    f"{_std('n_down', 'down_squares')} AS down_std",
    "min(first_open) AS first_open",
    "max(last_close) AS last_close",
]


# --- expressions over the columns of trade_stats -------------------------------------------

_MEANS = [
    "n - n_win AS n_loss",
    "coalesce(win_net, 0) AS gross_win",
    "abs(coalesce(loss_net, 0)) AS gross_fall",
    # NULL if no trade has a net
    "CASE WHEN n_net > 0 THEN cast(net AS DOUBLE) / n_net END AS mean",
    f"{ratio('win_net', 'n_win', '0')} AS mean_win",
    # 0 without losing trades; NULL if none of them has a net
    "CASE WHEN n = n_win THEN 0D WHEN n_loss_net > 0 "
    "THEN cast(loss_net AS DOUBLE) / n_loss_net END AS mean_loss",
]


def _raw(risk_free_rate: float) -> list[str]:
    rate = f"cast({risk_free_rate!r} AS DOUBLE)"
    downside = "n >= 2 AND n_down >= 2 AND down_std > 0"
    return [
        f"{ratio('n_win * 100D', 'n', '0')} AS raw_win_rate",
        f"{ratio('gross_win', 'gross_fall', INF)} AS raw_factor",
        f"CASE WHEN mean_loss = 0 THEN {INF} ELSE abs(mean_win / mean_loss) END AS raw_payoff",
        # one missing net makes Sharpe 0, and Sortino undefined unless its denominator is 0
        f"CASE WHEN n >= 2 AND n = n_net AND std > 0 THEN (mean - {rate}) / std ELSE 0D END "
        "AS raw_sharpe",
        f"CASE WHEN {downside} AND n = n_net THEN (mean - {rate}) / down_std "
        f"WHEN {downside} THEN NULL ELSE 0D END AS raw_sortino",
        "cast(n_win AS DOUBLE) / n * mean_win + cast(n_loss AS DOUBLE) / n * mean_loss "
        "AS raw_expectancy",
        f"CASE WHEN mean = 0 THEN {INF} ELSE abs(std / mean) END AS raw_variation",
    ]


def with_ratios(stats: DataFrame, risk_free_rate: float = 0.0) -> DataFrame:
    """Add the unrounded means and ratios the figures below are taken from."""
    return stats.selectExpr("*", *_MEANS).selectExpr("*", *_raw(risk_free_rate))


def _rounded(places: int, pairs: dict[str, str]) -> list[str]:
    return [f"{half_even(value, places)} AS {name}" for name, value in pairs.items()]


BASIC = [
    "n AS total_trades",
    "n_win AS winning_trades",
    "n_loss AS losing_trades",
    *_rounded(2, {"win_rate_pct": "raw_win_rate"}),
    *_rounded(4, {"profit_factor": "raw_factor"}),
    *_rounded(
        2,
        {
            "total_net_profit": "coalesce(net, 0)",
            "gross_profit": "gross_win",
            "gross_loss": "gross_fall",
            "avg_win": "mean_win",
            "avg_loss": "mean_loss",
            "avg_trade": "mean",
            "best_trade": "best",
            "worst_trade": "worst",
        },
    ),
    *_rounded(4, {"payoff_ratio": "raw_payoff"}),
    *_rounded(
        2,
        {
            "total_commissions": "coalesce(commissions, 0)",
            "total_swaps": "coalesce(swaps, 0)",
            "avg_duration_min": "duration",
        },
    ),
]
RISK = _rounded(4, {"sharpe_ratio": "raw_sharpe", "sortino_ratio": "raw_sortino"})
_PER_UNIT = (
    "CASE WHEN mean_loss IS NULL THEN 0D WHEN mean_loss = 0 THEN raw_expectancy "
    "ELSE raw_expectancy / abs(mean_loss) END"
)
EXPECTANCY = _rounded(
    4,
    {
        "expectancy": "raw_expectancy",
        "expectancy_per_dollar": _PER_UNIT,
        "profit_std_dev": "std",
        "coefficient_of_variation": "raw_variation",
    },
)


def basic_metrics(prepared: DataFrame, keys: list[str]) -> DataFrame:
    return with_ratios(trade_stats(prepared, keys)).selectExpr(*quoted(keys), *BASIC)


def risk_ratios(prepared: DataFrame, keys: list[str], risk_free_rate: float = 0.0) -> DataFrame:
    """Sharpe and Sortino per trade, not annualised."""
    stats = with_ratios(trade_stats(prepared, keys), risk_free_rate)
    return stats.selectExpr(*quoted(keys), *RISK)


def expectancy(prepared: DataFrame, keys: list[str]) -> DataFrame:
    return with_ratios(trade_stats(prepared, keys)).selectExpr(*quoted(keys), *EXPECTANCY)


def date_range(prepared: DataFrame, keys: list[str]) -> DataFrame:
    return prepared.groupBy(*keys).agg(
        F.expr("count(1) AS trade_count"),
        F.expr("min(open_time) AS date_from"),
        F.expr("max(close_time) AS date_to"),
    )


def first_comment(prepared: DataFrame, keys: list[str]) -> DataFrame:
    """First non-missing comment in close order; keys without any are absent.

    The first instant of a key is a fixed-width buffer, so no trade is sorted for it; only the
    trades of that instant are compared by id.
    """
    commented = prepared.where("comment IS NOT NULL").select(*keys, "close_time", "id", "comment")
    first = commented.groupBy(*keys).agg(F.expr("min(close_time) AS close_time"))
    return (
        join_on_keys(commented, first, [*keys, "close_time"], "left_semi")
        .groupBy(*keys)
        .agg(F.expr("min_by(comment, id) AS comment"))
    )


def strategy_labels(prepared: DataFrame) -> DataFrame:
    """magic_number, comment and display name ``EA <magic>`` where no comment exists."""
    keys = ["magic_number"]
    every = prepared.select(*keys).distinct()
    return join_on_keys(every, first_comment(prepared, keys), keys, "left").selectExpr(
        "*", f"{LABEL} AS ea_name"
    )
