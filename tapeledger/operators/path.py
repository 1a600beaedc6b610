"""Drawdown, streak and curve operators over the ordered passes.

``initial`` is the initial balance: a number, or SQL text over the key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import INF, half_even, listed, quoted, ratio
from tapeledger.operators.enrich import iso_day, iso_time
from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy, path_figures, path_rows

INITIAL_BALANCE = 10_000.0


def balance(initial: float | str) -> str:
    return f"cast({initial if isinstance(initial, str) else repr(str(initial))} AS DECIMAL(18,4))"


def with_drawdown(figures: DataFrame, initial: float | str = INITIAL_BALANCE) -> DataFrame:
    """Add the rounded drawdown and return percentages, which Calmar is taken from."""
    share = (
        "CASE WHEN top <> 0 THEN cast(depth AS DOUBLE) / cast(top AS DOUBLE) * 100 "
        f"WHEN depth > 0 THEN {INF} END"
    )
    growth = (
        "CASE WHEN start <> 0 THEN gain / cast(start AS DOUBLE) * 100 "
        f"WHEN gain > 0 THEN {INF} WHEN gain < 0 THEN -{INF} END"
    )
    return (
        figures.selectExpr(
            "*",
            f"{balance(initial)} AS start",
            "CASE WHEN NOT last_missing THEN cast(total AS DOUBLE) END AS gain",
        )
        .selectExpr("*", "start + peak_at_depth AS top")
        .selectExpr("*", f"{share} AS raw_depth_pct", f"{growth} AS raw_return_pct")
        .selectExpr(
            "*",
            f"{half_even('raw_depth_pct', 2)} AS depth_pct",
            f"{half_even('raw_return_pct', 2)} AS growth_pct",
        )
        .selectExpr(
            "*",
            f"{ratio('total', 'depth', INF)} AS raw_recovery",
            f"CASE WHEN depth_pct > 0 THEN growth_pct / depth_pct ELSE {INF} END AS raw_calmar",
            "CASE WHEN NOT last_missing THEN start + total END AS end_balance",
        )
    )


DRAWDOWN = [
    f"{half_even('depth', 2)} AS max_drawdown_usd",
    "depth_pct AS max_drawdown_pct",
    f"{half_even('raw_recovery', 4)} AS recovery_factor",
    "cast(start AS DOUBLE) AS initial_balance",
    f"{half_even('end_balance', 2)} AS final_balance",
    "growth_pct AS return_pct",
    f"{half_even('raw_calmar', 4)} AS calmar_ratio",
]
STREAKS = [
    "max_win_run AS max_consecutive_wins",
    "max_loss_run AS max_consecutive_losses",
    "current_run AS current_streak",
    "current_type AS current_streak_type",
]


def drawdown(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    figures = with_drawdown(path_figures(prepared, keys, policy), initial)
    return figures.selectExpr(*quoted(keys), *DRAWDOWN)


def streaks(
    prepared: DataFrame, keys: list[str], policy: ChunkPolicy = DEFAULT_POLICY
) -> DataFrame:
    return path_figures(prepared, keys, policy).selectExpr(*quoted(keys), *STREAKS)


def streak_runs(
    prepared: DataFrame, keys: list[str], policy: ChunkPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Every uninterrupted run of wins or losses: where it starts and how long it is."""
    rows = path_rows(prepared, keys, policy=policy)
    return (
        rows.withColumnRenamed("run_start", "start_seq")
        .groupBy(*keys, "start_seq", "is_win")
        .agg(F.expr("count(1) AS length"))
    )


def equity_curve(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One chart point per trade: seq, ISO time, equity at 2 dp (NULL where the net is NULL)."""
    return path_rows(prepared, keys, policy=policy).selectExpr(
        *quoted(keys),
        "seq",
        f"{iso_time('close_time')} AS time",
        f"cast(bround({balance(initial)} + equity, 2) AS DOUBLE) AS equity",
    )


def drawdown_series(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    start = balance(initial)
    return path_rows(prepared, keys, policy=policy).selectExpr(
        *quoted(keys),
        "seq",
        f"{iso_time('close_time')} AS time",
        f"{start} + equity AS equity",
        f"{start} + peak AS peak",
        "equity - peak AS drawdown",
    )


def curve_header(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = INITIAL_BALANCE,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Balance before and after the curve, and its number of points."""
    start = balance(initial)
    final = f"CASE WHEN NOT last_missing THEN {start} + total END"
    return path_figures(prepared, keys, policy).selectExpr(
        *quoted(keys),
        f"cast({start} AS DOUBLE) AS initial_balance",
        f"cast(bround({final}, 2) AS DOUBLE) AS final_balance",
        "n AS data_points",
    )


def curve_sample(
    prepared: DataFrame,
    keys: list[str],
    initial: float | str = INITIAL_BALANCE,
    points: int = 10,
    policy: ChunkPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Every (n div points)-th point of a curve from the first on, of these the last ``points``."""
    step = f"greatest(1, n_total div {points})"
    return (
        path_rows(prepared, keys, policy=policy)
        .where(
            f"(seq - 1) % {step} = 0 AND (seq - 1) div {step} >= ceil(n_total / {step}) - {points}"
        )
        .selectExpr(
            *quoted(keys),
            "seq",
            f"{iso_day('close_time')} AS day",
            f"cast(bround({balance(initial)} + equity, 2) AS DOUBLE) AS equity",
        )
    )


def curve_levels(sample: DataFrame, keys: list[str], height: int = 30) -> DataFrame:
    """Scale each sample to 0..height and compare it with the first one of its key."""
    whole = f"OVER (PARTITION BY {listed(keys)})"
    in_order = f"OVER (PARTITION BY {listed(keys)} ORDER BY seq)"
    spread = "CASE WHEN high <> low THEN high - low ELSE 1D END"
    return sample.selectExpr(
        "*",
        f"min(equity) {whole} AS low",
        f"max(equity) {whole} AS high",
        f"first(equity) {in_order} AS opening",
    ).selectExpr(
        *quoted(keys),
        "seq",
        "day",
        "equity",
        f"floor((equity - low) / ({spread}) * {height}) AS level",
        "CASE WHEN equity >= opening THEN 'up' ELSE 'down' END AS direction",
    )
