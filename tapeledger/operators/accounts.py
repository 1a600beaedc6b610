"""Live account figures and account maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeledger.functions.numeric import half_up, ratio
from tapeledger.operators.enrich import BADGE_CLASS, BADGE_LABEL, IS_CLOSED, LIVE_NET
from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy, running_total_by_time
from tapeledger.schema import ACCOUNT_DEFAULTS

ACCOUNT_COLUMNS = [
    "id", "name", "broker", "type", "platform", "phase", "initial_balance", "created_at",
]
# live win rate: a win is a positive gross profit
_WIN_RATE = ratio("wins * 100D", "total_trades", "0")


def _agg(grouped, *expressions: str) -> DataFrame:
    return grouped.agg(*[F.expr(e) for e in expressions])


def active_accounts(accounts: DataFrame, account_id: int | None = None) -> DataFrame:
    out = accounts.where("is_active")
    return out if account_id is None else out.where(F.col("id") == account_id)


def account_overview(accounts: DataFrame, trades: DataFrame) -> DataFrame:
    """Active accounts with live figures; accounts without trades stay, with zeros.

    Trades are aggregated before the join, so the join moves one row per account.
    """
    per_account = _agg(
        trades.groupBy("account_id"),
        "count(1) AS n",
        "sum(profit) AS gross",
        f"sum({LIVE_NET}) AS net",
        "count_if(profit > 0) AS wins",
        "coalesce(sum(CASE WHEN profit > 0 THEN profit END), 0) AS rise",
        "sum(CASE WHEN profit < 0 THEN -profit END) AS fall",
    )
    return (
        active_accounts(accounts)
        .join(per_account, F.expr("id = account_id"), "left")
        .selectExpr(
            "*",
            "coalesce(n, 0L) AS total_trades",
            "coalesce(gross, 0) AS total_profit",
            "coalesce(net, 0) AS net_profit",
            f"{ratio('rise', 'fall')} AS factor",
        )
        .selectExpr(
            *ACCOUNT_COLUMNS,
            "total_trades",
            "total_profit",
            "net_profit",
            f"{half_up(_WIN_RATE, 2)} AS winrate",
            f"{half_up('factor', 2)} AS profit_factor",
        )
    )


def account_strategies(trades: DataFrame) -> DataFrame:
    """Live figures per strategy of an account; trades without a strategy form a group."""
    return _agg(
        trades.groupBy("account_id", "magic_number"),
        "count(1) AS total_trades",
        "coalesce(sum(profit), 0) AS total_profit",
        "count_if(profit > 0) AS wins",
    ).selectExpr(
        "account_id", "magic_number", "total_trades", "total_profit",
        f"{half_up(_WIN_RATE, 2)} AS winrate",
    )


def strategy_totals(strategies: DataFrame) -> DataFrame:
    """Account page: totals and the unweighted mean win rate over its strategies."""
    mean = "cast(sum(cast(winrate AS DECIMAL(9,2))) AS DOUBLE) / count(1)"
    return _agg(
        strategies.groupBy("account_id"),
        "sum(total_profit) AS total_profit",
        "sum(total_trades) AS total_trades",
        f"{half_up(mean, 1)} AS avg_winrate",
        "count(1) AS strategies",
    )


def dashboard_totals(overview: DataFrame) -> DataFrame:
    """Dashboard: totals over accounts. The mean win rate counts accounts without trades as 0,
    the mean profit factor skips accounts that have none."""
    totals = _agg(
        overview.groupBy(),
        "coalesce(sum(net_profit), 0) AS total_pnl",
        "coalesce(sum(total_trades), 0L) AS total_trades",
        "sum(cast(winrate AS DECIMAL(9,2))) AS rates",
        "count(1) AS accounts",
        "sum(cast(profit_factor AS DECIMAL(28,2))) AS factors",
        "count(profit_factor) AS with_factor",
    )
    return totals.selectExpr(
        "total_pnl",
        "total_trades",
        f"{half_up(ratio('rates', 'accounts'), 1)} AS avg_winrate",
        f"{half_up(ratio('factors', 'with_factor'), 2)} AS avg_profit_factor",
    )


def account_equity_curve(trades: DataFrame, policy: ChunkPolicy = DEFAULT_POLICY) -> DataFrame:
    """Cumulative gross profit per account; trades closing at the same time share a value.

    (account_id, date, id) is the order of the curve."""
    rows = trades.select("account_id", "close_time", "id", "profit")
    return running_total_by_time(rows, ["account_id"], "profit", policy=policy).selectExpr(
        "account_id", "id", "close_time AS date", "profit", "cumulative AS cumulative_profit"
    )


def curve_range(curve: DataFrame) -> DataFrame:
    """Axis range of each account's curve: extremes with a margin of 5 %."""
    return _agg(
        curve.groupBy("account_id"),
        "min(cumulative_profit) - abs(min(cumulative_profit)) * 0.05 AS range_low",
        "max(cumulative_profit) + abs(max(cumulative_profit)) * 0.05 AS range_high",
    )


def strategy_catalog(trades: DataFrame) -> DataFrame:
    """Every strategy with closed trades, and the group of trades without one."""
    return _agg(
        trades.where(IS_CLOSED).groupBy("magic_number"),
        "count(1) AS total_trades",
        "min(close_time) AS first_trade",
        "max(close_time) AS last_trade",
        f"sum({LIVE_NET}) AS net_profit",
    )


def symbols(trades: DataFrame, magic_number: int | None = None) -> DataFrame:
    """Distinct symbols, of all trades or of one strategy; open trades count."""
    if magic_number is not None:
        trades = trades.where(F.col("magic_number") == magic_number)
    return trades.select("symbol").distinct()


def strategy_symbols(trades: DataFrame) -> DataFrame:
    return trades.select("magic_number", "symbol").distinct()


def badges(accounts: DataFrame) -> DataFrame:
    return accounts.selectExpr("id", f"{BADGE_LABEL} AS label", f"{BADGE_CLASS} AS badge")


def new_accounts(records: DataFrame) -> DataFrame:
    """Account records with the defaults filled in, active, ready to append.

    The caller supplies id, api_key and created_at.
    """
    platform, opening = ACCOUNT_DEFAULTS["platform"], ACCOUNT_DEFAULTS["initial_balance"]
    return records.withColumns(
        {
            "platform": F.expr(f"coalesce(platform, '{platform}')"),
            "initial_balance": F.expr(f"coalesce(initial_balance, cast({opening} AS DECIMAL(18,4)))"),
            "is_active": F.lit(True),
        }
    )


_KNOWN_TYPE = "(type IS NULL OR type IN ('Propfirm', 'Broker', 'Personal'))"


def append_accounts(accounts: DataFrame, records: DataFrame) -> DataFrame:
    """Accounts plus the valid new records (a name, and a known type or none)."""
    valid = records.where(f"name IS NOT NULL AND {_KNOWN_TYPE}")
    return accounts.unionByName(new_accounts(valid).select(*accounts.columns))


def account_rejects(records: DataFrame) -> DataFrame:
    """The records append_accounts leaves out, with the reasons."""
    reasons = (
        "array_compact(array(CASE WHEN name IS NULL THEN 'name: missing' END, "
        f"CASE WHEN NOT {_KNOWN_TYPE} THEN 'type: unknown' END)) AS reject_reason"
    )
    return records.selectExpr("*", reasons).where("size(reject_reason) > 0")


def deactivate(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: is_active becomes false for the given ids."""
    hit = ids.selectExpr("id AS __hit").distinct()
    return (
        accounts.join(hit, F.expr("id = __hit"), "left")
        .withColumn("is_active", F.expr("CASE WHEN __hit IS NOT NULL THEN false ELSE is_active END"))
        .drop("__hit")
    )


def missing_accounts(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that no account has."""
    return ids.select("id").distinct().join(accounts.select("id"), "id", "left_anti")
