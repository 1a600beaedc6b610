"""The given star-schema tables read as trades, accounts and inbound records.

A line item is a trade, its supplier the account, its part the strategy. All money arithmetic is
in whole 1e-4 units, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeledger.session import spread_small_input

STRATEGIES = 41


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_input(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")


def _whole(value: str) -> str:
    """A two-decimal double in whole hundredths."""
    return f"cast(rint({value} * 100) AS BIGINT)"


def _money(units: str) -> str:
    """Whole 1e-4 units as money."""
    return f"cast(cast({units} AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4))"


def _price(micros: str) -> str:
    return f"cast(cast({micros} AS DECIMAL(18,0)) * 0.000001BD AS DECIMAL(18,6))"


CENTS = _whole("l_extendedprice")
TAX = _whole("l_tax")
DISCOUNT = _whole("l_discount")
QUANTITY = "cast(l_quantity AS BIGINT)"
NO_PRICE = "l_linestatus = 'O' AND l_linenumber = 7"
STILL_OPEN = "l_linestatus = 'O' AND l_linenumber = 6"
TICKET = "l_orderkey * 10 + l_linenumber"

TRADE = [
    f"named_struct('ticket', {TICKET}, 'part', l_partkey, 'supp', l_suppkey, 'cents', {CENTS}) AS id",
    "l_suppkey AS account_id",
    f"{TICKET} AS ticket",
    f"nullif(l_partkey % {STRATEGIES}, 0L) AS magic_number",
    "CASE WHEN l_returnflag <> 'N' THEN concat('EA_', l_returnflag) END AS comment",
    "concat('SYM', l_linenumber) AS symbol",
    "CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS order_type",
    "cast(l_quantity AS DECIMAL(18,4)) AS volume",
    f"{_price(f'{CENTS} * 5000 div {QUANTITY}')} AS open_price",
    f"{_price(f'CASE WHEN {NO_PRICE} THEN 0 ELSE {CENTS} * 10000 div {QUANTITY} END')} AS close_price",
    "cast(NULL AS DECIMAL(18,4)) AS stop_loss",
    "cast(NULL AS DECIMAL(18,4)) AS take_profit",
    "timestampadd(MINUTE, cast(l_quantity * -37 AS INT), l_shipdate) AS open_time",
    f"CASE WHEN NOT ({STILL_OPEN}) THEN timestampadd(MINUTE, "
    "cast((l_partkey * 61 + l_linenumber * 7) % 1440 AS INT), l_shipdate) END AS close_time",
    f"{_money(f'{CENTS} * ({TAX} - {DISCOUNT})')} AS profit",
    f"CASE WHEN {TAX} <> 0 THEN {_money(f'{QUANTITY} * -700')} END AS commission",
    f"{_money(f'{DISCOUNT} * -100')} AS swap",
    "timestampadd(MINUTE, 1, l_shipdate) AS received_at",
]


def as_trades(items: DataFrame) -> DataFrame:
    return items.selectExpr(*TRADE)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_trades(lineitem(spark, sf_dir))


def full_fee_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only trades that carry a commission: no missing nets, so Sharpe is not forced to 0."""
    return trades(spark, sf_dir).where("commission IS NOT NULL")


def _api_key(account: str) -> str:
    return f"md5(cast(concat('Customer#', lpad(cast({account} AS STRING), 9, '0')) AS BINARY))"


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "concat('Broker ', c_nationkey) AS broker",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Propfirm' WHEN 'BUILDING' THEN 'Broker' "
        "WHEN 'HOUSEHOLD' THEN 'Personal' END AS type",
        "'MT5' AS platform",
        "CASE c_nationkey % 5 WHEN 0 THEN 'Fondeada' WHEN 1 THEN 'Fase 1' WHEN 2 THEN 'Fase 2' "
        "WHEN 3 THEN '' END AS phase",
        "cast(greatest(c_acctbal, 0D) AS DECIMAL(18,4)) AS initial_balance",
        f"{_api_key('c_custkey')} AS api_key",
        "c_mktsegment <> 'MACHINERY' AS is_active",
        "timestampadd(DAY, cast(c_custkey % 3650 AS INT), timestamp_ntz'2020-01-01') AS created_at",
    )


def as_inbound(items: DataFrame) -> DataFrame:
    """Line items as raw inbound text records, some of them faulty on purpose.

    Line number 7 with flag A carries an unknown order type, quantity 13 an unreadable volume,
    discount 0 with line number 5 no symbol, line number 4 with flag R an unknown key, and quantity
    17 a profit of five decimals. Valid, but written differently: line number 3 has an opening price
    of eight decimals, line number 2 an opening time with an offset, line number 1 a magic number
    with a decimal point.
    """
    texts = [
        "ticket", "close_price", "close_time", "stop_loss", "take_profit", "commission", "swap",
    ]
    return items.selectExpr(*TRADE, "l_linenumber AS line", "l_returnflag AS flag").selectExpr(
        f"CASE WHEN line = 4 AND flag = 'R' THEN 'unknown' ELSE {_api_key('account_id')} END AS api_key",
        "CASE WHEN NOT (line = 5 AND swap = 0) THEN symbol END AS symbol",
        "CASE WHEN line = 7 AND flag = 'A' THEN 'hold' WHEN flag = 'N' THEN 'buy' "
        "ELSE order_type END AS order_type",
        "CASE WHEN volume = 13 THEN 'n/a' ELSE cast(volume AS STRING) END AS volume",
        "CASE WHEN line = 3 THEN concat(open_price, '12') ELSE cast(open_price AS STRING) END AS open_price",
        "CASE WHEN line = 2 THEN concat(timestampadd(HOUR, 2, open_time), '+02:00') "
        "ELSE cast(open_time AS STRING) END AS open_time",
        "CASE WHEN volume = 17 THEN concat(profit, '1') ELSE cast(profit AS STRING) END AS profit",
        "CASE WHEN line = 1 THEN concat(magic_number, '.0') ELSE cast(magic_number AS STRING) END AS magic_number",
        "coalesce(comment, '') AS comment",
        "received_at",
        *[f"cast({c} AS STRING) AS {c}" for c in texts],
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_inbound(lineitem(spark, sf_dir))
