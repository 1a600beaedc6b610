"""Trade and account scans."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeledger.operators.enrich import IS_CLOSED, with_strategy
from tapeledger.schema import ACCOUNTS, INBOUND, SCAN_COLUMNS, TRADES


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Stored trades; written by sources.sinks, partitioned by close_month."""
    return spark.read.parquet(path)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCOUNTS).parquet(path)


def read_inbound(spark: SparkSession, path: str) -> DataFrame:
    """Inbound records as JSON lines."""
    return spark.read.schema(INBOUND).json(path)


def stream_inbound(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(INBOUND)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def read_trades_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], low_id: int, high_id: int, parts: int
) -> DataFrame:
    """Trades from a relational store, read in ``parts`` slices of the id range."""
    columns = ", ".join(f.name for f in TRADES.fields)
    return spark.read.jdbc(
        url,
        f"(SELECT {columns} FROM trades_raw) t",
        column="id",
        lowerBound=low_id,
        upperBound=high_id,
        numPartitions=parts,
        properties=properties,
    )


def _timestamp(moment):
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    elif isinstance(moment, date) and not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return moment


def load_trades(
    trades: DataFrame,
    magic_number: int | None = None,
    symbol: str | None = None,
    date_from=None,
    date_to=None,
    only_closed: bool = True,
    account_id: int | None = None,
) -> DataFrame:
    """Filtered trades. Date bounds include their instant; a plain date means its midnight.

    The conditions stay on plain columns, so they reach the Parquet scan; where the table is
    partitioned by close_month, the date bounds also prune its folders.
    """
    out = trades
    if only_closed:
        out = out.where(IS_CLOSED)
    if magic_number is not None:
        out = out.where(F.col("magic_number") == magic_number)
    if account_id is not None:
        out = out.where(F.col("account_id") == account_id)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol.upper())
    by_month = "close_month" in trades.columns
    for moment, lower in ((_timestamp(date_from), True), (_timestamp(date_to), False)):
        if moment is None:
            continue
        limit = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        month = F.lit(moment.strftime("%Y-%m"))
        out = out.where(F.col("close_time") >= limit if lower else F.col("close_time") <= limit)
        if by_month:
            out = out.where(
                F.col("close_month") >= month if lower else F.col("close_month") <= month
            )
    return out


def scan(trades: DataFrame, **filters) -> DataFrame:
    """load_trades with the columns of a stored trade."""
    return load_trades(trades, **filters).select(*SCAN_COLUMNS)


def closed_strategy_trades(trades: DataFrame, **filters) -> DataFrame:
    """What every per-strategy figure is computed over."""
    return with_strategy(load_trades(trades, **filters))
