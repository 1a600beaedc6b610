"""Record layouts of the trades, accounts and snapshot tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
# prices and volumes of any instrument, down to those quoted with twelve decimals
PRICE = T.DecimalType(28, 12)

# total order of one strategy's trades: close time, then storage sequence
TRADE_ORDER = ("close_time", "id")

TRADES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("ticket", T.LongType()),
        T.StructField("magic_number", T.LongType()),
        T.StructField("comment", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("order_type", T.StringType()),
        T.StructField("volume", PRICE),
        T.StructField("open_price", PRICE),
        T.StructField("close_price", PRICE),
        T.StructField("stop_loss", PRICE),
        T.StructField("take_profit", PRICE),
        T.StructField("open_time", T.TimestampNTZType()),
        T.StructField("close_time", T.TimestampNTZType()),
        T.StructField("profit", MONEY),
        T.StructField("commission", MONEY),
        T.StructField("swap", MONEY),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)

# Columns a trade scan returns (account_id only selects, it is not read back)
SCAN_COLUMNS = [
    "id", "ticket", "magic_number", "comment", "symbol", "order_type", "volume", "open_price",
    "close_price", "stop_loss", "take_profit", "open_time", "close_time", "profit", "commission",
    "swap", "received_at",
]

ACCOUNTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("broker", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("initial_balance", MONEY),
        T.StructField("api_key", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

# Fixed names. An inbound trade as text, so that one bad field rejects one record and not the file.
INBOUND_FIELDS = {
    "ticket": T.LongType(),
    "symbol": T.StringType(),
    "order_type": T.StringType(),
    "volume": PRICE,
    "open_price": PRICE,
    "close_price": PRICE,
    "open_time": T.TimestampNTZType(),
    "close_time": T.TimestampNTZType(),
    "profit": MONEY,
    "stop_loss": PRICE,
    "take_profit": PRICE,
    "commission": MONEY,
    "swap": MONEY,
    "magic_number": T.LongType(),
    "comment": T.StringType(),
}
INBOUND_REQUIRED = [
    "ticket", "symbol", "order_type", "volume", "open_price", "close_price", "open_time",
    "close_time", "profit",
]
INBOUND = T.StructType(
    [T.StructField("api_key", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in INBOUND_FIELDS]
    + [T.StructField("received_at", T.TimestampNTZType())]
)

ACCOUNT_DEFAULTS = {"platform": "MT5", "initial_balance": 0.0}

SNAPSHOT_KEY = ["magic_number", "snapshot_date"]
# Fixed names, in the order of the stored table.
SNAPSHOT_COLUMNS = [
    "magic_number", "snapshot_date", "total_trades", "winning_trades", "losing_trades",
    "win_rate_pct", "profit_factor", "total_net_profit", "gross_profit", "gross_loss", "avg_win",
    "avg_loss", "avg_trade", "best_trade", "worst_trade", "payoff_ratio", "max_drawdown_usd",
    "max_drawdown_pct", "recovery_factor", "sharpe_ratio", "sortino_ratio", "calmar_ratio",
    "expectancy", "initial_balance", "final_balance", "return_pct",
]
# Fixed names: the columns a second snapshot of the same day refreshes; the others keep their first value
SNAPSHOT_REFRESHED = [
    "total_trades", "win_rate_pct", "profit_factor", "total_net_profit", "max_drawdown_pct",
    "sharpe_ratio", "return_pct", "final_balance",
]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
