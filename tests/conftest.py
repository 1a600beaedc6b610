import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from tapeledger.schema import ACCOUNTS, INBOUND, TRADES  # noqa: E402
from tapeledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", memory="4g")


def moment(text):
    return datetime.fromisoformat(text) if isinstance(text, str) else text


def _money(value):
    return None if value is None else Decimal(str(value))


@pytest.fixture(scope="session")
def make_trades(spark):
    """Trades from short dicts; ids and tickets count up, closes are one hour apart."""

    def build(rows):
        out = []
        for i, row in enumerate(rows, start=1):
            full = {
                "id": i, "account_id": 1, "ticket": i, "magic_number": 7, "comment": None,
                "symbol": "EURUSD", "order_type": "BUY", "volume": 1, "open_price": 1,
                "close_price": 1, "stop_loss": None, "take_profit": None,
                "open_time": "2024-01-01T00:00:00",
                "close_time": f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00:00",
                "profit": 0, "commission": 0, "swap": 0, "received_at": "2024-02-01T00:00:00",
            } | row
            for name in ("volume", "open_price", "close_price", "stop_loss", "take_profit",
                         "profit", "commission", "swap"):
                full[name] = _money(full[name])
            for name in ("open_time", "close_time", "received_at"):
                full[name] = moment(full[name])
            out.append(tuple(full[f.name] for f in TRADES.fields))
        return spark.createDataFrame(out, TRADES)

    return build


@pytest.fixture(scope="session")
def make_accounts(spark):
    def build(rows):
        out = []
        for row in rows:
            full = {
                "name": f"A{row['id']}", "broker": None, "type": None, "platform": "MT5",
                "phase": None, "initial_balance": Decimal(0), "api_key": f"key{row['id']}",
                "is_active": True, "created_at": datetime(2024, 1, row["id"]),
            } | row
            out.append(tuple(full[f.name] for f in ACCOUNTS.fields))
        return spark.createDataFrame(out, ACCOUNTS)

    return build


@pytest.fixture(scope="session")
def make_inbound(spark):
    def build(rows):
        out = []
        for i, row in enumerate(rows, start=1):
            full = {
                "api_key": "key1", "ticket": str(i), "symbol": "EURUSD", "order_type": "buy",
                "volume": "0.1", "open_price": "1.1", "close_price": "1.2",
                "open_time": "2024-01-01 00:00:00", "close_time": f"2024-01-02 {i % 24:02d}:00:00",
                "profit": "5.5", "commission": "-0.5", "swap": "0", "magic_number": "7",
                "comment": "", "received_at": datetime(2024, 1, 3, i % 24),
            } | row
            out.append(tuple(full.get(f.name) for f in INBOUND.fields))
        return spark.createDataFrame(out, INBOUND)

    return build
