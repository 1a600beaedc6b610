"""Validation, account lookup, duplicates, and the stream against the batch."""

from datetime import datetime
from decimal import Decimal

import pytest

from tapeledger.operators import ingest as I
from tapeledger.operators.enrich import prepare
from tapeledger.plans.reports import full_metrics
from tapeledger.sources.sinks import read_store
from tapeledger.sources.trades import closed_strategy_trades, stream_inbound
from tapeledger.streaming import running
from tapeledger.streaming.ingest import IngestJob, current_metrics, dedupe_within

KEY = ["magic_number"]


def by_ticket(df):
    return {r.ticket: r for r in df.collect()}


def test_validation(make_inbound):
    rows = by_ticket(
        I.validate(
            make_inbound(
                [
                    {},
                    {"order_type": "hold"},
                    {"symbol": None},
                    {"volume": "x", "profit": None},
                    {"swap": "none"},
                    {"swap": None, "comment": "EA one", "order_type": "Sell"},
                    {"order_type": None},
                ]
            )
        )
    )
    assert rows[1].order_type == "BUY" and rows[1].comment is None and rows[1].reject_reason == []
    assert rows[2].reject_reason == ["order_type: neither BUY nor SELL"]
    assert rows[3].reject_reason == ["symbol: missing"]
    assert rows[4].reject_reason == ["volume: not a number", "profit: missing"]
    assert rows[5].reject_reason == ["swap: not a number"]
    assert rows[6].reject_reason == [] and rows[6].comment == "EA one" and rows[6].order_type == "SELL"
    assert rows[7].reject_reason == ["order_type: missing"]
    assert [t for t, r in rows.items() if r.is_valid] == [1, 6]


def test_nothing_is_rounded_on_the_way_in(make_inbound):
    """A value is stored as it was sent, or the record is refused."""
    rows = by_ticket(
        I.validate(
            make_inbound(
                [
                    {"close_price": "0.00000012", "volume": "1e-7", "stop_loss": "1.08345"},
                    {"profit": "1.00005"},
                    {"profit": "1.50000", "commission": "-2.5e-1"},
                    {"close_price": "0.0000000000001"},
                    {"open_time": "2024-01-01T10:00:00+02:00", "close_time": "2024-01-01T10:00:00Z"},
                    {"ticket": "6.0", "magic_number": "7.50"},
                    {"ticket": "7.0", "magic_number": "70e0"},
                    {"volume": "1e30", "profit": "NaN"},
                    {"open_time": "2024-13-01T10:00:00+02:00"},
                ]
            )
        )
    )
    assert rows[1].is_valid and rows[1].close_price == Decimal("0.00000012")
    assert rows[1].volume == Decimal("1e-7") and rows[1].stop_loss == Decimal("1.08345")
    assert rows[2].reject_reason == ["profit: more than 4 decimals"]
    assert rows[3].is_valid and (rows[3].profit, rows[3].commission) == (Decimal("1.5"), Decimal("-0.25"))
    assert rows[4].reject_reason == ["close_price: more than 12 decimals"]
    assert rows[5].open_time == datetime(2024, 1, 1, 8) and rows[5].close_time == datetime(2024, 1, 1, 10)
    assert rows[6].reject_reason == ["magic_number: not a whole number"]
    assert rows[7].is_valid and rows[7].magic_number == 70
    assert rows[8].reject_reason == ["volume: not a number", "profit: not a number"]
    assert rows[9].reject_reason == ["open_time: not a time"]


def test_key_of_two_accounts_is_the_first_ones(make_inbound, make_accounts):
    accounts = make_accounts([{"id": 2, "api_key": "key1"}, {"id": 1}, {"id": 3, "is_active": False}])
    records = I.resolve_account(I.valid(I.validate(make_inbound([{}]))), accounts)
    assert [r.account_id for r in records.collect()] == [1]


def test_accounts_and_duplicates(make_inbound, make_accounts, make_trades):
    accounts = make_accounts([{"id": 1}, {"id": 2}, {"id": 3, "is_active": False}])
    checked = I.valid(
        I.validate(
            make_inbound(
                [
                    {"ticket": "5"},
                    {"ticket": "5", "profit": "99"},
                    {"ticket": "5", "api_key": "key2"},
                    {"ticket": "6", "api_key": "key3"},
                    {"ticket": "7", "api_key": "nobody"},
                    {"ticket": "8"},
                ]
            )
        )
    )
    assert sorted(r.ticket for r in I.unknown_keys(checked, accounts).collect()) == [6, 7]
    records = I.resolve_account(checked, accounts).drop("api_key")
    stored = make_trades([{"account_id": 1, "ticket": 8}]).select("account_id", "ticket")
    for batch_rows in (10, 10**9):  # broadcast keys, shuffle join
        new = I.new_trades(records, stored, batch_rows).collect()
        assert sorted((r.account_id, r.ticket, r.profit) for r in new) == [(1, 5, 5.5), (2, 5, 5.5)]
        status = I.ingest_status(records, stored, batch_rows)
        assert sorted((r.account_id, r.ticket, r.ok, r.duplicate) for r in status.collect()) == [
            (1, 5, 1, 1), (1, 8, 0, 1), (2, 5, 1, 0),
        ]
        totals = I.ingest_totals(status).first()
        assert (totals.total, totals.saved, totals.duplicates) == (4, 2, 2)


def test_recompute_gate(make_trades):
    new = make_trades([{"magic_number": m} for m in (None, 0, 7, 7)])
    touched = I.touched_strategies(new)
    assert [r.magic_number for r in touched.collect()] == [7]
    history = make_trades([{"magic_number": m} for m in (7, 8, 7)])
    assert I.restrict_to(history, touched, 1).count() == 2


@pytest.fixture
def inbound_rows():
    rows = []
    for i in range(60):
        rows.append(
            {
                "ticket": str(i),
                "api_key": "key1" if i % 3 else "key2",
                "profit": str((i * 37) % 23 - 11),
                "commission": None if i % 13 == 0 else "-0.1",
                "magic_number": str(i % 4) if i % 7 else None,
                "close_time": f"2024-01-{1 + (i * 5) % 28:02d} {i % 24:02d}:00:00",
                "received_at": datetime(2024, 2, 1, i // 60, i % 60),
            }
        )
    return rows


def test_stream_equals_batch(spark, make_inbound, make_accounts, inbound_rows, tmp_path):
    """Out-of-order files with repeats, then a second run with more: the store is the batch."""
    accounts = make_accounts([{"id": 1}, {"id": 2}])
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    broken = [{"ticket": "x1", "order_type": "hold"}, {"ticket": "77", "api_key": "nobody"}]

    def send(rows):
        make_inbound(rows).coalesce(1).write.mode("append").json(source)

    def run():
        job = IngestJob(accounts=lambda: accounts, root=root)
        job.start(stream_inbound(spark, source, files_per_trigger=1)).awaitTermination()
        return job

    send(inbound_rows[30:50])
    send(inbound_rows[:40])
    run()
    send(inbound_rows[20:] + broken)
    job = run()

    stored = read_store(spark, job.store)
    records = I.resolve_account(I.valid(I.validate(make_inbound(inbound_rows))), accounts)
    batch = I.new_trades(records.drop("api_key"), stored.where("false"), 60)
    columns = I.STORED_COLUMNS
    assert sorted(map(repr, stored.select(*columns).collect())) == sorted(
        map(repr, batch.select(*columns).collect())
    )
    rejects = spark.read.parquet(job.rejects).collect()
    assert len(rejects) == 2
    statuses = spark.read.parquet(job.statuses).selectExpr("sum(total)", "sum(saved)").first()
    assert tuple(statuses) == (100, 60)

    history = prepare(closed_strategy_trades(stored))
    want = {r.magic_number: r for r in full_metrics(history, KEY).collect() if r.magic_number}
    got = {r.magic_number: r for r in current_metrics(spark, job.metrics).collect()}
    assert got == want and set(got) == {1, 2, 3}

    # replaying a batch replaces its own output
    before = stored.count()
    last = spark.read.parquet(job.store).selectExpr("max(batch_id)").first()[0]
    job.handle(make_inbound(inbound_rows[20:] + broken), last)
    assert read_store(spark, job.store).count() == before


def test_bounded_dedupe_is_a_stream(spark, make_inbound, make_accounts, tmp_path):
    source = str(tmp_path / "in")
    make_inbound([{"ticket": "1"}, {"ticket": "1"}, {"ticket": "2"}]).write.json(source)
    accounts = make_accounts([{"id": 1}])
    records = I.resolve_account(I.valid(I.validate(stream_inbound(spark, source))), accounts)
    unique = dedupe_within(records.withColumn("received_at", records.received_at.cast("timestamp")))
    query = unique.writeStream.format("memory").queryName("unique").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.ticket for r in spark.table("unique").collect()) == [1, 2]


def test_running_state_equals_recompute(spark, make_trades, tmp_path):
    """Three batches, the last one partly late; a new strategy appears in the second."""
    def rows(first, n, **more):
        return [
            {"id": first + i, "profit": (first + i) * 31 % 17 - 8, "commission": None if i == 3 else -1,
             "close_time": datetime(2024, 1, 1 + (first + i) // 24, (first + i) % 24)} | more
            for i in range(n)
        ]

    batches = [
        rows(1, 20, magic_number=1) + rows(30, 20, magic_number=2),
        rows(60, 20, magic_number=1) + rows(80, 9, magic_number=3),
        rows(90, 5, magic_number=1) + rows(20, 5, magic_number=2),
    ]
    state, seen = None, []
    for number, batch in enumerate(batches):
        seen += batch
        history = prepare(make_trades(seen))
        now = prepare(make_trades(batch))
        state = running.summarise(now, KEY) if state is None else running.advance(state, now, history, KEY)
        path = str(tmp_path / f"state{number}")
        state.write.parquet(path)
        state = spark.read.parquet(path)
        got = {r.magic_number: r for r in running.running_metrics(state, KEY).collect()}
        want = {r.magic_number: r for r in full_metrics(history, KEY).collect()}
        assert got == want, number


def test_running_state_takes_pairs_and_null_keys(make_trades):
    keys = ["magic_number", "symbol"]
    rows = [
        {"magic_number": None if i % 3 == 0 else i % 3, "symbol": None if i % 2 else "EURUSD", "profit": i * 7 % 11 - 5}
        for i in range(1, 40)
    ]
    # the last rows close before some of the first ones did
    rows[30:] = [r | {"close_time": f"2024-01-01T0{i % 9}:30:00"} for i, r in enumerate(rows[30:])]
    history = prepare(make_trades(rows))
    batch = history.where("id > 20")
    state = running.advance(running.summarise(history.where("id <= 20"), keys), batch, history, keys)
    got = {tuple(r[k] for k in keys): r for r in running.running_metrics(state, keys).collect()}
    want = {tuple(r[k] for k in keys): r for r in full_metrics(history, keys).collect()}
    assert got == want and len(got) == 6
