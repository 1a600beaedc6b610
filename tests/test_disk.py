"""What keeps streams and merges within the disk: little moves at a time, and what is done goes."""

from datetime import datetime

import pytest

from tapeledger import queries as Q
from tapeledger.operators import history as H
from tapeledger.operators import ingest as I
from tapeledger.operators.enrich import prepare
from tapeledger.sources import sinks
from tapeledger.sources.sinks import merge_store, read_store, store_trades
from tapeledger.sources.trades import closed_strategy_trades
from tapeledger.streaming import ingest as G

from test_scaling import data_files, scratch, small_tables  # noqa: F401

KEYS = ["account_id", "ticket"]


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(str, df.select(*columns).collect()))


def batch_of(make_inbound, make_accounts):
    """Records of two accounts: one comes twice, one account is unknown, one record is faulty."""
    records = make_inbound([{}, {"api_key": "key2"}, {"ticket": "1", "profit": "7"}, {"api_key": "nobody"}, {"profit": "x"}, {"api_key": "key2"}])
    return records, make_accounts([{"id": 1}, {"id": 2}])


@pytest.mark.parametrize("few", [1000, 0])
def test_large_batch_gives_the_trades_of_a_small_one(spark, make_inbound, make_accounts, monkeypatch, few):
    monkeypatch.setattr(I, "BROADCAST_ROWS", few)
    inbound, accounts = batch_of(make_inbound, make_accounts)
    records = I.resolve_account(I.valid(I.validate(inbound)), accounts).drop("api_key")
    stored = spark.createDataFrame([(2, 6), (3, 9)], "account_id long, ticket long")
    keys = I.settle_keys(records.select(*KEYS), stored, 6)
    new = I.settle_large(records, keys, stored, 6)
    assert rows_of(new) == rows_of(I.settled_trades(I.settle(records, stored, 6)))
    assert sorted((r.account_id, r.ticket) for r in new.collect()) == [(1, 1), (2, 2)]


def test_sieve_loses_no_record(spark):
    records = spark.range(20_000).selectExpr("id % 7 AS account_id", "id AS ticket")
    wanted = records.where("ticket % 50 = 3")
    found = I.possibly_of(records, wanted)
    assert found.join(wanted, KEYS, "left_semi").count() == wanted.count() == 400
    assert found.count() < 500


@pytest.mark.parametrize("limit", [1000, 0])
def test_batch_is_not_held(spark, make_inbound, make_accounts, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(G, "BROADCAST_ROWS", limit)
    held = []
    monkeypatch.setattr(G, "store_trades", lambda new, *rest: (held.append(spark._jsc.getPersistentRDDs().size()), store_trades(new, *rest)))
    inbound, accounts = batch_of(make_inbound, make_accounts)
    job = G.IngestJob(accounts=lambda: accounts, root=str(tmp_path / "job"), refresh_metrics=False)
    before = spark._jsc.getPersistentRDDs().size()
    job.handle(inbound, 0)
    job.handle(inbound, 1)
    assert held == [before, before]
    assert sorted((r.account_id, r.ticket, r.batch_id) for r in read_store(spark, job.store).collect()) == [(1, 1, 0), (2, 2, 0), (2, 6, 0)]
    status = {r.batch_id: (r.total, r.saved, r.duplicates) for r in spark.read.parquet(job.statuses).collect()}
    assert status == {0: (4, 3, 1), 1: (4, 0, 4)}
    assert sorted((r.ticket, r.reject_reason[0]) for r in spark.read.parquet(job.rejects).where("batch_id = 0").collect()) == [
        (4, "api_key: unknown or inactive account"), (5, "profit: not a number")]


def test_merge_in_turns(spark, make_trades, monkeypatch, tmp_path):
    trades = make_trades([{"account_id": i % 9} for i in range(40)])
    roots = [str(tmp_path / name) for name in ("whole", "turns")]
    for root, most in zip(roots, (1 << 30, 1)):
        monkeypatch.setattr(sinks, "MERGE_BYTES", most)
        store_trades(trades, root, 0)
        merge_store(spark, root, 0)
        sinks.remove_merged(spark, root)
    whole, turns = (read_store(spark, root) for root in roots)
    assert turns.count() == 40 and rows_of(whole) == rows_of(turns)
    moved = []
    monkeypatch.setattr(sinks, "release", moved.append)
    store_trades(trades, str(tmp_path / "again"), 0)
    merge_store(spark, str(tmp_path / "again"), 0)
    assert len(moved) > 1


def test_tree_in_turns(make_trades):
    trades = prepare(closed_strategy_trades(make_trades(
        [{"magic_number": 1 + i % 3, "close_time": datetime(2024, 1 + i % 12, 1 + i % 28), "profit": i - 20} for i in range(60)])))
    whole, turns = (H.metrics(H.build(trades, ["magic_number"], turns=n), ["magic_number"]) for n in (1, 5))
    assert rows_of(whole) == rows_of(turns)


def lines(spark, folder):
    return spark.read.text(str(folder)).count()


def test_files_of_a_batch_go_before_the_next(spark, small_tables, scratch):  # noqa: F811
    Q.stream_ingest_batches(spark, small_tables)
    assert lines(spark, scratch / "inbound") == spark.read.parquet(f"{small_tables}/lineitem.parquet").count()


def test_bounded_dedupe_keeps_one_part(spark, small_tables, scratch):  # noqa: F811
    found = Q.stream_dedupe_within(spark, small_tables)
    items = spark.read.parquet(f"{small_tables}/lineitem.parquet")
    assert 0 < lines(spark, scratch / "inbound") <= items.count()
    assert found.count() > 0 and data_files(scratch / "inbound")
