"""Trade scans, snapshots and account maintenance."""

from datetime import date

import pytest

from tapeledger.operators import accounts as A
from tapeledger.operators.enrich import prepare
from tapeledger.plans.jobs import run_snapshot
from tapeledger.plans.snapshot import merge_snapshots, snapshot_rows
from tapeledger.schema import SNAPSHOT_COLUMNS, SNAPSHOT_REFRESHED
from tapeledger.sources.commits import CommitLog, Conflict, Head, KeyedTable, Part
from tapeledger.sources.sinks import (
    account_bucket, merge_store, read_snapshots, read_store, remove_merged, store_trades, write_trades,
)
from tapeledger.sources.trades import load_trades, read_trades, scan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_trades_prune_and_push_down(spark, make_trades, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    path = str(tmp_path / "trades")
    rows = [{"close_time": f"2024-{m:02d}-05T00:00:00", "profit": m, "magic_number": m % 3} for m in range(1, 13)]
    write_trades(make_trades(rows), path)
    trades = read_trades(spark, path)
    found = load_trades(trades, magic_number=1, date_from="2024-03-01", date_to="2024-08-05").select("profit")
    assert sorted(int(r.profit) for r in found.collect()) == [4, 7]
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(close_month" in plan
    assert "EqualTo(magic_number,1)" in plan and "GreaterThan(close_price" in plan
    read = plan.split("ReadSchema:")[1].split(">")[0]
    assert "profit" in read and "comment" not in read and "swap" not in read
    assert scan(trades).count() == 12 and len(scan(trades).columns) == 17


def test_store_is_pruned_and_merged(spark, make_trades, tmp_path):
    """Batches, their merge and what remains after the clean-up hold the same trades."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    root = str(tmp_path / "trades")
    rows = [{"account_id": i, "close_time": f"2024-{1 + i % 12:02d}-05T00:00:00"} for i in range(1, 31)]
    for batch in range(3):
        store_trades(make_trades(rows[batch * 10:batch * 10 + 10]), root, batch)

    def held(**limits):
        return sorted((r.account_id, r.batch_id) for r in read_store(spark, root, **limits).collect())

    want = [(i, (i - 1) // 10) for i in range(1, 31)]
    assert held() == want and held(before=1) == want[:10]
    bucket = make_trades([{"account_id": 7}]).select(account_bucket()).first()[0]
    plan = plan_of(read_store(spark, root, 2, [bucket]))
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "account_bucket" in filters and "batch_id" in filters
    assert (7, 0) in held(buckets=[bucket]) and len(held(buckets=[bucket])) < 30

    # a merge that died: its folder is not read, and the next one replaces it
    left = tmp_path / "trades_merged" / "upto=1" / "account_bucket=0" / "close_month=2024-01"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_text("unfinished")
    assert held() == want
    for _ in range(2):
        merge_store(spark, root, 1)
        assert held() == want and held(before=1) == want[:10] and held(before=2) == want[:20]
    found = load_trades(read_store(spark, root), date_from="2024-03-01", date_to="2024-04-30")
    assert sorted(r.account_id for r in found.collect()) == [2, 3, 14, 15, 26, 27]
    assert "close_month" in plan_of(found).split("upto=1")[0].rsplit("PartitionFilters: [", 1)[1]
    remove_merged(spark, root)
    assert held() == want
    assert [p.name for p in sorted((tmp_path / "trades").iterdir())] == ["batch_id=2"]


def as_dict(df):
    return {(r.magic_number, r.snapshot_date): r.asDict() for r in df.collect()}


def test_second_snapshot_refreshes_eight_columns(make_trades):
    first = snapshot_rows(prepare(make_trades([{"profit": 10}, {"profit": -4}])), "2024-05-01")
    second = snapshot_rows(
        prepare(make_trades([{"profit": 1}, {"profit": -7}, {"profit": 2}, {"magic_number": 9, "profit": 1}])),
        "2024-05-01",
    )
    assert first.columns == SNAPSHOT_COLUMNS
    old, new = as_dict(first), as_dict(second)
    merged = as_dict(merge_snapshots(first, second))
    key = (7, date(2024, 5, 1))
    for column in SNAPSHOT_COLUMNS[2:]:
        source = new if column in SNAPSHOT_REFRESHED else old
        assert merged[key][column] == source[key][column], column
    assert merged[(9, date(2024, 5, 1))] == new[(9, date(2024, 5, 1))]


def test_snapshot_job_is_idempotent_and_keeps_other_days(spark, make_trades, tmp_path):
    root = str(tmp_path / "metrics")
    trades = make_trades([{"profit": 10}, {"profit": -4}, {"magic_number": None}])
    run_snapshot(spark, trades, root, "2024-05-01")
    once = as_dict(run_snapshot(spark, trades, root, "2024-05-02").drop("version"))
    again = as_dict(run_snapshot(spark, trades, root, "2024-05-02").drop("version"))
    assert once == again and len(again) == 2
    more = trades.unionByName(make_trades([{"id": 50, "profit": 1, "magic_number": 8}]))
    grown = run_snapshot(spark, more, root, "2024-05-02")
    assert grown.count() == 3


def test_snapshot_job_survives_a_run_that_died(spark, make_trades, tmp_path):
    """What an unfinished run left is in no commit: before the first run of a day, and after a good one."""
    root = tmp_path / "metrics"
    trades = make_trades([{"profit": 10}, {"profit": -4}])
    for day, version in (("2024-05-01", 1), ("2024-05-02", 2)):
        if version == 2:
            run_snapshot(spark, trades, str(root), day)
        left = root / f"part-died{version}"
        (left / "_temporary" / "0").mkdir(parents=True)
        (left / "part-0.parquet").write_bytes(b"half a file")
        (root / "_commits").mkdir(exist_ok=True)
        (root / "_commits" / f"draft-died{version}").write_text("[")
        if version == 2:  # readers keep to the committed version
            assert [r.version for r in read_snapshots(spark, str(root), day).collect()] == [1]
        run_snapshot(spark, trades, str(root), day)
        assert [r.version for r in read_snapshots(spark, str(root), day).collect()] == [version]
    assert read_snapshots(spark, str(root)).count() == 2


def test_snapshot_jobs_at_the_same_time_keep_both_updates(spark, make_trades, tmp_path, monkeypatch):
    """While one run merges, others commit the same day and another day; nothing of the three is lost."""
    root = str(tmp_path / "metrics")
    base = make_trades([{"profit": 10}, {"profit": -4}])
    run_snapshot(spark, base, root, "2024-05-01")
    mine = base.unionByName(make_trades([{"id": 50, "profit": 3, "magic_number": 8}]))
    others = base.unionByName(make_trades([{"id": 60, "profit": 5, "magic_number": 9}, {"id": 61, "profit": 90}]))
    merges, commit = [], CommitLog.commit

    def interleaved(log, seen, parts):
        if not merges:
            merges.append(seen.version)
            run_snapshot(spark, others, root, "2024-05-01")
            run_snapshot(spark, base, root, "2024-05-02")
        return commit(log, seen, parts)

    monkeypatch.setattr(CommitLog, "commit", interleaved)
    run_snapshot(spark, mine, root, "2024-05-01")
    day = {r.magic_number: r for r in read_snapshots(spark, root, "2024-05-01").collect()}
    assert set(day) == {7, 8, 9} and {r.version for r in day.values()} == {3}
    assert day[7].winning_trades == 1  # the first run's, which no later one refreshes
    assert read_snapshots(spark, root, "2024-05-02").count() == 1
    # of the two folders that the interrupted run wrote, the stale one is gone
    assert len(list((tmp_path / "metrics").glob("part-*"))) == 4


def test_commits_conflict_and_expire(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"), kept=2)
    seen = log.head()
    for number in range(4):
        folder = log.fresh_folder()
        spark.range(number).write.parquet(folder)
        seen = log.commit(seen, [Part(folder, number, number)])
    assert log.head() == seen and seen.version == 4
    with pytest.raises(Conflict):
        log.commit(Head(3), [])
    assert sorted(p.name for p in (tmp_path / "t" / "_commits").glob("*.json")) == [f"{v:012d}.json" for v in (3, 4)]
    assert len(list((tmp_path / "t").glob("part-*"))) == 2


def test_keyed_table_holds_the_newest_rows_in_few_folders(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], fan=3)
    assert table.read() is None
    want = {}
    for batch in range(50):
        rows = [(None if k == 0 else k, batch * 100 + k) for k in {batch % 7, batch % 5, 0 if batch % 10 == 0 else 1}]
        want |= dict(rows)
        table.put(spark.createDataFrame(rows, "k long, v long").coalesce(1), batch)
        assert len(table.log.head().parts) <= 2 * 4 + 1
    table.put(spark.createDataFrame([(1, -1)], "k long, v long"), 49)  # a replay
    assert {r.k: r.v for r in table.read().collect()} == want
    assert len(table.log.head().parts) <= 8
    plan = plan_of(table.read().where("k = 3"))
    assert plan.count("EqualTo(k,3)") == len(table.log.head().parts)


def test_account_maintenance(spark, make_accounts):
    accounts = make_accounts([{"id": 1}, {"id": 2, "phase": "Fase 2"}, {"id": 3, "type": "Propfirm", "phase": ""}])
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    after = {r.id: r.is_active for r in A.deactivate(accounts, ids).collect()}
    assert after == {1: True, 2: False, 3: True}
    assert [r.id for r in A.missing_accounts(accounts, ids).collect()] == [9]
    badges = {r.id: (r.label, r.badge) for r in A.badges(accounts).collect()}
    assert badges == {1: ("—", "badge-default"), 2: ("Fase 2", "badge-phase"), 3: ("Propfirm", "badge-propfirm")}
    fresh = make_accounts([{"id": 4, "platform": None, "initial_balance": None}, {"id": 5, "type": "Hedge"}])
    grown = {r.id: r for r in A.append_accounts(accounts, fresh).collect()}
    assert sorted(grown) == [1, 2, 3, 4]
    assert grown[4].platform == "MT5" and grown[4].initial_balance == 0 and grown[4].is_active
    assert [r.id for r in A.active_accounts(accounts, account_id=2).collect()] == [2]
    refused = make_accounts([{"id": 4}, {"id": 5, "type": "Hedge"}, {"id": 6, "type": "Hedge", "name": None}])
    assert {r.id: r.reject_reason for r in A.account_rejects(refused).collect()} == {
        5: ["type: unknown"], 6: ["name: missing", "type: unknown"],
    }
