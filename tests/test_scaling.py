"""What keeps the queries over large tables within time and disk: how records are written, split and computed."""

from datetime import datetime, timedelta
from pathlib import Path
from uuid import uuid4

import pytest

from tapeledger import queries as Q
from tapeledger.operators import ingest as I
from tapeledger.session import staged

DAY = datetime(1996, 1, 5)


@pytest.fixture(scope="module")
def small_tables(spark, tmp_path_factory):
    """60 line items of three accounts from 1996 to 1999, one of them twice."""
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, 1 + i % 5, 1 + i % 3, 1 + i % 7, float(1 + i % 12), 100.0 + i, 0.01 * (i % 5), 0.01 * (i % 4), "RAN"[i % 3], "FO"[i % 2],
              DAY + timedelta(days=22 * i)) for i in range(1, 60)]
    spark.createDataFrame(
        items + items[:1],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(
        [(i, f"Customer#{i:09d}", i, "BUILDING", 10.0) for i in range(1, 4)],
        "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double",
    ).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.fixture
def scratch(monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    monkeypatch.setattr(Q, "staged", lambda df, path: staged(df, f"{path}-{uuid4().hex}"))
    return tmp_path


def data_files(folder: Path) -> list[str]:
    return [p.name for p in folder.rglob("part-*") if not p.name.endswith(".crc")]


def test_rare_numbers_are_told_by_a_lambda():
    """The test for exponents is not generated code, which with all casts in one method would be too long to be compiled."""
    for name in ("ticket", "volume", "magic_number"):
        typed = I._typed(name)
        assert "regexp_extract" not in typed.split("exists(")[0] and "exists(" in typed


def test_numbers_written_with_exponents(make_inbound):
    rows = {r.ticket: r for r in I.validate(make_inbound(
        [{"ticket": "1e0"}, {"ticket": "2", "magic_number": "7e-1"}, {"ticket": "3", "profit": "12345e-4"}, {"ticket": "4", "profit": "1e-5"},
         {"ticket": "5", "magic_number": None}])).collect()}
    assert rows[1].is_valid and rows[3].is_valid and float(rows[3].profit) == 1.2345
    assert rows[2].reject_reason == ["magic_number: not a whole number"]
    assert rows[4].reject_reason == ["profit: more than 4 decimals"]
    assert rows[5].is_valid and rows[5].magic_number is None


def test_records_lie_packed(spark, small_tables, scratch):
    found = Q.ingest_parse(spark, small_tables)
    files = data_files(scratch / "inbound")
    assert files and all(name.endswith(".json.gz") for name in files)
    assert found.count() == I.valid(Q._checked(spark, small_tables)).count() > 0


def test_bounded_dedupe_writes_packed_records(spark, small_tables, scratch):
    passed = {(r.account_id, r.ticket): r.passed for r in Q.stream_dedupe_within(spark, small_tables).collect()}
    assert all(name.endswith(".json.gz") for name in data_files(scratch / "inbound"))
    known = {(r.account_id, r.ticket) for r in Q.ingest_status(spark, small_tables).collect()}
    newest = max(t for _, t in passed) // 10
    assert set(passed) == known
    # those of the last 30 days do not come again
    assert {t // 10 for (_, t), n in passed.items() if n == 1} <= {newest - 1, newest, newest + 1}
    assert set(passed.values()) <= {1, 2} and 2 in passed.values()


def test_batched_records_lie_packed(spark, small_tables, scratch):
    stored = {(r.account_id, r.ticket) for r in Q.stream_ingest_batches(spark, small_tables).collect()}
    assert all(name.endswith(".json.gz") for name in data_files(scratch / "inbound"))
    assert stored == {(r.account_id, r.ticket) for r in Q.ingest_status(spark, small_tables).collect()}


def test_state_batches_are_written_by_all_tasks(spark, small_tables, scratch):
    found = Q.stream_state_metrics(spark, small_tables)
    assert len(data_files(scratch / "trades" / "part=0")) > 1
    batches = sorted(int(p.name) for p in (scratch / "state" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    assert batches == [0, 1, 2]
    whole = {r.magic_number: r.total_trades for r in Q.R.full_metrics(Q._closed(spark, small_tables), Q.EA).collect()}
    assert {r.magic_number: r.total_trades for r in found.collect()} == whole

