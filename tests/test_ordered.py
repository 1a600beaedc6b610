"""The ordered passes against plain Python, whole and cut into chunks."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from brute import path, total_by_time

from tapeledger.operators.enrich import prepare
from tapeledger.operators.ordered import (
    ChunkPolicy, chunk_rows, path_figures, path_rows, running_total_by_time,
)

KEY = ["magic_number"]
WHOLE = ChunkPolicy()
FINE = ChunkPolicy(target_rows=8, samples_per_chunk=2, small_input_bytes=0)
COARSE = ChunkPolicy(target_rows=60, samples_per_chunk=4, small_input_bytes=0)
THINNED = ChunkPolicy(target_rows=8, samples_per_chunk=2, max_cuts=5, small_input_bytes=0)
POLICIES = pytest.mark.parametrize("policy", [WHOLE, FINE, COARSE, THINNED], ids="whole fine coarse thinned".split())


def random_trades(seed):
    """One hot strategy with a third of all trades, crowded instants, missing fees, small ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        magic = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, None])
        crowded = rng.random() < 0.4
        minute = 777 if crowded else rng.randrange(3000)
        rows.append(
            {
                "id": i + 1,
                "magic_number": magic,
                "close_time": datetime(2024, 1, 1) + timedelta(minutes=minute),
                "profit": rng.choice([-30, -20, -1, 0, 1, 10, 25]),
                "commission": None if rng.random() < 0.1 else 0,
            }
        )
    rows += [{"id": 900, "magic_number": 8, "profit": 5}]
    rows += [{"id": 901 + i, "magic_number": 9, "profit": 3} for i in range(40)]
    rng.shuffle(rows)
    return rows


def expected_by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r["close_time"], r["id"])):
        net = None if row.get("commission", 0) is None else Decimal(row["profit"])
        out.setdefault(row["magic_number"], []).append((row, net))
    return out


@pytest.fixture(scope="module")
def case(make_trades):
    rows = random_trades(5)
    prepared = prepare(make_trades(rows)).persist()
    full = [
        {"magic_number": r.magic_number, "close_time": r.close_time, "id": r.id,
         "profit": r.profit, "commission": r.commission}
        for r in prepared.collect()
    ]
    return prepared, full


def test_cuts_bound_the_chunks(case):
    prepared, rows = case
    chunked = chunk_rows(prepared, KEY, policy=FINE)
    assert chunked.split
    sizes = chunked.rows.groupBy(*chunked.parts).count().collect()
    hot = [r for r in sizes if r.magic_number == 1]
    assert len(hot) > 5
    # also the instant that holds 40 % of the trades is cut
    assert max(r["count"] for r in sizes) < 60


def test_small_input_stays_whole(case):
    assert not chunk_rows(case[0], KEY, policy=ChunkPolicy(small_input_bytes=1 << 62)).split


@POLICIES
def test_figures(case, policy):
    prepared, rows = case
    got = {r.magic_number: r.asDict() for r in path_figures(prepared, KEY, policy).collect()}
    want = {k: path([net for _, net in v])[1] for k, v in expected_by_key(rows).items()}
    assert got.keys() == want.keys()
    for key, figures in want.items():
        mine = {name: got[key][name] for name in figures}
        assert mine == figures, key


@POLICIES
def test_rows(case, policy):
    prepared, rows = case
    got = {}
    for r in path_rows(prepared, KEY, policy=policy).collect():
        got.setdefault(r.magic_number, []).append((r.seq, r.equity, r.peak, r.run_start, r.n_total))
    for key, group in expected_by_key(rows).items():
        want = [(*row, len(group)) for row in path([net for _, net in group])[0]]
        assert sorted(got[key]) == want, key


@POLICIES
def test_running_total_shares_ties(make_trades, policy):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        crowded = rng.random()
        minute = 50 if crowded < 0.3 else 51 if crowded < 0.5 else rng.randrange(100)
        rows.append(
            {
                "account_id": rng.choice([1, 1, 1, 2]),
                "profit": rng.randrange(-50, 50),
                "close_time": None if crowded > 0.9 else datetime(2024, 1, 1) + timedelta(minutes=minute),
            }
        )
    trades = make_trades(rows).select("account_id", "close_time", "id", "profit")
    got = running_total_by_time(trades, ["account_id"], "profit", policy=policy).collect()
    assert len(got) == len(rows)
    for account in (1, 2):
        mine = [r for r in got if r.account_id == account]
        want = total_by_time([r.close_time for r in mine], [r.profit for r in mine])
        assert [r.cumulative for r in mine] == want


@pytest.mark.parametrize("seed", [11, 12])
def test_other_seeds_cut(make_trades, seed):
    rows = random_trades(seed)
    prepared = prepare(make_trades(rows)).persist()
    full = [r.asDict() for r in prepared.collect()]
    got = {r.magic_number: r for r in path_figures(prepared, KEY, FINE).collect()}
    for key, group in expected_by_key(full).items():
        for name, value in path([net for _, net in group])[1].items():
            assert got[key][name] == value, (key, name)


def test_one_shuffle_and_one_sort_of_the_rows(case, make_trades):
    """Whole keys: the rows are shuffled once; all windows share the order."""
    plan = path_figures(case[0], KEY, ChunkPolicy(small_input_bytes=1 << 62))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
