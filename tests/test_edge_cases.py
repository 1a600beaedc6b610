"""Hand-worked cases; nets in close order, initial balance 10,000 unless said."""

from math import inf

import pytest

from tapeledger.operators import accounts as A
from tapeledger.operators import buckets as B
from tapeledger.operators import path as P
from tapeledger.operators.enrich import prepare
from tapeledger.operators.ordered import ChunkPolicy
from tapeledger.operators.stats import strategy_labels
from tapeledger.plans.reports import full_metrics
from tapeledger.sources.trades import closed_strategy_trades, load_trades

KEY = ["magic_number"]
CUT = ChunkPolicy(target_rows=2, samples_per_chunk=1, small_input_bytes=0)

CASES = {
    "mixed and zero": (
        [100, -50, -30, 20, 0, 10], 10_000,
        dict(total_trades=6, winning_trades=3, losing_trades=3, win_rate_pct=50.0, gross_profit=130.0,
             gross_loss=80.0, profit_factor=1.625, avg_win=43.33, avg_loss=-26.67, avg_trade=8.33,
             payoff_ratio=1.625, max_drawdown_usd=80.0, max_drawdown_pct=0.79, recovery_factor=0.625,
             final_balance=10050.0, return_pct=0.5, sharpe_ratio=0.1605, sortino_ratio=0.5893,
             calmar_ratio=0.6329, expectancy=8.3333, expectancy_per_dollar=0.3125,
             profit_std_dev=51.9294, coefficient_of_variation=6.2315, max_consecutive_wins=1,
             max_consecutive_losses=2, current_streak=1, current_streak_type="win"),
    ),
    "opening loss": (
        [-100, 40], 1_000,
        dict(max_drawdown_usd=0.0, max_drawdown_pct=0.0, recovery_factor=inf, return_pct=-6.0,
             calmar_ratio=inf, final_balance=940.0),
    ),
    "single win": (
        [10], 10_000,
        dict(sharpe_ratio=0.0, sortino_ratio=0.0, profit_factor=inf, payoff_ratio=inf, avg_loss=0.0,
             profit_std_dev=None, coefficient_of_variation=None, expectancy_per_dollar=10.0,
             current_streak=1, current_streak_type="win"),
    ),
    "all losses": (
        [-10, -20], 10_000,
        dict(profit_factor=0.0, avg_win=0.0, payoff_ratio=0.0, max_drawdown_usd=20.0,
             max_drawdown_pct=0.2, recovery_factor=-1.5, sharpe_ratio=-2.1213, sortino_ratio=-2.1213,
             expectancy=-15.0, expectancy_per_dollar=-1.0, max_consecutive_wins=0,
             max_consecutive_losses=2),
    ),
    "zero balance": ([10, -5], 0, dict(return_pct=inf, max_drawdown_pct=50.0, calmar_ratio=inf)),
    "flat from nothing": ([0, 0], 0, dict(return_pct=None, max_drawdown_pct=None, calmar_ratio=inf)),
}


def metrics(trades, initial=10_000, policy=ChunkPolicy()):
    (row,) = full_metrics(prepare(trades), KEY, initial, policy=policy).collect()
    return row.asDict()


@pytest.mark.parametrize("policy", [ChunkPolicy(), CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("name", CASES)
def test_metrics(make_trades, name, policy):
    nets, initial, want = CASES[name]
    got = metrics(make_trades([{"profit": n} for n in nets]), initial, policy)
    assert {k: got[k] for k in want} == want


def test_missing_fee(make_trades):
    trades = make_trades(
        [{"profit": 10, "commission": -1}, {"profit": -5, "commission": None}, {"profit": 3}]
    )
    got = metrics(trades)
    want = dict(total_trades=3, winning_trades=2, losing_trades=1, total_net_profit=12.0, gross_loss=0.0,
                profit_factor=inf, avg_trade=6.0, avg_loss=None, payoff_ratio=None, expectancy=None,
                expectancy_per_dollar=0.0, sharpe_ratio=0.0, sortino_ratio=0.0, profit_std_dev=4.2426,
                coefficient_of_variation=0.7071)
    assert {k: got[k] for k in want} == want
    curve = sorted(P.equity_curve(prepare(trades), KEY).collect(), key=lambda r: r.seq)
    assert [r.equity for r in curve] == [10009.0, None, 10012.0]


def test_missing_net_at_the_end_hides_the_final_balance(make_trades):
    got = metrics(make_trades([{"profit": 10}, {"profit": 1, "swap": None}]))
    assert got["final_balance"] is None and got["return_pct"] is None
    assert got["calmar_ratio"] == inf


def test_one_broken_strategy_does_not_stop_the_others(make_trades):
    trades = make_trades(
        [{"magic_number": 1, "profit": 1, "commission": None}, {"magic_number": 2, "profit": 1}]
    )
    rows = {r.magic_number: r for r in full_metrics(prepare(trades), KEY).collect()}
    assert rows[1].max_drawdown_usd is None and rows[2].max_drawdown_usd == 0.0


def test_ties_range_against_rows(make_trades):
    trades = make_trades(
        [
            {"profit": 10, "close_time": "2024-01-01T01:00:00"},
            {"profit": 20, "close_time": "2024-01-01T01:00:00"},
            {"profit": 30, "close_time": "2024-01-01T02:00:00"},
        ]
    )
    account = A.account_equity_curve(trades).collect()
    assert sorted(r.cumulative_profit for r in account) == [30, 30, 60]
    strategy = sorted(P.equity_curve(prepare(trades), KEY, 0).collect(), key=lambda r: r.seq)
    assert [r.equity for r in strategy] == [10.0, 30.0, 60.0]


def test_live_and_calculator_disagree_on_a_win(make_trades, make_accounts):
    trades = make_trades([{"profit": 1, "commission": -2}])
    (live,) = A.account_overview(make_accounts([{"id": 1}]), trades).collect()
    assert live.winrate == 100.0 and live.net_profit == -1
    assert metrics(trades)["win_rate_pct"] == 0.0


def test_live_without_losses_and_without_trades(make_trades, make_accounts):
    accounts = make_accounts([{"id": 1}, {"id": 2}, {"id": 3, "is_active": False}])
    overview = A.account_overview(accounts, make_trades([{"profit": 5}, {"profit": 0}]))
    rows = {r.id: r for r in overview.collect()}
    assert sorted(rows) == [1, 2]
    assert rows[1].winrate == 50.0 and rows[1].profit_factor is None
    assert (rows[2].total_trades, rows[2].total_profit, rows[2].net_profit) == (0, 0, 0)
    assert rows[2].winrate == 0.0 and rows[2].profit_factor is None
    (totals,) = A.dashboard_totals(overview).collect()
    assert (totals.total_pnl, totals.total_trades, totals.avg_winrate) == (5, 2, 25.0)
    assert totals.avg_profit_factor is None


def test_missing_and_zero_magic(make_trades):
    trades = make_trades([{"magic_number": m, "profit": 1} for m in (None, 0, 7)])
    assert A.strategy_catalog(trades).count() == 3
    calculated = full_metrics(prepare(closed_strategy_trades(trades)), KEY).collect()
    assert sorted(r.magic_number for r in calculated) == [0, 7]


def test_bucket_tie_goes_to_the_smallest_name(make_trades):
    days = {"Monday": "2024-01-01", "Tuesday": "2024-01-02", "Friday": "2024-01-05"}
    prepared = prepare(
        make_trades([{"profit": 5, "close_time": f"{d}T10:00:00"} for d in days.values()])
    )
    (row,) = B.best_worst(B.bucket_table(prepared, KEY), KEY).collect()
    assert row.best_weekday == row.worst_weekday == "Friday"
    weekdays = B.by_weekday(prepared, KEY).orderBy("weekday_no").collect()
    assert [r.weekday for r in weekdays] == ["Monday", "Tuesday", "Friday"]


def test_open_trades_count_for_accounts_only(make_trades, make_accounts):
    trades = make_trades([{"close_time": None}, {"close_price": 0}, {"profit": 2}])
    assert closed_strategy_trades(trades).count() == 1
    (live,) = A.account_overview(make_accounts([{"id": 1}]), trades).collect()
    assert live.total_trades == 3


def test_date_bound_is_midnight(make_trades):
    trades = make_trades(
        [{"close_time": "2024-12-31T00:00:00"}, {"close_time": "2024-12-31T10:00:00"}]
    )
    assert [r.id for r in load_trades(trades, date_to="2024-12-31").collect()] == [1]
    assert [r.id for r in load_trades(trades, symbol="eurusd", account_id=1, date_from="2024-12-31 01:00").collect()] == [2]


def test_labels(make_trades):
    trades = make_trades(
        [
            {"magic_number": 1, "comment": None},
            {"magic_number": 1, "comment": "late", "close_time": "2024-03-02T00:00:00"},
            {"magic_number": 1, "comment": "early", "close_time": "2024-03-01T00:00:00"},
            {"magic_number": 2},
        ]
    )
    rows = {r.magic_number: r.ea_name for r in strategy_labels(trades).collect()}
    assert rows == {1: "early", 2: "EA 2"}


def test_empty_input_gives_no_rows(make_trades):
    trades = prepare(make_trades([{"profit": 1}]).where("id < 0"))
    assert full_metrics(trades, KEY).count() == 0


def test_sample_and_levels(make_trades):
    prepared = prepare(make_trades([{"profit": 1} for _ in range(25)]))
    sample = P.curve_sample(prepared, KEY, 0, points=10)
    # every second of 25 points makes 13, of which the last ten stay
    assert sorted(r.seq for r in sample.collect()) == list(range(7, 26, 2))
    levels = sorted(P.curve_levels(sample, KEY).collect(), key=lambda r: r.seq)
    assert levels[0].level == 0 and levels[-1].level == 30 and levels[0].direction == "up"


def test_invariants(make_trades):
    nets = [5, -3, 0, 8, -9, 2, 2, -1]
    prepared = prepare(make_trades([{"profit": n} for n in nets]))
    got = metrics(make_trades([{"profit": n} for n in nets]))
    assert got["winning_trades"] + got["losing_trades"] == got["total_trades"]
    for table in (B.by_hour, B.by_weekday, B.by_month):
        assert sum(r.profit for r in table(prepared, KEY).collect()) == sum(nets)
    assert sum(r.length for r in P.streak_runs(prepared, KEY).collect()) == len(nets)
    assert got["final_balance"] - got["initial_balance"] == sum(nets)
    assert round(got["expectancy"], 2) == got["avg_trade"]
