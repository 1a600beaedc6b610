"""SQL counterparts of the registered queries, written for DuckDB over the given tables.

They are built from window functions and plain aggregates over the whole tables, independently
of the DataFrame code. Money is handled in whole 1e-4 units, so sums are exact.
"""

from __future__ import annotations

TRADES = """t AS (
  SELECT l_orderkey * 10 + l_linenumber AS ticket, l_partkey AS part, l_suppkey AS supp,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_suppkey AS account_id, nullif(l_partkey % 41, 0) AS magic_number,
         CASE WHEN l_returnflag <> 'N' THEN 'EA_' || l_returnflag END AS comment,
         'SYM' || l_linenumber AS symbol, l_linenumber AS line, l_linestatus AS status,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS order_type,
         l_quantity AS volume, CAST(l_quantity AS BIGINT) AS qty,
         l_shipdate - to_minutes(CAST(l_quantity AS BIGINT) * 37) AS open_time,
         l_shipdate + to_minutes((l_partkey * 61 + l_linenumber * 7) % 1440) AS priced_at,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 6 THEN NULL ELSE
           l_shipdate + to_minutes((l_partkey * 61 + l_linenumber * 7) % 1440) END AS close_time,
         (CAST(round(l_extendedprice * 100) AS BIGINT) * 5000) // CAST(l_quantity AS BIGINT) AS open_m,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 0 ELSE
           (CAST(round(l_extendedprice * 100) AS BIGINT) * 10000) // CAST(l_quantity AS BIGINT) END AS close_m,
         CAST(round(l_extendedprice * 100) AS BIGINT)
           * (CAST(round(l_tax * 100) AS BIGINT) - CAST(round(l_discount * 100) AS BIGINT)) AS profit,
         CASE WHEN round(l_tax * 100) <> 0 THEN -700 * CAST(l_quantity AS BIGINT) END AS commission,
         -100 * CAST(round(l_discount * 100) AS BIGINT) AS swap,
         l_shipdate + to_minutes(1) AS received_at
  FROM lineitem)"""

ACCOUNTS = """a AS (
  SELECT c_custkey AS id, c_name AS name, 'Broker ' || c_nationkey AS broker,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Propfirm' WHEN 'BUILDING' THEN 'Broker'
              WHEN 'HOUSEHOLD' THEN 'Personal' END AS type,
         'MT5' AS platform,
         CASE c_nationkey % 5 WHEN 0 THEN 'Fondeada' WHEN 1 THEN 'Fase 1' WHEN 2 THEN 'Fase 2'
              WHEN 3 THEN '' END AS phase,
         greatest(c_acctbal, 0.0) AS initial_balance, md5(c_name) AS api_key,
         c_mktsegment <> 'MACHINERY' AS is_active,
         TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 3650 AS INTEGER)) AS created_at
  FROM customer)"""

ORDER = "close_time, ticket, part, supp, cents"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')"


def units(value: str) -> str:
    """Whole 1e-4 units as a double."""
    return f"(({value}) / 10000.0)::DOUBLE"


def even2(value: str) -> str:
    """Whole 1e-4 units, half-even to cents."""
    a = f"abs({value})"
    up = f"CASE WHEN {a} % 100 > 50 OR ({a} % 100 = 50 AND ({a} // 100) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CASE WHEN ({value}) < 0 THEN -1 ELSE 1 END * ({a} // 100 + {up}) / 100.0)::DOUBLE"


def even(value: str, places: int) -> str:
    """A double, half-even on its first twelve decimals; infinite values pass."""
    scale = 10**places
    a = f"abs(CAST({value} AS DECIMAL(28,12))) * {scale}"
    whole = f"CAST(floor({a}) AS HUGEINT)"
    rest = f"({a}) - floor({a})"
    up = f"CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return (
        f"((CASE WHEN ({value}) IS NULL THEN NULL WHEN isinf({value}) THEN ({value}) "
        f"WHEN ({value}) < 0 THEN -(({whole} + {up}) / {scale}.0) "
        f"ELSE ({whole} + {up}) / {scale}.0 END)::DOUBLE + 0.0)"
    )


def up(value: str, places: int) -> str:
    """A double, half away from zero."""
    return f"round(CAST({value} AS DECIMAL(28,12)), {places})::DOUBLE"


def prepared(where: str = "magic_number IS NOT NULL") -> str:
    return f"""p AS (
  SELECT *, profit + commission + swap AS net,
         coalesce(profit + commission + swap > 0, FALSE) AS win,
         epoch_us(close_time - open_time) / 6e7 AS minutes,
         dayname(close_time) AS weekday, isodow(close_time) - 1 AS weekday_no,
         hour(close_time) AS hour, strftime(close_time, '%Y-%m') AS month
  FROM t WHERE close_time IS NOT NULL AND close_m > 0 AND {where})"""


EA_ONLY = "magic_number IS NOT NULL"
FULL_FEE = "magic_number IS NOT NULL AND commission IS NOT NULL"
ANY = "TRUE"


def stats(key: str, source: str = "p", name: str = "s") -> str:
    return f"""{name} AS (
  SELECT {key}, count(*) AS n, count(net) AS n_net, count(*) FILTER (WHERE win) AS n_win,
         count(*) FILTER (WHERE NOT win) AS n_loss, count(net) FILTER (WHERE NOT win) AS n_loss_net,
         coalesce(sum(net), 0) AS net, sum(net) AS net_or_null,
         coalesce(sum(net) FILTER (WHERE win), 0) AS win_net,
         coalesce(sum(net) FILTER (WHERE NOT win), 0) AS loss_net,
         max(net) AS best, min(net) AS worst, coalesce(sum(commission), 0) AS commissions,
         coalesce(sum(swap), 0) AS swaps, avg(minutes) AS minutes,
         stddev_samp(net / 10000.0) AS std,
         count(*) FILTER (WHERE net < 0) AS n_down,
         stddev_samp(net / 10000.0) FILTER (WHERE net < 0) AS down_std,
         min(open_time) AS first_open, max(close_time) AS last_close
  FROM {source} GROUP BY {key}),
{name}v AS (
  SELECT *, CASE WHEN n_win = 0 THEN 0.0 ELSE win_net / 10000.0 / n_win END AS avg_win,
         CASE WHEN n_loss = 0 THEN 0.0 WHEN n_loss_net = 0 THEN NULL
              ELSE loss_net / 10000.0 / n_loss_net END AS avg_loss,
         CASE WHEN n_net > 0 THEN net / 10000.0 / n_net END AS mean,
         CASE WHEN loss_net < 0 THEN win_net::DOUBLE / abs(loss_net) ELSE 'inf'::DOUBLE END AS pf
  FROM {name}),
{name}x AS (
  SELECT *, n_win::DOUBLE / n * avg_win + n_loss::DOUBLE / n * avg_loss AS expectancy FROM {name}v)"""


BASIC = f"""n AS total_trades, n_win AS winning_trades, n_loss AS losing_trades,
  {even('n_win * 100.0 / n', 2)} AS win_rate_pct, {even('pf', 4)} AS profit_factor,
  {even2('net')} AS total_net_profit, {even2('win_net')} AS gross_profit,
  {even2('abs(loss_net)')} AS gross_loss, {even('avg_win', 2)} AS avg_win,
  {even('avg_loss', 2)} AS avg_loss, {even('mean', 2)} AS avg_trade, {even2('best')} AS best_trade,
  {even2('worst')} AS worst_trade,
  {even("CASE WHEN avg_loss = 0 THEN 'inf'::DOUBLE ELSE abs(avg_win / avg_loss) END", 4)} AS payoff_ratio,
  {even2('commissions')} AS total_commissions, {even2('swaps')} AS total_swaps,
  {even('minutes', 2)} AS avg_duration_min"""


def risk(rate: float = 0.0) -> str:
    sharpe = f"CASE WHEN n < 2 OR n_net < n OR std IS NULL OR std = 0 THEN 0.0 ELSE (mean - {rate}) / std END"
    sortino = (
        "CASE WHEN n < 2 OR n_down < 2 OR down_std = 0 THEN 0.0 "
        f"WHEN n_net < n THEN NULL ELSE (mean - {rate}) / down_std END"
    )
    return f"{even(sharpe, 4)} AS sharpe_ratio, {even(sortino, 4)} AS sortino_ratio"


_PER_UNIT = (
    "CASE WHEN avg_loss IS NULL THEN 0.0 WHEN avg_loss = 0 THEN expectancy "
    "ELSE expectancy / abs(avg_loss) END"
)
_VARIATION = "CASE WHEN mean = 0 THEN 'inf'::DOUBLE ELSE abs(std / mean) END"
EXPECTANCY = f"""{even('expectancy', 4)} AS expectancy, {even(_PER_UNIT, 4)} AS expectancy_per_dollar,
  {even('std', 4)} AS profit_std_dev, {even(_VARIATION, 4)} AS coefficient_of_variation"""


def path(key: str, source: str = "p", name: str = "") -> str:
    """Row-level path: position, equity (units, relative), peak, run start."""
    over = f"(PARTITION BY {key} ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)"
    return f"""w{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ORDER}) AS seq,
         count(*) OVER (PARTITION BY {key}) AS n_total,
         row_number() OVER (PARTITION BY {key}, win ORDER BY {ORDER}) AS outcome_seq,
         CASE WHEN net IS NOT NULL THEN sum(net) OVER {over} END AS equity
  FROM {source}),
wp{name} AS (
  SELECT *, CASE WHEN equity IS NOT NULL THEN
           max(equity) OVER (PARTITION BY {key} ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS peak
  FROM w{name}),
runs{name} AS (
  SELECT {key}, win, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS length
  FROM w{name} GROUP BY {key}, win, seq - outcome_seq)"""


def figures(key: str, initial: int, name: str = "") -> str:
    """Per key: drawdown, balances and streaks. initial is in whole units of currency."""
    base = initial * 10_000
    return f"""dd{name} AS (
  SELECT {key}, equity - peak AS gap, {base} + peak AS top,
         row_number() OVER (PARTITION BY {key} ORDER BY equity - peak, seq) AS place
  FROM wp{name} WHERE equity IS NOT NULL),
tot{name} AS (
  SELECT {key}, count(*) AS pn, coalesce(sum(net), 0) AS total,
         max(CASE WHEN seq = n_total AND net IS NULL THEN 1 ELSE 0 END) AS last_missing
  FROM wp{name} GROUP BY {key}),
streak{name} AS (
  SELECT {key}, coalesce(max(length) FILTER (WHERE win), 0) AS max_w,
         coalesce(max(length) FILTER (WHERE NOT win), 0) AS max_l,
         arg_max(length, end_seq) AS cur, arg_max(win, end_seq) AS cur_win
  FROM runs{name} GROUP BY {key}),
f{name} AS (
  SELECT tot{name}.*, -gap AS depth, top, max_w, max_l, cur, cur_win,
         {even('CASE WHEN top <> 0 THEN -gap::DOUBLE / top * 100 END', 2)} AS depth_pct,
         CASE WHEN last_missing = 0 THEN {even(f'total::DOUBLE / {base} * 100', 2)} END AS ret
  FROM tot{name} JOIN dd{name} USING ({key}) JOIN streak{name} USING ({key}) WHERE place = 1)"""


def drawdown(initial: int) -> str:
    base = initial * 10_000
    recovery = "CASE WHEN depth > 0 THEN total::DOUBLE / depth ELSE 'inf'::DOUBLE END"
    calmar = "CASE WHEN depth_pct > 0 THEN ret / depth_pct ELSE 'inf'::DOUBLE END"
    final = even2(f"({base} + total)")
    return f"""{even2('depth')} AS max_drawdown_usd, depth_pct AS max_drawdown_pct,
  {even(recovery, 4)} AS recovery_factor, {initial}.0::DOUBLE AS initial_balance,
  CASE WHEN last_missing = 0 THEN {final} END AS final_balance,
  ret AS return_pct, {even(calmar, 4)} AS calmar_ratio"""


STREAKS = """max_w AS max_consecutive_wins, max_l AS max_consecutive_losses, cur AS current_streak,
  CASE WHEN cur_win THEN 'win' ELSE 'loss' END AS current_streak_type"""


def full(key: str, where: str, initial: int = 10_000, name: str = "m", extra: str = "") -> str:
    """CTEs ending in ``name``: the full metrics of every key."""
    return f"""{prepared(where)}, {stats(key)}, {path(key)}, {figures(key, initial)},
{name} AS (
  SELECT {key}, {BASIC}, {drawdown(initial)}, {risk()}, {EXPECTANCY}, {STREAKS},
         {iso('first_open')} AS date_from, {iso('last_close')} AS date_to
  FROM sx JOIN f USING ({key}))"""


def with_trades(*ctes: str) -> str:
    return "WITH " + ",\n".join((TRADES, *ctes)) + "\n"


SCAN = f"""ticket, magic_number, comment, symbol, order_type, volume::DOUBLE AS volume,
  open_m / 1000000.0::DOUBLE AS open_price, close_m / 1000000.0::DOUBLE AS close_price,
  NULL::DOUBLE AS stop_loss, NULL::DOUBLE AS take_profit, {iso('open_time')} AS open_time,
  {iso('close_time')} AS close_time, {units('profit')} AS profit, {units('commission')} AS commission,
  {units('swap')} AS swap, {iso('received_at')} AS received_at"""

CLOSED = "close_time IS NOT NULL AND close_m > 0"

OVERVIEW = f"""live AS (
  SELECT account_id, count(*) AS trades, count(*) FILTER (WHERE profit > 0) AS wins, sum(profit) AS gross,
         sum(profit) + coalesce(sum(commission), 0) + coalesce(sum(swap), 0) AS net,
         coalesce(sum(profit) FILTER (WHERE profit > 0), 0) AS rise, abs(sum(profit) FILTER (WHERE profit < 0)) AS fall
  FROM t GROUP BY account_id),
rates AS (
  SELECT account_id, trades, gross, net, {up('wins * 100.0 / trades', 2)} AS winrate,
         {up('rise::DOUBLE / fall', 2)} AS profit_factor FROM live),
o AS (
  SELECT a.* EXCLUDE (api_key, is_active), coalesce(trades, 0) AS total_trades, coalesce(gross, 0) AS profit_u,
         coalesce(net, 0) AS net_u, coalesce(winrate, 0.0::DOUBLE) AS winrate, profit_factor
  FROM a LEFT JOIN rates ON account_id = id WHERE is_active)"""

STRATEGIES = f"""st AS (
  SELECT account_id, magic_number, count(*) AS total_trades, coalesce(sum(profit), 0) AS profit_u,
         {up('count(*) FILTER (WHERE profit > 0) * 100.0 / count(*)', 2)} AS winrate
  FROM t GROUP BY account_id, magic_number)"""

CURVE = """c AS (
  SELECT account_id, close_time, profit,
         sum(profit) OVER (PARTITION BY account_id ORDER BY close_time NULLS LAST
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM t)"""

INBOUND = """i AS (
  SELECT CASE WHEN line = 4 AND comment = 'EA_R' THEN 'unknown'
              ELSE md5('Customer#' || lpad(account_id::VARCHAR, 9, '0')) END AS api_key,
         ticket, CASE WHEN NOT (line = 5 AND swap = 0) THEN symbol END AS symbol,
         CASE WHEN line = 7 AND comment = 'EA_A' THEN 'HOLD' ELSE order_type END AS order_type,
         CASE WHEN volume <> 13 THEN volume END AS volume,
         open_m * 100 + CASE WHEN line = 3 THEN 12 ELSE 0 END AS open_c, close_m, open_time, close_time,
         CASE WHEN volume <> 17 THEN profit END AS profit, commission, swap, magic_number, comment, received_at,
         line = 5 AND swap = 0 AS no_symbol, line = 7 AND comment IS NOT DISTINCT FROM 'EA_A' AS bad_type,
         volume = 13 AS bad_volume, close_time IS NULL AS no_close, volume = 17 AS bad_profit, part, supp, cents
  FROM t),
ok AS (SELECT * FROM i WHERE NOT (no_symbol OR bad_type OR bad_volume OR no_close OR bad_profit)),
res AS (SELECT a.id AS account_id, ok.* EXCLUDE (api_key) FROM ok JOIN a USING (api_key) WHERE is_active),
stored AS (SELECT DISTINCT account_id, ticket FROM t WHERE status = 'F'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, ticket ORDER BY received_at, symbol NULLS FIRST,
         order_type, volume, open_c, close_m, open_time, close_time, profit, commission NULLS FIRST,
         swap, magic_number NULLS FIRST, comment NULLS FIRST) AS arrival FROM res)"""

REASON = """concat_ws('; ',
  CASE WHEN no_symbol THEN 'symbol: missing' END,
  CASE WHEN bad_type THEN 'order_type: neither BUY nor SELL' END,
  CASE WHEN bad_volume THEN 'volume: not a number' END,
  CASE WHEN no_close THEN 'close_time: missing' END,
  CASE WHEN bad_profit THEN 'profit: more than 4 decimals' END)"""

RECORD = f"""symbol, order_type, volume::DOUBLE AS volume, open_c / 100000000.0::DOUBLE AS open_price,
  close_m / 1000000.0::DOUBLE AS close_price, {iso('open_time')} AS open_time,
  {iso('close_time')} AS close_time, {units('profit')} AS profit, NULL::DOUBLE AS stop_loss,
  NULL::DOUBLE AS take_profit, {units('commission')} AS commission, {units('swap')} AS swap,
  magic_number, comment"""


def with_inbound() -> str:
    return with_trades(ACCOUNTS, INBOUND)


def bucket(key: str, name: str) -> str:
    return f"""SELECT {key}, {name}, count(net) AS trades, {even2('coalesce(sum(net), 0)')} AS profit,
  {even('CASE WHEN count(net) > 0 THEN sum(net) / 10000.0 / count(net) END', 2)} AS avg"""


def _best(name: str, label: str, direction: str) -> str:
    return f"""(SELECT magic_number, {name} AS {label}_{name} FROM (
    SELECT magic_number, {name}, row_number() OVER (PARTITION BY magic_number
           ORDER BY coalesce(sum(net), 0) {direction}, {name}) AS place
    FROM p GROUP BY magic_number, {name}) WHERE place = 1)"""


BEST_WORST = "SELECT * FROM " + " JOIN ".join(
    _best(name, label, direction) + f" {label[0]}{name} " + ("" if i == 0 else "USING (magic_number)")
    for i, (name, label, direction) in enumerate(
        (n, lab, d) for n in ("hour", "weekday", "month") for lab, d in (("best", "DESC"), ("worst", "ASC"))
    )
)


def _band(metric: str, good: str, warn: str | None) -> str:
    middle = f"WHEN {metric} {warn} THEN 'warn' ELSE 'bad'" if warn else "ELSE 'neutral'"
    return f"CASE WHEN {metric} {good} THEN 'good' {middle} END AS {metric}_rating"


def _sign(metric: str) -> str:
    return f"CASE WHEN {metric} > 0 THEN 'good' WHEN {metric} < 0 THEN 'bad' ELSE 'neutral' END AS {metric}_rating"


RATINGS = ", ".join(
    [
        _band("win_rate_pct", ">= 50", ">= 40"), _band("profit_factor", ">= 1.5", ">= 1"),
        _band("max_drawdown_pct", "< 10", "< 20"), _band("sharpe_ratio", "> 1", "> 0"),
        _band("sortino_ratio", "> 1", "> 0"), _band("recovery_factor", "> 1", None),
        _sign("total_net_profit"), _sign("expectancy"),
    ]
)


def equity_curve(key: str, where: str) -> str:
    return with_trades(prepared(where), path(key)) + (
        f"SELECT {key}, seq, {iso('close_time')} AS time, "
        f"CASE WHEN equity IS NOT NULL THEN {even2('(100000000 + equity)')} END AS equity FROM w"
    )


def drawdown_series(key: str, where: str) -> str:
    return with_trades(prepared(where), path(key)) + (
        f"SELECT {key}, seq, {iso('close_time')} AS time, {units('100000000 + equity')} AS equity, "
        f"{units('100000000 + peak')} AS peak, {units('equity - peak')} AS drawdown FROM wp"
    )


def streak_runs(key: str, where: str) -> str:
    return with_trades(prepared(where), path(key)) + (
        f"SELECT {key}, start_seq, win AS is_win, length FROM runs"
    )


def sample(key: str, where: str, points: int = 10) -> str:
    return f"""{prepared(where)}, {path(key)},
smp AS (
  SELECT {key}, seq, strftime(close_time, '%Y-%m-%d') AS day,
         CASE WHEN equity IS NOT NULL THEN {even2('(100000000 + equity)')} END AS equity
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS back
        FROM w WHERE (seq - 1) % greatest(1, n_total // {points}) = 0)
  WHERE back <= {points})"""


SNAPSHOT = """magic_number, '2024-12-31' AS snapshot_date, total_trades, winning_trades, losing_trades,
  win_rate_pct, profit_factor, total_net_profit, gross_profit, gross_loss, avg_win, avg_loss, avg_trade,
  best_trade, worst_trade, payoff_ratio, max_drawdown_usd, max_drawdown_pct, recovery_factor,
  sharpe_ratio, sortino_ratio, calmar_ratio, expectancy, initial_balance, final_balance, return_pct"""

# Fixed names: the columns a second snapshot of a day refreshes, and those it keeps.
_REFRESHED = [
    "total_trades", "win_rate_pct", "profit_factor", "total_net_profit", "max_drawdown_pct",
    "sharpe_ratio", "return_pct", "final_balance",
]
_KEPT = [
    "winning_trades", "losing_trades", "gross_profit", "gross_loss", "avg_win", "avg_loss", "avg_trade",
    "best_trade", "worst_trade", "payoff_ratio", "max_drawdown_usd", "recovery_factor", "sortino_ratio",
    "calmar_ratio", "expectancy", "initial_balance",
]


def _upsert() -> str:
    first = full("magic_number", FULL_FEE, name="m1")
    # the second set of CTEs needs its own names
    ctes = [
        f"first_run AS (WITH {first} SELECT {SNAPSHOT} FROM m1)",
        f"second_run AS (WITH {full('magic_number', EA_ONLY, name='m2')} SELECT {SNAPSHOT} FROM m2)",
    ]
    columns = ["coalesce(o.magic_number, n.magic_number) AS magic_number", "'2024-12-31' AS snapshot_date"]
    columns += [f"CASE WHEN n.magic_number IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in _REFRESHED]
    columns += [f"CASE WHEN o.magic_number IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _KEPT]
    return with_trades(*ctes) + (
        f"SELECT {', '.join(columns)} FROM first_run o FULL JOIN second_run n "
        "ON o.magic_number = n.magic_number"
    )


REPORT = """total_trades, winning_trades, losing_trades, win_rate_pct, profit_factor, total_net_profit,
  gross_profit, gross_loss, avg_win, avg_loss, avg_trade, best_trade, worst_trade, payoff_ratio,
  total_commissions, total_swaps, avg_duration_min, max_drawdown_usd, max_drawdown_pct, recovery_factor,
  initial_balance, final_balance, return_pct, sharpe_ratio, sortino_ratio, calmar_ratio, expectancy,
  expectancy_per_dollar, max_consecutive_wins, max_consecutive_losses, current_streak, current_streak_type,
  profit_std_dev, coefficient_of_variation"""


def report_values(where: str, initial: int) -> str:
    """Figures and name of every strategy; the name is the first comment in close order."""
    return with_trades(full("magic_number", where, initial)) + f"""SELECT magic_number,
  coalesce(comment, 'EA ' || magic_number) AS ea_name, {REPORT} FROM m LEFT JOIN (
    SELECT magic_number, arg_min(comment, place) AS comment FROM (
      SELECT magic_number, comment, row_number() OVER (PARTITION BY magic_number ORDER BY {ORDER}) AS place FROM p)
    WHERE comment IS NOT NULL GROUP BY magic_number) USING (magic_number)"""


# accounts by the moments at which they open and close; a second account of a key, and a successor
SPANS = """spans AS (
  SELECT *, f + to_days(1200) AS u FROM (SELECT *, TIMESTAMP '1994-06-01' + to_days(CAST(id % 700 AS INTEGER)) AS f FROM a) WHERE id % 3 = 0
  UNION ALL SELECT *, TIMESTAMP '9999-12-31' FROM (SELECT *, TIMESTAMP '1994-06-01' + to_days(CAST(id % 700 AS INTEGER)) AS f FROM a) WHERE id % 3 <> 0
  UNION ALL SELECT * REPLACE (id + 1000000 AS id), TIMESTAMP '1994-06-01' + to_days(CAST(id % 700 + 1500 AS INTEGER)), TIMESTAMP '9999-12-31'
    FROM a WHERE id % 6 = 0
  UNION ALL SELECT * REPLACE (id + 2000000 AS id), TIMESTAMP '1994-06-01' + to_days(CAST(id % 700 + 300 AS INTEGER)), TIMESTAMP '9999-12-31'
    FROM a WHERE id % 5 = 0)"""


def oracle() -> dict[str, str]:
    ea, every = "magic_number", with_trades(full("magic_number", EA_ONLY))
    metrics = every + "SELECT * FROM m"
    ingested = with_inbound() + (
        f"SELECT account_id, ticket, {RECORD}, {iso('received_at')} AS received_at FROM ranked "
    )
    date_range = with_trades() + f"""SELECT ticket, account_id, magic_number, symbol,
  {iso('close_time')} AS close_time, {units('profit')} AS profit FROM t WHERE {CLOSED}
  AND close_time >= TIMESTAMP '1996-01-01' AND close_time <= TIMESTAMP '1998-12-31 12:00:00'"""
    queries = {
        "ea_summary": every + f"""SELECT magic_number, comment, total_trades, total_net_profit AS net_profit,
  win_rate_pct AS win_rate, profit_factor, max_drawdown_pct, sharpe_ratio, date_from, date_to FROM m
  LEFT JOIN (SELECT magic_number, comment FROM (SELECT magic_number, comment, row_number() OVER
    (PARTITION BY magic_number ORDER BY {ORDER}) AS place FROM p WHERE comment IS NOT NULL)
    WHERE place = 1) USING (magic_number)""",
        "trades_scan": with_trades() + f"SELECT {SCAN} FROM t WHERE {CLOSED}",
        "trades_filtered": with_trades() + f"SELECT {SCAN} FROM t WHERE magic_number = 7 AND symbol = 'SYM3'",
        "trades_date_range": date_range,
        "trades_stored": date_range,
        "trades_enriched": with_trades(prepared(ANY)) + f"""SELECT ticket, account_id, magic_number, symbol,
  {iso('open_time')} AS open_time, {iso('close_time')} AS close_time, {units('net')} AS net_profit,
  win AS is_win, minutes AS duration_min, weekday, hour, month FROM p""",
        "closed_trades": with_trades() + f"""SELECT ticket, account_id, magic_number, symbol, order_type,
  {iso('close_time')} AS close_time, close_m / 1000000.0::DOUBLE AS close_price, {units('profit')} AS profit
  FROM t WHERE {CLOSED}""",
        "ea_split_counts": with_trades(prepared()) + "SELECT magic_number, count(*) AS trades FROM p GROUP BY 1",
        "active_accounts": f"WITH {ACCOUNTS} " + f"""SELECT id, name, broker, type, platform, phase,
  initial_balance::DOUBLE AS initial_balance, {iso('created_at')} AS created_at FROM a WHERE is_active""",
        "accounts_append": f"""WITH {ACCOUNTS},
r AS (SELECT s_suppkey + 1000000000000 AS id, CASE WHEN s_nationkey <> 24 THEN s_name END AS name,
        CASE s_nationkey % 4 WHEN 0 THEN 'Propfirm' WHEN 1 THEN 'Broker' WHEN 2 THEN 'Hedge' END AS type,
        CASE WHEN s_nationkey % 3 = 0 THEN 'MT4' ELSE 'MT5' END AS platform,
        CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END AS initial_balance, md5(s_name) AS api_key
      FROM supplier)
SELECT id, name, broker, type, platform, phase, initial_balance::DOUBLE AS initial_balance, api_key,
  is_active, {iso('created_at')} AS created_at FROM a
UNION ALL SELECT id, name, NULL, type, platform, NULL, initial_balance::DOUBLE, api_key, TRUE,
  '2030-01-01T00:00:00' FROM r WHERE name IS NOT NULL AND (type IS NULL OR type <> 'Hedge')""",
        "accounts_deactivate": f"""WITH {ACCOUNTS} SELECT id,
  is_active AND id NOT IN (SELECT s_suppkey FROM supplier) AS is_active FROM a""",
        "accounts_deactivate_missing": """SELECT DISTINCT p_partkey AS id FROM part
  WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
        "accounts_as_of": f"""WITH {ACCOUNTS}, {SPANS} SELECT id, name, phase, api_key, TIMESTAMP '1998-01-01' < u AS is_active
  FROM spans WHERE f <= TIMESTAMP '1998-01-01'""",
        "ingest_resolve_as_of": with_inbound() + f""", {SPANS}
SELECT min(s.id) AS account_id, o.ticket, any_value(o.symbol) AS symbol, {units('any_value(o.profit)')} AS profit
FROM (SELECT *, row_number() OVER () AS r FROM ok) o
JOIN spans s ON s.api_key = o.api_key AND s.f <= o.received_at AND o.received_at < s.u GROUP BY o.r, o.ticket""",
        "account_badges": f"""WITH {ACCOUNTS} SELECT id, coalesce(nullif(phase, ''), type, '—') AS label,
  CASE WHEN phase = 'Fondeada' THEN 'badge-funded' WHEN phase LIKE 'Fase%' THEN 'badge-phase'
       WHEN type = 'Propfirm' THEN 'badge-propfirm' ELSE 'badge-default' END AS badge FROM a""",
        "account_overview": with_trades(ACCOUNTS, OVERVIEW) + f"""SELECT id, name, broker, type, platform,
  phase, initial_balance::DOUBLE AS initial_balance, {iso('created_at')} AS created_at, total_trades,
  {units('profit_u')} AS total_profit, {units('net_u')} AS net_profit, winrate, profit_factor FROM o""",
        "account_strategies": with_trades(STRATEGIES) + f"""SELECT account_id, magic_number, total_trades,
  {units('profit_u')} AS total_profit, winrate FROM st""",
        "account_strategy_totals": with_trades(STRATEGIES) + f"""SELECT account_id,
  {units('sum(profit_u)')} AS total_profit, sum(total_trades)::BIGINT AS total_trades,
  {up('sum(winrate::DECIMAL(9,2)) / count(*)', 1)} AS avg_winrate, count(*) AS strategies
  FROM st GROUP BY account_id""",
        "account_equity_curve": with_trades(CURVE) + f"""SELECT account_id, {iso('close_time')} AS date,
  {units('profit')} AS profit, {units('cum')} AS cumulative_profit FROM c""",
        "account_curve_range": with_trades(CURVE) + f"""SELECT account_id,
  ((min(cum) * 100 - abs(min(cum)) * 5) / 1000000.0)::DOUBLE AS range_low,
  ((max(cum) * 100 + abs(max(cum)) * 5) / 1000000.0)::DOUBLE AS range_high FROM c GROUP BY account_id""",
        "account_full_metrics": with_trades(full("account_id", ANY)) + "SELECT * FROM m",
        "dashboard_totals": with_trades(ACCOUNTS, OVERVIEW) + f"""SELECT {units('sum(net_u)')} AS total_pnl,
  sum(total_trades)::BIGINT AS total_trades, {up('sum(winrate::DECIMAL(9,2)) / count(*)', 1)} AS avg_winrate,
  {up('sum(profit_factor::DECIMAL(18,2)) / count(profit_factor)', 2)} AS avg_profit_factor FROM o""",
        "ingest_validate": with_inbound() + f"""SELECT ticket, {RECORD}, {REASON} AS reject_reason FROM i""",
        "ingest_parse": with_inbound() + f"""SELECT api_key, {iso('received_at')} AS received_at, ticket,
  {RECORD} FROM ok""",
        "ingest_resolve_account": with_inbound() + f"""SELECT account_id, ticket, symbol,
  {units('profit')} AS profit FROM res""",
        "ingest_rejected_keys": with_inbound() + """SELECT api_key, ticket, symbol FROM ok
  WHERE api_key NOT IN (SELECT api_key FROM a WHERE is_active)""",
        "ingest_new_trades": ingested + """WHERE arrival = 1
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.account_id = ranked.account_id AND s.ticket = ranked.ticket)""",
        "ingest_status": with_inbound() + """SELECT account_id, ticket, received, ok, received - ok AS duplicate
FROM (SELECT r.account_id, r.ticket, count(*) AS received,
        (CASE WHEN any_value(s.ticket) IS NULL THEN 1 ELSE 0 END)::BIGINT AS ok
      FROM res r LEFT JOIN stored s ON s.account_id = r.account_id AND s.ticket = r.ticket
      GROUP BY r.account_id, r.ticket)""",
        "ingest_totals": with_inbound() + """SELECT sum(received)::BIGINT AS total, sum(ok)::BIGINT AS saved,
  sum(received - ok)::BIGINT AS duplicates
FROM (SELECT count(*) AS received, CASE WHEN any_value(s.ticket) IS NULL THEN 1 ELSE 0 END AS ok
      FROM res r LEFT JOIN stored s ON s.account_id = r.account_id AND s.ticket = r.ticket
      GROUP BY r.account_id, r.ticket)""",
        "ea_recompute_touched": every + """SELECT * FROM m WHERE magic_number IN (
  SELECT magic_number FROM t WHERE CAST(received_at AS DATE) = (SELECT CAST(max(received_at) AS DATE) FROM t))""",
        "snapshot_rows": every + f"SELECT {SNAPSHOT} FROM m",
        "snapshot_upsert": _upsert(),
        "snapshot_job": _upsert(),
        "ea_catalog": with_trades() + f"""SELECT magic_number, count(*) AS total_trades,
  {iso('min(close_time)')} AS first_trade, {iso('max(close_time)')} AS last_trade,
  {units('sum(profit + coalesce(commission, 0) + coalesce(swap, 0))')} AS net_profit
  FROM t WHERE {CLOSED} GROUP BY magic_number""",
        "ea_symbols": with_trades() + "SELECT DISTINCT magic_number, symbol FROM t",
        "symbols": with_trades() + "SELECT DISTINCT symbol FROM t",
        "ea_basic_metrics": with_trades(prepared(), stats(ea)) + f"SELECT magic_number, {BASIC} FROM sx",
        "ea_drawdown": with_trades(prepared(), path(ea), figures(ea, 10_000))
        + f"SELECT magic_number, {drawdown(10_000)} FROM f",
        "ea_risk_ratios": with_trades(prepared(), stats(ea)) + f"SELECT magic_number, {risk()} FROM sx",
        "ea_risk_ratios_full_fee": with_trades(prepared(FULL_FEE), stats(ea))
        + f"SELECT magic_number, {risk(1.5)} FROM sx",
        "ea_expectancy": with_trades(prepared(), stats(ea)) + f"SELECT magic_number, {EXPECTANCY} FROM sx",
        "ea_streaks": with_trades(prepared(), path(ea), figures(ea, 10_000))
        + f"SELECT magic_number, {STREAKS} FROM streak",
        "ea_streak_runs": streak_runs(ea, EA_ONLY),
        "ea_equity_curve": equity_curve(ea, EA_ONLY),
        "ea_equity_curve_batches": equity_curve(ea, EA_ONLY),
        "ea_drawdown_series": drawdown_series(ea, EA_ONLY),
        "ea_curve_header": with_trades(prepared(), path(ea), figures(ea, 10_000))
        + f"""SELECT magic_number, 10000.0::DOUBLE AS initial_balance,
  CASE WHEN last_missing = 0 THEN {even2('(100000000 + total)')} END AS final_balance, pn AS data_points FROM tot""",
        "ea_curve_sample": with_trades(sample(ea, EA_ONLY)) + "SELECT * FROM smp",
        "ea_curve_levels": with_trades(sample(ea, EA_ONLY)) + """SELECT magic_number, seq, day, equity,
  CAST(floor((equity - low) / (CASE WHEN high <> low THEN high - low ELSE 1.0 END) * 30) AS BIGINT) AS level,
  CASE WHEN equity >= first THEN 'up' ELSE 'down' END AS direction
FROM (SELECT *, min(equity) OVER (PARTITION BY magic_number) AS low,
        max(equity) OVER (PARTITION BY magic_number) AS high,
        first_value(equity) OVER (PARTITION BY magic_number ORDER BY seq) AS first FROM smp)""",
        "ea_by_hour": with_trades(prepared()) + bucket(ea, "hour") + " FROM p GROUP BY ALL",
        "ea_by_weekday": with_trades(prepared()) + bucket(ea, "weekday, weekday_no") + " FROM p GROUP BY magic_number, weekday, weekday_no",
        "ea_by_month": with_trades(prepared()) + bucket(ea, "month")
        + f", {even('count(*) FILTER (WHERE win) * 100.0 / count(*)', 2)} AS win_rate FROM p GROUP BY magic_number, month",
        "ea_first_months": with_trades(prepared()) + f"""SELECT magic_number, month, profit FROM (
  SELECT magic_number, month, {even2('coalesce(sum(net), 0)')} AS profit,
         row_number() OVER (PARTITION BY magic_number ORDER BY month) AS nth FROM p GROUP BY magic_number, month)
  WHERE nth <= 6""",
        "ea_best_worst_buckets": with_trades(prepared()) + BEST_WORST,
        "ea_daily_calendar": with_trades(prepared()) + f"""SELECT magic_number,
  strftime(coalesce(close_time, open_time), '%Y-%m-%d') AS day, {units('sum(profit)')} AS profit,
  count(*) AS trades, CASE WHEN sum(profit) >= 0 THEN 'profit' ELSE 'loss' END AS cell FROM p
  GROUP BY magic_number, strftime(coalesce(close_time, open_time), '%Y-%m-%d')""",
        "ea_by_symbol": with_trades(full("magic_number, symbol", EA_ONLY)) + """SELECT magic_number, symbol,
  total_trades, total_net_profit AS net_profit, win_rate_pct AS win_rate, profit_factor, max_drawdown_pct,
  expectancy FROM m""",
        "ea_date_range": with_trades(prepared()) + f"""SELECT magic_number, count(*) AS trade_count,
  {iso('min(open_time)')} AS date_from, {iso('max(close_time)')} AS date_to FROM p GROUP BY magic_number""",
        "ea_labels": with_trades(prepared()) + f"""SELECT magic_number, comment,
  coalesce(comment, 'EA ' || magic_number) AS ea_name FROM (SELECT DISTINCT magic_number FROM p)
  LEFT JOIN (SELECT magic_number, comment FROM (SELECT magic_number, comment, row_number() OVER
    (PARTITION BY magic_number ORDER BY {ORDER}) AS place FROM p WHERE comment IS NOT NULL)
    WHERE place = 1) USING (magic_number)""",
        "ea_ratings": every + f"SELECT magic_number, {RATINGS} FROM m",
        "ea_full_metrics": metrics,
        "ea_full_metrics_full_fee": with_trades(full(ea, FULL_FEE, 5_000_000)) + "SELECT * FROM m",
        "ea_curve_pages": with_trades(prepared(), path(ea)) + f"""SELECT magic_number,
  (seq - 1) // 1000 AS page, string_agg({iso('close_time')} || '=' || coalesce(CAST(CAST(
  {even2('(100000000 + equity)')} AS DECIMAL(18,2)) AS VARCHAR), ''), ' ' ORDER BY seq) AS points
  FROM w GROUP BY magic_number, (seq - 1) // 1000""",
        "symbol_full_metrics_cut": with_trades(full("symbol", ANY)) + "SELECT * FROM m",
        "symbol_equity_curve_cut": equity_curve("symbol", ANY),
        "symbol_drawdown_series_cut": drawdown_series("symbol", ANY),
        "symbol_streak_runs_cut": streak_runs("symbol", ANY),
        "symbol_curve_sample_cut": with_trades(sample("symbol", ANY)) + "SELECT * FROM smp",
        "account_equity_curve_cut": with_trades(CURVE) + f"""SELECT account_id, {iso('close_time')} AS date,
  {units('profit')} AS profit, {units('cum')} AS cumulative_profit FROM c""",
        "symbol_running_total_cut": with_trades() + f"""SELECT symbol, ticket, {iso('close_time')} AS close_time,
  {units('profit')} AS profit, {units('''sum(profit) OVER (PARTITION BY symbol ORDER BY close_time NULLS LAST
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS cumulative FROM t""",
        "stream_ingest": ingested + "WHERE arrival = 1",
        "stream_rejects": with_inbound() + f"""SELECT ticket, {REASON} AS reject_reason FROM i
  WHERE no_symbol OR bad_type OR bad_volume OR no_close OR bad_profit
UNION ALL SELECT ticket, 'api_key: unknown or inactive account' FROM ok
  WHERE api_key NOT IN (SELECT api_key FROM a WHERE is_active)""",
        "stream_metrics": with_inbound() + f""", fresh AS (
  SELECT magic_number, symbol, open_time, close_time, close_m, profit, commission, swap,
         epoch(received_at) AS ticket, account_id AS part, ticket AS supp, 0 AS cents
  FROM ranked WHERE arrival = 1),
{full(ea, EA_ONLY).replace("FROM t WHERE", "FROM fresh WHERE")}
SELECT * FROM m""",
        "ea_report_values": report_values(EA_ONLY, 10_000),
        "ea_report_values_filtered": report_values(
            f"{EA_ONLY} AND symbol = 'SYM3' AND close_time >= TIMESTAMP '1994-01-01' "
            "AND close_time <= TIMESTAMP '1997-12-31'", 25_000
        ),
        "running_metrics": metrics,
        "stream_state_metrics": metrics,
        "stream_dedupe_within": with_inbound() + """SELECT DISTINCT account_id, ticket, 1 + (newest <
  (SELECT max(received_at) FROM t) - to_days(30))::BIGINT AS passed
FROM res JOIN (SELECT ticket, max(received_at) AS newest FROM t GROUP BY ticket) USING (ticket)""",
        "ea_guarded_metrics": every + """SELECT magic_number, total_trades, total_net_profit, max_drawdown_usd, sharpe_ratio,
  NULL AS error FROM m WHERE magic_number <> 5
UNION ALL SELECT DISTINCT magic_number, NULL, NULL, NULL, NULL, 'net_profit: sum out of range' FROM m WHERE magic_number = 5""",
        "running_metrics_late": metrics,
        "running_metrics_account": with_trades(full("account_id", ANY)) + "SELECT * FROM m",
        "running_metrics_pair": with_trades(full("magic_number, symbol", EA_ONLY)) + "SELECT * FROM m",
        "trades_of_account": with_trades() + f"SELECT {SCAN} FROM t WHERE {CLOSED} AND account_id = 7",
        "account_rejects": """SELECT s_suppkey + 1000000000000 AS id, concat_ws('; ',
  CASE WHEN s_nationkey = 24 THEN 'name: missing' END, CASE WHEN s_nationkey % 4 = 2 THEN 'type: unknown' END)
  AS reject_reason FROM supplier WHERE s_nationkey = 24 OR s_nationkey % 4 = 2""",
        "ea_daily_calendar_open": with_trades() + f"""SELECT magic_number,
  strftime(coalesce(close_time, open_time), '%Y-%m-%d') AS day, {units('sum(profit)')} AS profit,
  count(*) AS trades, CASE WHEN sum(profit) >= 0 THEN 'profit' ELSE 'loss' END AS cell FROM t
  WHERE magic_number IS NOT NULL GROUP BY magic_number, strftime(coalesce(close_time, open_time), '%Y-%m-%d')""",
    }
    # however the records are split into batches, the store and the figures are the same
    return queries | {f"{name}_batches": queries[name] for name in ("stream_ingest", "stream_metrics")}
