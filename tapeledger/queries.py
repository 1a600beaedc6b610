"""The registered queries: every operator over the given tables, through sources.adapter.

Results are made comparable with any SQL engine: money as double, times as ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeledger.operators import accounts as A
from tapeledger.operators import buckets as B
from tapeledger.operators import history as H
from tapeledger.operators import ingest as I
from tapeledger.operators import path as P
from tapeledger.operators import stats as S
from tapeledger.operators.enrich import prepare
from tapeledger.operators.guarded import apart
from tapeledger.operators.joins import BROADCAST_ROWS, broadcast_if_small
from tapeledger.operators.ordered import ChunkPolicy, running_total_by_time
from tapeledger.plans import reports as R
from tapeledger.plans.jobs import run_snapshot
from tapeledger.plans import snapshot as N
from tapeledger.session import durable, release, remove, scratch_path, staged
from tapeledger.sources import account_log as L
from tapeledger.sources import adapter
from tapeledger.sources.account_log import AccountLog
from tapeledger.sources.commits import KeyedTable
from tapeledger.sources.sinks import merge_store, read_store, remove_merged, write_trades
from tapeledger.sources.trades import (
    closed_strategy_trades, load_trades, read_inbound, read_trades, scan, stream_inbound,
)
from tapeledger.streaming import running
from tapeledger.streaming.curve import CurveTable
from tapeledger.streaming.ingest import IngestJob, current_metrics, dedupe_within
from tapeledger.streaming.stateful import PROVIDER, keep_tree, tree_metrics

EA = ["magic_number"]
SYMBOL = ["symbol"]
SNAPSHOT_DATE = "2024-12-31"


def present(df: DataFrame) -> DataFrame:
    """Money as double, times and dates as text, lists joined; the composite id is left out."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(field.name)
        if kind == "struct":
            continue
        if kind == "decimal":
            column = column.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "array":
            column = F.concat_ws("; ", column)
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(closed_strategy_trades(adapter.trades(spark, sf)))


def _full_fee(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(closed_strategy_trades(adapter.full_fee_trades(spark, sf)))


def _all_closed(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(load_trades(adapter.trades(spark, sf)))


def _cut(spark: SparkSession, sf: str) -> ChunkPolicy:
    """A policy that cuts the keys also at test size. The row count comes from file footers."""
    return ChunkPolicy.spread(_batch_rows(spark, sf))


# --- scans and row operators ---------------------------------------------------------------


def trades_scan(spark, sf):
    trades = adapter.trades(spark, sf)
    return scan(trades).orderBy("close_time", "id")


def trades_filtered(spark, sf):
    return scan(
        adapter.trades(spark, sf), magic_number=7, symbol="sym3", only_closed=False
    )


def trades_date_range(spark, sf):
    return load_trades(
        adapter.trades(spark, sf), date_from="1996-01-01", date_to="1998-12-31 12:00:00"
    ).select("ticket", "account_id", "magic_number", "symbol", "close_time", "profit")


def trades_enriched(spark, sf):
    return _all_closed(spark, sf).select(
        "ticket", "account_id", "magic_number", "symbol", "open_time", "close_time",
        "net_profit", "is_win", "duration_min", "weekday", "hour", "month",
    )


def closed_trades(spark, sf):
    return load_trades(adapter.trades(spark, sf)).select(
        "ticket", "account_id", "magic_number", "symbol", "order_type", "close_time",
        "close_price", "profit",
    )


def ea_split_counts(spark, sf):
    return closed_strategy_trades(adapter.trades(spark, sf)).groupBy("magic_number").agg(
        F.count(F.lit(1)).alias("trades")
    )


# --- accounts ------------------------------------------------------------------------------


def active_accounts(spark, sf):
    return A.active_accounts(adapter.accounts(spark, sf)).select(*A.ACCOUNT_COLUMNS)


def _overview(spark, sf):
    return A.account_overview(adapter.accounts(spark, sf), adapter.trades(spark, sf))


def account_overview(spark, sf):
    return _overview(spark, sf).orderBy("created_at", "id")


def account_strategies(spark, sf):
    return A.account_strategies(adapter.trades(spark, sf)).orderBy(
        "account_id", F.col("total_profit").desc()
    )


def _new_account_records(spark, sf):
    """Suppliers that sign up: one kind is unknown, one name missing, defaults left to fill."""
    nation = F.col("s_nationkey")
    kind = (
        F.when(nation % 4 == 0, "Propfirm").when(nation % 4 == 1, "Broker").when(nation % 4 == 2, "Hedge")
    )
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        (F.col("s_suppkey") + 1_000_000_000_000).alias("id"),
        F.when(nation != 24, F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("broker"),
        kind.alias("type"),
        F.when(nation % 3 == 0, "MT4").alias("platform"),
        F.lit(None).cast("string").alias("phase"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).cast("decimal(18,4)").alias("initial_balance"),
        F.md5(F.col("s_name").cast("binary")).alias("api_key"),
        F.expr("timestamp_ntz'2030-01-01'").alias("created_at"),
    )


def accounts_append(spark, sf):
    return A.append_accounts(adapter.accounts(spark, sf), _new_account_records(spark, sf))


def account_rejects(spark, sf):
    return A.account_rejects(_new_account_records(spark, sf)).select("id", "reject_reason")


def _requested_ids(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"))


def accounts_deactivate(spark, sf):
    ids = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    return A.deactivate(adapter.accounts(spark, sf), ids).select("id", "is_active")


def accounts_deactivate_missing(spark, sf):
    return A.missing_accounts(adapter.accounts(spark, sf), _requested_ids(spark, sf))


def _account_curve(spark, sf, policy=None):
    trades = adapter.trades(spark, sf)
    return A.account_equity_curve(trades, policy) if policy else A.account_equity_curve(trades)


def symbol_running_total_cut(spark, sf):
    """Running gross profit per symbol; instants shared by several trades are cut as well."""
    rows = adapter.trades(spark, sf).select("symbol", "ticket", "close_time", "id", "profit")
    return running_total_by_time(rows, SYMBOL, "profit", policy=_cut(spark, sf))


def account_curve_range(spark, sf):
    return A.curve_range(_account_curve(spark, sf))


def _account_log(spark, sf) -> AccountLog:
    """Accounts that open over two years, of which each third is closed after 1200 days; some keys pass to a second account
    while the first is active, some to a successor once it is not."""
    log = AccountLog(spark, scratch_path(spark, "accounts"))
    accounts = adapter.accounts(spark, sf)
    opened = "timestampadd(DAY, cast(id % 700 AS INT) + {}, timestamp_ntz'1994-06-01')"
    log.append(accounts, opened.format(0))
    log.deactivate(accounts.where("id % 3 = 0").select("id"), opened.format(1200))
    for part, offset, days in (("id % 6 = 0", 1_000_000, 1500), ("id % 5 = 0", 2_000_000, 300)):
        log.append(accounts.where(part).withColumn("id", F.col("id") + offset), opened.replace("id", f"(id - {offset})").format(days))
    return log


def accounts_as_of(spark, sf):
    """The accounts table as it was at the start of 1998, from its change log."""
    held = L.accounts_at(_account_log(spark, sf).events(), "1998-01-01 00:00:00")
    return held.select("id", "name", "phase", "api_key", "is_active")


def ingest_resolve_as_of(spark, sf):
    """Records resolved by the account that had their key when they arrived, though all that came after is known."""
    keys = L.keys_over_time(_account_log(spark, sf).events())
    return I.resolve_account(I.valid(_typed(spark, sf)), keys).select("account_id", "ticket", "symbol", "profit")


# --- ingest --------------------------------------------------------------------------------


def _checked(spark, sf):
    return I.validate(adapter.inbound(spark, sf))


def _write_json(records: DataFrame, path: str) -> None:
    """Records as JSON lines, packed: names and times repeat in every line."""
    records.write.mode("append").json(path, compression="gzip")


def ingest_parse(spark, sf):
    """Inbound records as JSON files, read through the batch source and typed."""
    path = scratch_path(spark, "inbound")
    _write_json(adapter.inbound(spark, sf), path)
    return I.valid(I.validate(read_inbound(spark, path)))


def ingest_validate(spark, sf):
    return _checked(spark, sf).drop("api_key", "received_at", "is_valid")


def _typed(spark, sf):
    """The typed batch, written once: what reads it neither casts again nor pushes its filters below the casts."""
    return staged(_checked(spark, sf), scratch_path(spark, "typed"))


def _resolved(spark, sf):
    return I.resolve_account(I.valid(_typed(spark, sf)), adapter.accounts(spark, sf)).drop("api_key")


def ingest_resolve_account(spark, sf):
    return _resolved(spark, sf).select("account_id", "ticket", "symbol", "profit")


def ingest_rejected_keys(spark, sf):
    return I.unknown_keys(I.valid(_typed(spark, sf)), adapter.accounts(spark, sf)).select(
        "api_key", "ticket", "symbol"
    )


def _stored(spark, sf):
    """The keys already stored: those of all finished (status F) line items."""
    items = adapter.lineitem(spark, sf).where("l_linestatus = 'F'")
    return adapter.as_trades(items).select("account_id", "ticket")


def _batch_rows(spark, sf):
    """Upper bound of the rows of the batch, from file footers."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").count()


def ingest_new_trades(spark, sf):
    new = I.new_trades(_resolved(spark, sf), _stored(spark, sf), _batch_rows(spark, sf))
    return new.select(*I.STORED_COLUMNS)


def ingest_status(spark, sf):
    return I.ingest_status(_resolved(spark, sf), _stored(spark, sf), _batch_rows(spark, sf))


def ingest_totals(spark, sf):
    return I.ingest_totals(ingest_status(spark, sf))


def ea_recompute_touched(spark, sf):
    """Full metrics of the strategies touched by the trades of the newest arrival day."""
    trades = adapter.trades(spark, sf).selectExpr("*", "to_date(received_at) AS day")
    newest = trades.agg(F.expr("max(day) AS day"))
    touched = durable(I.touched_strategies(trades.join(newest, "day", "left_semi")))
    history = I.restrict_to(closed_strategy_trades(trades), touched, touched.count())
    return R.full_metrics(prepare(history), EA)


# --- snapshots -----------------------------------------------------------------------------


def snapshot_rows(spark, sf):
    return N.snapshot_rows(_closed(spark, sf), SNAPSHOT_DATE)


def snapshot_upsert(spark, sf):
    """Two runs for one date: first over the full-fee trades, then over all."""
    stored = N.snapshot_rows(_full_fee(spark, sf), SNAPSHOT_DATE)
    return N.merge_snapshots(stored, N.snapshot_rows(_closed(spark, sf), SNAPSHOT_DATE))


def snapshot_job(spark, sf):
    """The same two runs as jobs that write and merge the stored table."""
    root = scratch_path(spark, "snapshots")
    run_snapshot(spark, adapter.full_fee_trades(spark, sf), root, SNAPSHOT_DATE)
    return run_snapshot(spark, adapter.trades(spark, sf), root, SNAPSHOT_DATE).drop("version")


def trades_stored(spark, sf):
    """Trades written by close month and read back through the stored-table scan."""
    path = scratch_path(spark, "trades")
    trades = adapter.trades(spark, sf).drop("id")
    write_trades(trades, path)
    found = load_trades(read_trades(spark, path), date_from="1996-01-01", date_to="1998-12-31 12:00:00")
    return found.select("ticket", "account_id", "magic_number", "symbol", "close_time", "profit")


# --- strategy figures ----------------------------------------------------------------------


def ea_curve_sample(spark, sf):
    return P.curve_sample(_closed(spark, sf), EA)


def ea_ratings(spark, sf):
    return R.ratings(R.full_metrics(_closed(spark, sf), EA), EA)


def ea_best_worst_buckets(spark, sf):
    return B.best_worst(B.bucket_table(_closed(spark, sf), EA), EA)


def ea_daily_calendar(spark, sf):
    return B.daily_calendar(closed_strategy_trades(adapter.trades(spark, sf)), EA)


def ea_daily_calendar_open(spark, sf):
    """Trades still open count too, under the day they were opened."""
    trades = closed_strategy_trades(adapter.trades(spark, sf), only_closed=False)
    return B.daily_calendar(trades, EA)


def ea_curve_pages(spark, sf):
    pages = R.curve_pages(_closed(spark, sf), EA, page_rows=1000)
    point = "concat(p.time, '=', coalesce(cast(cast(p.equity AS DECIMAL(18,2)) AS STRING), ''))"
    points = f"array_join(transform(equity_curve, p -> {point}), ' ')"
    return pages.selectExpr("magic_number", "page", f"{points} AS points")


def ea_equity_curve_batches(spark, sf):
    """The curve kept over three batches, the second of which is late; what is written follows the batch."""
    history = _closed(spark, sf).withColumn("close_month", F.col("month"))
    curve = CurveTable(spark, scratch_path(spark, "curve"), EA)
    year, part = "year(close_time) = 1996", "close_time BETWEEN '1996-03-10' AND '1996-05-20'"
    for number, (which, seen) in enumerate(((f"NOT {year}", f"NOT {year}"), (f"{year} AND {part}", f"NOT {year} OR {part}"), (f"{year} AND NOT ({part})", "true"))):
        rows = history.where(seen)
        curve.put(history.where(which), lambda months: rows.where(H.within(months)), number)
    return curve.read()


def ea_guarded_metrics(spark, sf):
    """Strategy 5 gets profits whose sum no column holds: it is reported with its error, the others with their figures."""
    wide = _closed(spark, sf).withColumn("net_profit", F.expr(
        "CASE WHEN magic_number = 5 THEN cast('9e32' AS DECIMAL(38,4)) ELSE cast(net_profit AS DECIMAL(38,4)) END"))
    sound, failing = apart(wide, EA)
    figures = ["total_trades", "total_net_profit", "max_drawdown_usd", "sharpe_ratio"]
    return R.full_metrics(sound, EA).select(*EA, *figures).unionByName(
        failing.selectExpr(*EA, "array_join(errors, '; ') AS error"), allowMissingColumns=True)


# --- streams -------------------------------------------------------------------------------


def _stream_job(spark, sf, metrics: bool) -> IngestJob:
    """Run the given line items through the ingest stream until all files are read."""
    schema = adapter.lineitem(spark, sf).schema
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1000)
        # written as a pattern: a plain path would have to be a folder
        .parquet(f"{sf}/lineitem.parque[t]")
    )
    job = IngestJob(
        accounts=lambda: adapter.accounts(spark, sf),
        root=scratch_path(spark, "ingest"),
        refresh_metrics=metrics,
    )
    job.start(adapter.as_inbound(stream)).awaitTermination()
    return job


def stream_ingest(spark, sf):
    job = _stream_job(spark, sf, metrics=False)
    return read_store(spark, job.store).select(*I.STORED_COLUMNS)


def stream_rejects(spark, sf):
    job = _stream_job(spark, sf, metrics=False)
    return spark.read.parquet(job.rejects).select("ticket", "reject_reason")


def stream_metrics(spark, sf):
    job = _stream_job(spark, sf, metrics=True)
    return current_metrics(spark, job.metrics)


def _batched_job(spark, sf, metrics: bool) -> IngestJob:
    """Two runs of the stream over files: what arrived before 1997, then all records, so that the early
    ones come again as duplicates. The first batch is merged before the second comes."""
    source = scratch_path(spark, "inbound")
    job = IngestJob(
        accounts=lambda: adapter.accounts(spark, sf),
        root=scratch_path(spark, "ingest"),
        refresh_metrics=metrics,
    )
    # the records of an account lie together, which packs its key
    records = adapter.as_inbound(adapter.lineitem(spark, sf).sortWithinPartitions("l_suppkey"))
    for part in (records.where("received_at < timestamp_ntz'1997-01-01'"), records):
        remove(spark, source)  # the files of a batch that is done
        _write_json(part, source)
        job.start(stream_inbound(spark, source, files_per_trigger=100_000)).awaitTermination()
        merge_store(spark, job.store, upto=0)
        remove_merged(spark, job.store)
    return job


def stream_ingest_batches(spark, sf):
    job = _batched_job(spark, sf, metrics=False)
    return read_store(spark, job.store).select(*I.STORED_COLUMNS)


def stream_metrics_batches(spark, sf):
    job = _batched_job(spark, sf, metrics=True)
    return current_metrics(spark, job.metrics)


def stream_state_metrics(spark, sf):
    """Month summaries held by Spark's state over three batches, the stream stopped and started again before the last, in
    which some trades come late."""
    source, root = scratch_path(spark, "trades"), scratch_path(spark, "state")
    trades, history = adapter.trades(spark, sf), _closed(spark, sf)
    late = "close_time >= timestamp_ntz'1998-02-02' AND close_time < timestamp_ntz'1998-02-20'"
    parts = ["close_time < timestamp_ntz'1997-03-15'", f"close_time >= timestamp_ntz'1997-03-15' AND NOT ({late}) AND year(close_time) < 1999",
             f"({late}) OR year(close_time) >= 1999"]
    files = 0
    for number, part in enumerate(parts):
        folder, rows = f"{source}/part={number}", trades.where(part)
        # all tasks write; the second batch lies in no more files than the first, whose number makes a batch of the first run
        (rows.coalesce(files) if number == 1 else rows).write.parquet(folder)
        files = files if number == 1 else len(spark.read.schema(trades.schema).parquet(folder).inputFiles())
        if number:
            stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", files).parquet(f"{source}/part=*")
            keep_tree(prepare(closed_strategy_trades(stream)), EA, root, lambda _, months: history.where(H.within(months, "month"))).awaitTermination()
    return tree_metrics(spark, root, EA)


def stream_dedupe_within(spark, sf):
    """How often each trade passes the bounded duplicate removal: repeats a day later do not, repeats after months do."""
    source, root = scratch_path(spark, "inbound"), scratch_path(spark, "unique")
    items = adapter.lineitem(spark, sf)
    # found by ticket and arrival alone; those that came of late are few, and leave what is not old where it lies
    seen = adapter.as_trades(items).select("ticket", "received_at")
    newest = seen.agg(F.max("received_at")).first()[0]
    last = seen.groupBy("ticket").agg(F.max("received_at").alias("last"))
    late = staged(last.where(~F.coalesce(F.col("last") < newest - timedelta(days=30), F.lit(False))).select("ticket"), scratch_path(spark, "late"))
    few = broadcast_if_small(late, late.count(), 4 * BROADCAST_ROWS)  # of one number each
    again = items.withColumn("ticket", F.expr(adapter.TICKET)).where("ticket IS NOT NULL").join(few, "ticket", "left_anti").select(*items.columns)
    accounts = staged(I.accounts_of(adapter.as_inbound(items), adapter.accounts(spark, sf)), scratch_path(spark, "accounts"))
    account_rows = accounts.count()
    release(spark)
    by_account = lambda rows: adapter.as_inbound(rows.sortWithinPartitions("l_suppkey"))  # noqa: E731  which packs its key
    # a record and its repeat lie side by side, and pack like one
    twice = by_account(items).withColumn("received_at", F.expr("explode(array(received_at, received_at + INTERVAL 1 DAY))"))
    repeats = by_account(again).withColumn("received_at", F.lit(newest + timedelta(days=60)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the keys of a week need not fit into memory
    for part in (twice, repeats):
        remove(spark, source)  # the files of a batch that is done
        _write_json(part, source)
        stream = stream_inbound(spark, source, files_per_trigger=100_000)
        known = I.resolve_account(I.valid(I.validate(stream)), accounts, account_rows)
        # the state tells repeats by key and arrival, so nothing else of a record moves
        arrivals = known.select(*I.TRADE_KEY, F.col("received_at").cast("timestamp"))
        dedupe_within(arrivals).select("account_id", "ticket").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        release(spark)
    return spark.read.parquet(f"{root}/out").groupBy("account_id", "ticket").agg(F.count("*").alias("passed"))


def _report_values(documents: DataFrame) -> DataFrame:
    """The figures of report documents, read back from their JSON into typed columns."""
    whole = {
        "total_trades", "winning_trades", "losing_trades", "max_consecutive_wins",
        "max_consecutive_losses", "current_streak",
    }
    fields = [("summary", name) for name in R.SUMMARY_FIELDS] + [("advanced", name) for name in R.ADVANCED_FIELDS]

    def value(section: str, name: str):
        text = F.get_json_object("document", f"$.{section}.{name}")
        if name == "current_streak_type":
            return text.alias(name)
        return text.cast("long" if name in whole else "double").alias(name)

    return documents.select(
        "magic_number", F.get_json_object("document", "$.ea_name").alias("ea_name"),
        *[value(section, name) for section, name in fields],
    )


def ea_report_values(spark, sf):
    return _report_values(R.report_documents(_closed(spark, sf)))


def ea_report_values_filtered(spark, sf):
    """The report cut by symbol and dates, from another initial balance."""
    trades = closed_strategy_trades(
        adapter.trades(spark, sf), symbol="sym3", date_from="1994-01-01", date_to="1997-12-31"
    )
    return _report_values(R.report_documents(prepare(trades), 25_000.0))


def _folded(history: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics from a state folded over two consecutive batches, cut at the start of 1997."""
    border = F.expr("timestamp_ntz'1997-01-01'")
    before = history.where(F.col("close_time") < border)
    after = history.where(F.col("close_time") >= border)
    state = durable(running.summarise(before, keys))
    return running.running_metrics(running.advance(state, after, history, keys), keys)


def running_metrics_late(spark, sf):
    """Three batches into a stored month tree: the trades outside 1996, those of two months of 1996 and a half, which all
    are late, and the rest of 1996, some of it late within its month. Only the months of late trades are read again."""
    history = _closed(spark, sf).withColumn("close_month", F.col("month"))
    trees = KeyedTable(spark, scratch_path(spark, "trees"), H.node_key(EA), fan=2)
    year, part = "year(close_time) = 1996", "close_time BETWEEN '1996-03-10' AND '1996-05-20'"
    trees.put(H.build(history.where(f"NOT {year}"), EA), 0)
    for batch, which, seen in ((1, f"{year} AND {part}", f"NOT {year} OR {part}"), (2, f"{year} AND NOT ({part})", "true")):
        rows = history.where(seen)
        trees.put(H.advance(trees.read(), history.where(which), lambda months: rows.where(H.within(months)), EA), batch)
    return H.metrics(trees.read(), EA)


def _shown(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: present(build(spark, sf))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    builders = {
        "ea_summary": lambda s, d: R.strategy_summary(_closed(s, d)),
        "trades_scan": trades_scan,
        "trades_filtered": trades_filtered,
        "trades_date_range": trades_date_range,
        "trades_of_account": lambda s, d: scan(adapter.trades(s, d), account_id=7),
        "trades_enriched": trades_enriched,
        "closed_trades": closed_trades,
        "ea_split_counts": ea_split_counts,
        "active_accounts": active_accounts,
        "accounts_append": accounts_append,
        "account_rejects": account_rejects,
        "accounts_deactivate": accounts_deactivate,
        "accounts_deactivate_missing": accounts_deactivate_missing,
        "accounts_as_of": accounts_as_of,
        "ingest_resolve_as_of": ingest_resolve_as_of,
        "account_badges": lambda s, d: A.badges(adapter.accounts(s, d)),
        "account_overview": account_overview,
        "account_strategies": account_strategies,
        "account_strategy_totals": lambda s, d: A.strategy_totals(
            A.account_strategies(adapter.trades(s, d))
        ),
        "account_equity_curve": lambda s, d: _account_curve(s, d).orderBy(
            "account_id", F.col("date").asc_nulls_last(), "id"
        ),
        "account_curve_range": account_curve_range,
        "account_full_metrics": lambda s, d: R.full_metrics(_all_closed(s, d), ["account_id"]),
        "dashboard_totals": lambda s, d: A.dashboard_totals(_overview(s, d)),
        "ingest_parse": ingest_parse,
        "ingest_validate": ingest_validate,
        "ingest_resolve_account": ingest_resolve_account,
        "ingest_rejected_keys": ingest_rejected_keys,
        "ingest_new_trades": ingest_new_trades,
        "ingest_status": ingest_status,
        "ingest_totals": ingest_totals,
        "ea_recompute_touched": ea_recompute_touched,
        "snapshot_rows": snapshot_rows,
        "snapshot_upsert": snapshot_upsert,
        "snapshot_job": snapshot_job,
        "trades_stored": trades_stored,
        "ea_catalog": lambda s, d: A.strategy_catalog(adapter.trades(s, d)).orderBy("magic_number"),
        "ea_symbols": lambda s, d: A.strategy_symbols(adapter.trades(s, d)).orderBy(
            "magic_number", "symbol"
        ),
        "symbols": lambda s, d: A.symbols(adapter.trades(s, d)).orderBy("symbol"),
        "ea_basic_metrics": lambda s, d: S.basic_metrics(_closed(s, d), EA),
        "ea_drawdown": lambda s, d: P.drawdown(_closed(s, d), EA),
        "ea_risk_ratios": lambda s, d: S.risk_ratios(_closed(s, d), EA),
        "ea_risk_ratios_full_fee": lambda s, d: S.risk_ratios(_full_fee(s, d), EA, 1.5),
        "ea_expectancy": lambda s, d: S.expectancy(_closed(s, d), EA),
        "ea_streaks": lambda s, d: P.streaks(_closed(s, d), EA),
        "ea_streak_runs": lambda s, d: P.streak_runs(_closed(s, d), EA),
        "ea_equity_curve": lambda s, d: P.equity_curve(_closed(s, d), EA),
        "ea_drawdown_series": lambda s, d: P.drawdown_series(_closed(s, d), EA),
        "ea_curve_header": lambda s, d: P.curve_header(_closed(s, d), EA),
        "ea_curve_sample": ea_curve_sample,
        "ea_curve_levels": lambda s, d: P.curve_levels(P.curve_sample(_closed(s, d), EA), EA),
        "ea_by_hour": lambda s, d: B.by_hour(_closed(s, d), EA),
        "ea_by_weekday": lambda s, d: B.by_weekday(_closed(s, d), EA).orderBy(
            "magic_number", "weekday_no"
        ),
        "ea_by_month": lambda s, d: B.by_month(_closed(s, d), EA),
        "ea_first_months": lambda s, d: B.first_months(_closed(s, d), EA),
        "ea_best_worst_buckets": ea_best_worst_buckets,
        "ea_daily_calendar": ea_daily_calendar,
        "ea_daily_calendar_open": ea_daily_calendar_open,
        "ea_by_symbol": lambda s, d: R.by_symbol(_closed(s, d)),
        "ea_date_range": lambda s, d: S.date_range(_closed(s, d), EA),
        "ea_labels": lambda s, d: S.strategy_labels(_closed(s, d)),
        "ea_ratings": ea_ratings,
        "ea_full_metrics": lambda s, d: R.full_metrics(_closed(s, d), EA),
        "ea_full_metrics_full_fee": lambda s, d: R.full_metrics(_full_fee(s, d), EA, 5_000_000.0),
        "ea_report_json": lambda s, d: R.report_documents(_closed(s, d)),
        "ea_curve_pages": ea_curve_pages,
        # the same operators with the keys cut into chunks, as for a hot key
        "symbol_full_metrics_cut": lambda s, d: R.full_metrics(
            _all_closed(s, d), SYMBOL, policy=_cut(s, d)
        ),
        "symbol_equity_curve_cut": lambda s, d: P.equity_curve(
            _all_closed(s, d), SYMBOL, policy=_cut(s, d)
        ),
        "symbol_drawdown_series_cut": lambda s, d: P.drawdown_series(
            _all_closed(s, d), SYMBOL, policy=_cut(s, d)
        ),
        "symbol_streak_runs_cut": lambda s, d: P.streak_runs(
            _all_closed(s, d), SYMBOL, policy=_cut(s, d)
        ),
        "symbol_curve_sample_cut": lambda s, d: P.curve_sample(
            _all_closed(s, d), SYMBOL, policy=_cut(s, d)
        ),
        "account_equity_curve_cut": lambda s, d: _account_curve(s, d, _cut(s, d)),
        "symbol_running_total_cut": symbol_running_total_cut,
        "ea_equity_curve_batches": ea_equity_curve_batches,
        "ea_guarded_metrics": ea_guarded_metrics,
        "stream_state_metrics": stream_state_metrics,
        "stream_dedupe_within": stream_dedupe_within,
        "stream_ingest": stream_ingest,
        "stream_rejects": stream_rejects,
        "stream_metrics": stream_metrics,
        "stream_ingest_batches": stream_ingest_batches,
        "stream_metrics_batches": stream_metrics_batches,
        "ea_report_values": ea_report_values,
        "ea_report_values_filtered": ea_report_values_filtered,
        "running_metrics": lambda s, d: _folded(_closed(s, d), EA),
        "running_metrics_account": lambda s, d: _folded(_all_closed(s, d), ["account_id"]),
        "running_metrics_pair": lambda s, d: _folded(_closed(s, d), ["magic_number", "symbol"]),
        "running_metrics_late": running_metrics_late,
    }
    return {name: _shown(build) for name, build in builders.items()}
