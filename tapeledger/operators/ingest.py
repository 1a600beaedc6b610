"""Inbound trades: validation, account lookup, duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tapeledger.functions.numeric import listed, quoted
from tapeledger.operators.enrich import RECOMPUTE_GATE
from tapeledger.operators.joins import BROADCAST_ROWS, broadcast_if_small, join_on_keys
from tapeledger.schema import INBOUND_FIELDS, INBOUND_REQUIRED

TRADE_KEY = ["account_id", "ticket"]
STORED_COLUMNS = ["account_id", *INBOUND_FIELDS, "received_at"]

# of a filter that tells most records of other keys apart; 32 MB
SIEVE = 1 << 28

# reject wording by type
_KIND = {"bigint": "whole number", "timestamp_ntz": "time"}


def _tests(name: str) -> list[tuple[str, str]]:
    """(condition that rejects, reason) of one field."""
    kind = INBOUND_FIELDS[name].simpleString()
    raw, tests = f"`__raw_{name}`", []
    if name in INBOUND_REQUIRED:
        tests.append((f"{raw} IS NULL", f"{name}: missing"))
    if kind.startswith("decimal"):
        # a number that the column cannot hold as it was sent is refused, never rounded
        field, absent = INBOUND_FIELDS[name], f"{raw} IS NOT NULL AND `{name}` IS NULL"
        inexact = f"coalesce(abs(try_cast({raw} AS DOUBLE)) < 1e{field.precision - field.scale}, false)"
        tests.append((f"{absent} AND NOT {inexact}", f"{name}: not a number"))
        tests.append((f"{absent} AND {inexact}", f"{name}: more than {field.scale} decimals"))
    elif kind != "string":
        tests.append((f"{raw} IS NOT NULL AND `{name}` IS NULL", f"{name}: not a {_KIND[kind]}"))
    if name == "order_type":
        # false, not NULL, where the type is missing
        tests.append((f"{raw} IS NOT NULL AND {name} NOT IN ('BUY', 'SELL')", f"{name}: neither BUY nor SELL"))
    return tests


def _fine(name: str) -> str:
    """Condition under which a field is accepted; each cast appears once."""
    if name == "order_type":
        return "coalesce(order_type IN ('BUY', 'SELL'), false)"
    if name in INBOUND_REQUIRED:
        return f"`{name}` IS NOT NULL"
    if INBOUND_FIELDS[name].simpleString() == "string":
        return "true"
    return f"(`__raw_{name}` IS NULL OR `{name}` IS NOT NULL)"


def _decimals(text: str) -> str:
    """How many decimals a number written as text needs; trailing zeros count only before an exponent."""
    fraction = f"trim(TRAILING '0' FROM regexp_extract({text}, '[.]([0-9]*)', 1))"
    exponent = f"coalesce(try_cast(regexp_extract({text}, '[eE]([+-]?[0-9]+)', 1) AS INT), 0)"
    plain = f"length(trim(TRAILING '0' FROM substring_index({text}, '.', -1)))"
    return (
        f"CASE WHEN locate('e', lower({text})) > 0 THEN length({fraction}) - {exponent} "
        f"WHEN locate('.', {text}) > 0 THEN {plain} ELSE 0 END"
    )


def _time(text: str) -> str:
    """A time without zone as it stands; one with a zone or an offset in UTC. One of 19 characters with seconds has none."""
    micros = f"unix_micros(try_cast({text} AS TIMESTAMP))"
    return (
        f"CASE WHEN length({text}) = 19 AND substring({text}, 17, 1) = ':' THEN try_cast({text} AS TIMESTAMP_NTZ) "
        f"WHEN substring(trim({text}), 12) RLIKE '[A-Za-z+-]' "
        f"THEN timestampadd(MICROSECOND, {micros}, timestamp_ntz'1970-01-01 00:00:00') "
        f"ELSE try_cast({text} AS TIMESTAMP_NTZ) END"
    )


def _plainly_within(text: str, scale: int) -> str:
    """Whether a number is written without exponent and with at most ``scale`` decimals: no pattern is needed to tell."""
    return (
        f"(locate('e', {text}) = 0 AND locate('E', {text}) = 0 "
        f"AND (locate('.', {text}) = 0 OR length({text}) - locate('.', {text}) <= {scale}))"
    )


def _needs_at_most(text: str, scale: int) -> str:
    """Whether a number, however it is written, needs at most ``scale`` decimals. Few numbers come to this test. As a lambda
    it is not generated code, nor is the projection that holds it part of one long generated method, which the JVM would
    not compile: it is split into short ones."""
    return f"exists(array({text}), x -> {_decimals('x')} <= {scale})"


def _typed(name: str) -> str:
    """A field as its type, NULL where it cannot be held as it was sent. A field is cast once."""
    raw = f"`__raw_{name}`"
    if name == "order_type":
        return f"upper({raw})"
    if name == "comment":
        return f"nullif({raw}, '')"
    kind = INBOUND_FIELDS[name].simpleString()
    if kind == "string":
        return raw
    if kind == "timestamp_ntz":
        return _time(raw)
    if kind == "bigint":  # 7.0 is a whole number
        return f"coalesce(try_cast({raw} AS BIGINT), CASE WHEN {_needs_at_most(raw, 0)} THEN try_cast(try_cast({raw} AS DECIMAL(38,6)) AS BIGINT) END)"
    scale = INBOUND_FIELDS[name].scale
    return f"CASE WHEN {_plainly_within(raw, scale)} OR {_needs_at_most(raw, scale)} THEN try_cast({raw} AS {kind}) END"


def validate(inbound: DataFrame) -> DataFrame:
    """Typed record, ``is_valid`` and ``reject_reason``: an array, empty for a valid record."""
    tests = [test for name in INBOUND_FIELDS for test in _tests(name)]
    fine = " AND ".join(map(_fine, INBOUND_FIELDS))
    reasons = ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for condition, text in tests)
    others = quoted(c for c in inbound.columns if c not in INBOUND_FIELDS)
    return (
        inbound.selectExpr(*others, *[f"`{n}` AS `__raw_{n}`" for n in INBOUND_FIELDS])
        .selectExpr(*others, *[f"{_typed(n)} AS `{n}`" for n in INBOUND_FIELDS], *[f"`__raw_{n}`" for n in INBOUND_FIELDS])
        .selectExpr("*", f"{fine} AS is_valid")
        .selectExpr(
            *others,
            *quoted(INBOUND_FIELDS),
            "is_valid",
            f"CASE WHEN is_valid THEN cast(array() AS ARRAY<STRING>) "
            f"ELSE array_compact(array({reasons})) END AS reject_reason",
        )
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.where("is_valid").drop("is_valid", "reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("NOT is_valid").drop("is_valid")


def _active_keys(accounts: DataFrame) -> DataFrame:
    """One account per key: where active accounts share one, that of the least id."""
    return accounts.where("is_active").groupBy("api_key").agg(F.expr("min(id) AS account_id"))


def _joined_by_key(records: DataFrame, accounts: DataFrame, how: str, rows: int | None) -> DataFrame:
    """``accounts`` is the accounts table, or the keys of its change log over time (sources.account_log.keys_over_time):
    then a record gets the account that had its key when it arrived."""
    few = lambda keys: keys if rows is None else broadcast_if_small(keys, rows)
    if "valid_from" not in accounts.columns:
        return records.join(few(_active_keys(accounts)), "api_key", how)
    spans = few(accounts.withColumnRenamed("api_key", "__key"))
    then = F.expr("api_key = __key AND valid_from <= received_at AND received_at < valid_to")
    return records.join(spans, then, how).drop("__key", "valid_from", "valid_to")


def resolve_account(records: DataFrame, accounts: DataFrame, rows: int | None = None) -> DataFrame:
    """Give each record the active account of its key; others drop out.

    No hint: accounts is a plain scan, so Spark knows its size and broadcasts it only while it
    is below spark.sql.autoBroadcastJoinThreshold. Where an upper bound of its ``rows`` is given,
    few are broadcast.
    """
    return _joined_by_key(records, accounts, "inner", rows)


def unknown_keys(records: DataFrame, accounts: DataFrame, rows: int | None = None) -> DataFrame:
    return _joined_by_key(records, accounts, "left_anti", rows)


def accounts_of(records: DataFrame, accounts: DataFrame) -> DataFrame:
    """The accounts whose key some record has: all that a batch needs of them."""
    return accounts.join(records.select("api_key").distinct(), "api_key", "left_semi")


def stored_keys(batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    """Stored (account, ticket) keys the batch has to be compared with.

    batch_rows is an upper bound of the rows of the batch. The keys of a small batch are
    broadcast, so the history is only filtered where it lies; for a larger batch it is all
    stored keys, and the join that follows moves them once.
    """
    keys = stored.select(*TRADE_KEY)
    if batch_rows > BROADCAST_ROWS:
        return keys
    return keys.join(F.broadcast(batch.select(*TRADE_KEY).distinct()), TRADE_KEY, "left_semi")


def settle(batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    """Per (account, ticket) of the batch: its first record, how many came, and whether it is stored (known).

    The first record is the first to arrive, then the smallest. min over one struct is map-side
    combined, so a key repeated millions of times reaches the reducer as one row per map task.
    """
    rest = [c for c in batch.columns if c not in TRADE_KEY + ["received_at"]]
    per_key = batch.groupBy(*TRADE_KEY).agg(
        F.expr(f"min(struct({listed(['received_at', *rest])})) AS first"), F.expr("count(1) AS received")
    )
    return _with_known(per_key, batch, stored, batch_rows)


def _with_known(per_key: DataFrame, batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    known = stored_keys(batch, stored, batch_rows).distinct().selectExpr("*", "true AS known")
    return per_key.join(known, TRADE_KEY, "left")


def settle_keys(batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    """``settle`` without the records: only the keys of batch and store move."""
    return _with_known(batch.groupBy(*TRADE_KEY).agg(F.expr("count(1) AS received")), batch, stored, batch_rows)


def settle_large(records: DataFrame, keys: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    """The ``settled_trades`` of a batch too large to move, from its records and their ``settle_keys``, which lie stored.

    A record whose key came once and is not stored is new as it is. Where the other keys are few, only the records of those
    move; else those that may have a new key.
    """
    odd = keys.where("known OR received > 1")
    n_odd, repeated = odd.agg(F.count("*"), F.count(F.expr("CASE WHEN known IS NULL THEN 1 END"))).first()
    if n_odd > BROADCAST_ROWS:
        return settled_trades(settle(possibly_of(records, keys.where("known IS NULL")), stored, batch_rows))
    single = join_on_keys(records, F.broadcast(odd.select(*TRADE_KEY)), TRADE_KEY, "left_anti")
    if not repeated:
        return single
    several = join_on_keys(records, F.broadcast(odd.where("known IS NULL").select(*TRADE_KEY)), TRADE_KEY, "left_semi")
    return single.unionByName(settled_trades(settle(several, stored.where("false"), batch_rows)))


def possibly_of(records: DataFrame, keys: DataFrame) -> DataFrame:
    """All records that have one of the keys, and some of those that have none: told by ``SIEVE`` bits, which are broadcast."""
    bit = F.xxhash64(*[F.col(c).cast("long") for c in TRADE_KEY]).bitwiseAND(F.lit(SIEVE - 1))
    pages = keys.select(F.shiftright(bit, 15).alias("__page"), bit.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("__page").agg(
        F.bitmap_construct_agg("bit").alias("__bits"))
    at = records.withColumn("__at", bit).withColumn("__page", F.shiftright("__at", 15)).withColumn("__at", F.expr("cast(__at & 32767 AS INT)"))
    byte = "cast(conv(hex(substring(__bits, __at div 8 + 1, 1)), 16, 10) AS INT)"
    return at.join(F.broadcast(pages), "__page").where(f"shiftright({byte}, __at % 8) & 1 = 1").select(*records.columns)


def settled_trades(settled: DataFrame) -> DataFrame:
    """Trades to append: the first record of each key that is not stored yet."""
    return settled.where("known IS NULL").selectExpr(*TRADE_KEY, "first.*")


def settled_status(settled: DataFrame) -> DataFrame:
    """Per (account, ticket): how many records were stored (0 or 1) and how many were duplicates."""
    return settled.selectExpr(
        *TRADE_KEY, "received", "CASE WHEN known THEN 0L ELSE 1L END AS ok"
    ).selectExpr("*", "received - ok AS duplicate")


def new_trades(batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    return settled_trades(settle(batch, stored, batch_rows)).select(*batch.columns)


def ingest_status(batch: DataFrame, stored: DataFrame, batch_rows: int) -> DataFrame:
    return settled_status(settle(batch, stored, batch_rows))


TOTALS = {"total": "received", "saved": "CASE WHEN known THEN 0L ELSE 1L END", "duplicates": "received - CASE WHEN known THEN 0L ELSE 1L END"}


def ingest_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.expr("coalesce(sum(received), 0L) AS total"),
        F.expr("coalesce(sum(ok), 0L) AS saved"),
        F.expr("coalesce(sum(duplicate), 0L) AS duplicates"),
    )


def counted(settled: DataFrame) -> tuple[DataFrame, Observation]:
    """``settled``, with the totals of the batch taken along by whatever job reads it."""
    totals = Observation()
    return settled.observe(totals, *[F.expr(f"coalesce(sum({e}), 0L) AS {name}") for name, e in TOTALS.items()]), totals


def touched_strategies(new: DataFrame) -> DataFrame:
    return new.where(RECOMPUTE_GATE).select("magic_number").distinct()


def restrict_to(
    history: DataFrame, touched: DataFrame, touched_rows: int, keys: list[str] | None = None
) -> DataFrame:
    """Full history of the touched keys (strategies by default) only; touched_rows bounds their number."""
    few = broadcast_if_small(touched, touched_rows)
    return join_on_keys(history, few, keys or ["magic_number"], "left_semi")
