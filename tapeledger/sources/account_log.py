"""The stored accounts: a log of what happened to them, read as they were at any time.

An event adds an account or deactivates one, at a moment. Nothing is overwritten, so a batch that is run again finds the
accounts as they were when its records arrived, whatever happened since.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeledger.functions.numeric import quoted
from tapeledger.operators import accounts as A
from tapeledger.schema import ACCOUNTS
from tapeledger.sources.commits import CommitLog, Part

ADDED, DEACTIVATED = "added", "deactivated"
FIELDS = [f.name for f in ACCOUNTS.fields if f.name not in ("id", "is_active")]
EVENTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("event", T.StringType()), T.StructField("at", T.TimestampNTZType()),
    *[ACCOUNTS[name] for name in FIELDS]])
# later than any arrival
OPEN_END = "timestamp_ntz'9999-12-31 00:00:00'"


class AccountLog:
    """The events of all accounts under one root; two writers at the same time both get in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def _add(self, rows: DataFrame) -> None:
        part = Part(self.log.fresh_folder())
        rows.select(*EVENTS.names).write.parquet(part.folder)
        self.log.update(lambda head: [*head.parts, part])

    def events(self) -> DataFrame:
        folders = [p.folder for p in self.log.head().parts]
        return self.spark.read.schema(EVENTS).parquet(*folders) if folders else self.spark.createDataFrame([], EVENTS)

    def append(self, records: DataFrame, at: str = "created_at") -> DataFrame:
        """Add the valid records, from the moment ``at`` (SQL) on; returns those left out, with the reasons."""
        fresh = A.append_accounts(self.spark.createDataFrame([], ACCOUNTS), records.select(*ACCOUNTS.names))
        self._add(fresh.selectExpr("*", f"'{ADDED}' AS event", f"cast({at} AS TIMESTAMP_NTZ) AS at"))
        return A.account_rejects(records)

    def deactivate(self, ids: DataFrame, at: str) -> DataFrame:
        """Soft delete of the given ids from the moment ``at`` (SQL over ids) on; returns the ids that no account has."""
        nothing = [F.lit(None).cast(ACCOUNTS[name].dataType).alias(name) for name in FIELDS]
        moments = ids.selectExpr("id", f"cast({at} AS TIMESTAMP_NTZ) AS at").groupBy("id").agg(F.min("at").alias("at"))
        known = self.events().where(F.col("event") == ADDED).select("id").distinct()
        self._add(moments.join(known, "id", "left_semi").select("id", F.lit(DEACTIVATED).alias("event"), "at", *nothing))
        return A.missing_accounts(known, ids)

    def compact(self) -> None:
        """Write all events into one folder. A writer in between is kept: its folder stays beside the new one."""
        old = self.log.head().parts
        if len(old) < 2:
            return
        part = Part(self.log.fresh_folder())
        reduce(DataFrame.unionByName, [self.spark.read.schema(EVENTS).parquet(p.folder) for p in old]).write.parquet(part.folder)
        head = self.log.update(lambda head: [part, *[p for p in head.parts if p not in old]] if set(old) <= set(head.parts) else None)
        if part not in head.parts:
            self.log.remove([part])


def states(events: DataFrame) -> DataFrame:
    """Every account as it was from valid_from until before valid_to. Of events at one moment, adding counts first."""
    order = "PARTITION BY id ORDER BY at, event"  # 'added' sorts before 'deactivated'
    return events.selectExpr(
        "id", *[f"last({c}, true) OVER ({order} ROWS UNBOUNDED PRECEDING) AS {c}" for c in quoted(FIELDS)],
        f"event = '{ADDED}' AS is_active", "at AS valid_from", f"coalesce(lead(at) OVER ({order}), {OPEN_END}) AS valid_to",
    ).where("valid_from < valid_to")


def accounts_at(events: DataFrame, moment: datetime | str) -> DataFrame:
    """The accounts table as it was at a moment."""
    when = F.lit(str(moment)).cast("timestamp_ntz")
    held = states(events).where((F.col("valid_from") <= when) & (when < F.col("valid_to")))
    return held.select(*ACCOUNTS.names)


def keys_over_time(events: DataFrame) -> DataFrame:
    """api_key, account_id, valid_from, valid_to: at no moment two rows for a key. Of active accounts that share one at the
    same time, the least id has it."""
    active = states(events).where("is_active").select("api_key", F.col("id").alias("account_id"), "valid_from", "valid_to")
    ends = active.selectExpr("api_key", "explode(array(valid_from, valid_to)) AS at").distinct()
    spans = ends.selectExpr("api_key", "at", "lead(at) OVER (PARTITION BY api_key ORDER BY at) AS until").where("until IS NOT NULL")
    covered = spans.join(active, "api_key").where("valid_from <= at AND at < valid_to")
    return covered.groupBy("api_key", F.col("at").alias("valid_from"), F.col("until").alias("valid_to")).agg(F.min("account_id").alias("account_id"))
