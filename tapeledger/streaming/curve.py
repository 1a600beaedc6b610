"""Equity curves kept up to date batch by batch.

Points are stored by month, measured from the start of their month; what came before a month is in the tree of summaries.
So a batch that follows what is stored appends its points, a late trade rewrites the points of one month of one key, and
no other point changes. Reading adds to each point the trades and the equity before its month.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeledger.functions.numeric import listed, quoted
from tapeledger.operators import history as H
from tapeledger.operators import path as P
from tapeledger.operators.enrich import iso_time
from tapeledger.operators.joins import join_on_keys
from tapeledger.operators.ordered import DEFAULT_POLICY, ChunkPolicy, path_rows
from tapeledger.sources.commits import CommitLog, KeyedTable, Part

BATCH = "batch"


class CurveTable:
    """Points, the batch that last rewrote each month, and the month tree, under one root.

    Batches come in rising order, and one that is put already changes nothing. The tree is put last: a batch that died
    before that is run again from the same tree, and its points and rewrites, which carry its number, are there once.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], policy: ChunkPolicy = DEFAULT_POLICY):
        self.spark, self.keys, self.policy = spark, list(keys), policy
        self.points = CommitLog(spark, f"{root}/points")
        self.rewrites = KeyedTable(spark, f"{root}/rewrites", [*keys, H.NODE])
        self.tree = KeyedTable(spark, f"{root}/tree", H.node_key(self.keys))

    def _measured(self, trades: DataFrame, stored: DataFrame | None) -> DataFrame:
        """Points of trades that lie behind those of ``stored`` leaves in each month."""
        at = [*self.keys, H.NODE]
        rows = path_rows(trades.selectExpr("*", f"{H.MONTH} AS {H.NODE}"), at, policy=self.policy)
        rows = rows.select(*at, "seq", "close_time", "equity")
        if stored is None:
            return rows
        before = stored.where(F.col(H.LEVEL) == 0).selectExpr(*quoted(at), "n AS __n", "path.total AS __total")
        return join_on_keys(rows, before, at, "left").selectExpr(
            *quoted(at), "seq + coalesce(__n, 0L) AS seq", "close_time", "cast(equity + coalesce(__total, 0) AS DECIMAL(38,4)) AS equity")

    def put(self, batch: DataFrame, trades_of: Callable[[list[int]], DataFrame], number: int) -> None:
        """Add a batch of prepared trades; ``trades_of`` gives the trades of some months, the batch among them."""
        if self.tree.covers(number):
            return
        tree, at = self.tree.read(), [*self.keys, H.NODE]
        if tree is None:
            fresh, nodes = self._measured(batch, None), H.build(batch, self.keys, self.policy)
        else:
            late = H.late_months(tree, batch, self.keys)
            months = H.numbers_of(late)
            known = batch.selectExpr("*", f"{H.MONTH} AS {H.NODE}")
            fresh = self._measured(join_on_keys(known, late, at, "left_anti").drop(H.NODE), tree)
            if months:
                again = join_on_keys(trades_of(months).selectExpr("*", f"{H.MONTH} AS {H.NODE}"), late, at, "left_semi")
                fresh = fresh.unionByName(self._measured(again.drop(H.NODE), None))
                self.rewrites.put(late.withColumn(BATCH, F.lit(number)), number)
            nodes = H.advance(tree, batch, trades_of, self.keys, self.policy)
        part = Part(self.points.fresh_folder(), number, number)
        fresh.withColumn(BATCH, F.lit(number)).write.parquet(part.folder)
        self.points.update(lambda head: [*[p for p in head.parts if not p.first == p.last == number], part])
        self.tree.put(nodes, number)

    def _valid(self, parts: tuple[Part, ...]) -> DataFrame:
        """Points that no later batch rewrote."""
        points = reduce(DataFrame.unionByName, [self.spark.read.parquet(p.folder) for p in parts])
        rewritten = self.rewrites.read()
        if rewritten is None:
            return points
        since = rewritten.withColumnRenamed(BATCH, "__since")
        return join_on_keys(points, since, [*self.keys, H.NODE], "left").where(f"{BATCH} >= coalesce(__since, 0)").drop("__since")

    def read(self, initial: float | str = P.INITIAL_BALANCE) -> DataFrame:
        """The curve of operators.path.equity_curve."""
        before = f"OVER (PARTITION BY {listed(self.keys)} ORDER BY {H.NODE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        # one row for each key and month
        starts = self.tree.read().where(F.col(H.LEVEL) == 0).selectExpr(
            *quoted(self.keys), H.NODE, f"coalesce(sum(n) {before}, 0L) AS __n", f"coalesce(sum(path.total) {before}, 0) AS __total")
        rows = join_on_keys(self._valid(self.points.head().parts), starts, [*self.keys, H.NODE])
        return rows.selectExpr(
            *quoted(self.keys), "seq + __n AS seq", f"{iso_time('close_time')} AS time",
            f"cast(bround({P.balance(initial)} + cast(equity + __total AS DECIMAL(38,4)), 2) AS DOUBLE) AS equity")

    def compact(self) -> None:
        """Write the valid points into one folder; rewritten ones are gone then."""
        old = self.points.head().parts
        if len(old) < 2:
            return
        part = Part(self.points.fresh_folder(), old[0].first, old[-1].last)
        self._valid(old).write.parquet(part.folder)
        head = self.points.update(lambda head: [part, *[p for p in head.parts if p not in old]] if set(old) <= set(head.parts) else None)
        if part not in head.parts:
            self.points.remove([part])
