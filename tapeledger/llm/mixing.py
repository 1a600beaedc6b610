"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash. Tokens are summed by source and leading hash bits; a source's budget
then falls into one bucket, and only the rows of that bucket are summed again by the next bits, until the
bucket is a single hash value. A document is in the mix if its hash is below its source's threshold, so the
mix is filtered, not sorted, and a larger budget only ever adds documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import is_empty, same, staged, table, text_or_empty, word_count

HASH_BITS = 60
STEP_BITS = 12
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with __h, a fixed 60-bit hash of doc_id, text, source and, among rows that repeat these, a number.

    Which of some equal rows gets which number cannot be told, but the numbers, and so the hashes, are always the same.
    Only rows that repeat meet: they are numbered within their partition, then shifted by the partitions before.
    """
    keyed = docs.withColumn("__key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty()), F.coalesce("source", F.lit("")))))
    again = staged(keyed.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"), "repeats")
    number = lambda digest: F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    if is_empty(again):
        return keyed.withColumn("__h", number(F.col("__key"))).drop("__key")
    marked = staged(keyed.join(again.withColumn("__again", F.lit(True)), "__key", "left"), "marked")
    several = marked.where("__again").withColumn("__part", F.spark_partition_id())
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each key and partition
    counts = several.groupBy("__key", "__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = staged(counts.select("__key", "__part", "__before"), "repeat-counts")
    within = Window.partitionBy("__key", "__part").orderBy(F.lit(0))
    several = several.withColumn("__at", F.row_number().over(within)).join(counts, ["__key", "__part"])
    several = several.withColumn("__h", number(F.md5(F.concat_ws(":", "__key", (F.col("__at") + F.col("__before")).cast("string")))))
    once = marked.where("__again is null").withColumn("__h", number(F.col("__key")))
    return once.select(*docs.columns, "__h").unionByName(several.select(*docs.columns, "__h"))


def sized(docs: DataFrame, size=None) -> DataFrame:
    """doc_id, source, size and the 60-bit hash of each row."""
    return hashed(docs).select("doc_id", "source", (word_count() if size is None else size).alias("size"), F.col("__h").alias("h"))


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Position (from 0) of each distinct name by code point, null last, without sorting all names in one task."""
    spread = names.select(column, F.col(column).isNull().alias("__null"))
    spread = spread.repartitionByRange("__null", column).withColumn("__part", F.spark_partition_id())
    spread = staged(spread, "ranges")
    within = Window.partitionBy("__part").orderBy("__null", column)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so the unpartitioned window is bounded by the number of partitions
    offsets = spread.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    placed = spread.withColumn("__at", F.row_number().over(within) - 1).join(offsets, "__part")
    return placed.select(column, (F.col("__at") + F.col("__before")).alias("position"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target: the total shared by weight, no target above ``most`` times its source's size.

    Each round shares what the sources at their limit leave among the others; it ends when none is newly above.
    """
    position = ranked(sizes, "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = same(sizes, position, ["source"]).withColumn("weight", weight).drop("position")
    weighed = staged(weighed.withColumn("cap", F.col("source_size") * most), "weighed")
    full, share = -1, None
    while True:
        above = F.lit(False) if share is None else F.col("cap") <= share * F.col("weight")
        line = weighed.select("cap", "weight", "source_size", above.alias("above")).agg(
            F.sum("source_size").alias("total"), F.count_if("above").alias("full"),
            F.sum(F.when(F.col("above"), F.col("cap")).otherwise(0)).alias("capped"),
            F.sum(F.when(F.col("above"), 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if line.full == full or not line.free:
            if line.total is not None and not line.free:
                share = None
            break
        full, share = line.full, (line.total - line.capped) / line.free
    target = F.col("cap").cast("double")
    if share is not None:
        target = F.least(target, F.lit(float(share)) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: hashes below it sum to the budget as nearly as whole documents allow."""
    left = staged(budgets.where("budget > 0").select("source", F.lit(0).cast("long").alias("floor"), "budget"), "budgets")
    inside, shift = rows.select("source", "size", "h"), HASH_BITS
    while shift and not is_empty(left):
        shift -= STEP_BITS
        bucket = F.shiftright("h", shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        # one row per bucket: at most 2 ** STEP_BITS in a source
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        first = same(sums.withColumn("upto", F.sum("tokens").over(upto)), left.select("source", "budget"), ["source"]).where("upto > budget")
        edge = first.groupBy("source").agg(F.min(F.struct("bucket", "upto", "tokens", "budget")).alias("e"))
        left = edge.select(
            "source", F.col("e.bucket").alias("bucket"), (F.col("e.bucket") * (1 << shift)).alias("floor"),
            (F.col("e.budget") - (F.col("e.upto") - F.col("e.tokens"))).alias("budget"), F.col("e.tokens").alias("tokens"),
        )
        left = staged(left, f"edge-{shift}")
        inside = same(inside.withColumn("bucket", bucket), left.select("source", "bucket"), ["source", "bucket"])
        inside = staged(inside.drop("bucket"), f"inside-{shift}")
    # the last bucket is one hash value: it goes in if that lands nearer to the budget
    if "tokens" not in left.columns:
        return left.select("source", F.col("floor").alias("threshold"))
    take = (F.col("tokens") - F.col("budget") < F.col("budget")).cast("long")
    return left.select("source", (F.col("floor") + take).alias("threshold"))


def plan_of(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target, repeats, threshold of each source."""
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    aim = staged(targets(sizes, weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aim = aim.withColumn("repeats", F.least(whole, F.lit(most)).cast("long"))
    aim = aim.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    cut = thresholds(rows, aim)
    out = same(aim, cut, ["source"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
    return staged(out.drop("budget"), "mix-plan")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEAT, size=None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: ``taken`` words are in the mix, repeats counted.

    A null text has size 0, a null source is a source of its own and comes last. Rows that repeat a doc_id, have none, or
    repeat another row whole are in the mix each for itself. Texts of any length are counted whole. An empty table gives no row; sources of size 0
    have target 0. Columns other than doc_id, source and text are not read.
    """
    rows = staged(sized(docs, size), "sized")
    out = same(rows, plan_of(rows, weights, most), ["source"])
    taken = F.col("size") * (F.col("repeats") + (F.col("h") < F.col("threshold")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs`` that the mix holds, each as often as the mix repeats it (at most ``most`` times); columns as they are."""
    docs_h = hashed(docs)
    rows = staged(docs_h.select("source", word_count().alias("size"), F.col("__h").alias("h")), "sized")
    aim = plan_of(rows, weights, most).select("source", "repeats", "threshold")
    out = same(docs_h, aim.withColumnsRenamed({"repeats": "__repeats", "threshold": "__threshold"}), ["source"])
    times = (F.col("__repeats") + (F.col("__h") < F.col("__threshold")).cast("long")).cast("int")
    out = out.withColumn("__times", times).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(CASE WHEN copies = 1 THEN key ELSE md5(key || ':' || number) END, 1, 15))::BIGINT AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key) AS number
        FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, '')) AS key FROM documents))),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
o AS (SELECT *, cap / w AS ratio FROM s),
p AS (SELECT ratio, sum(cap) OVER a AS capped, sum(w) OVER () - sum(w) OVER a AS free,
             sum(source_size) OVER () AS total, lead(ratio) OVER (ORDER BY ratio) AS following
      FROM o WINDOW a AS (ORDER BY ratio ROWS UNBOUNDED PRECEDING)),
cuts AS (SELECT ratio AS lo, following AS hi, (total - capped)::DOUBLE / free::DOUBLE AS share FROM p WHERE free > 0
         UNION ALL SELECT -1, (SELECT min(ratio) FROM o), (SELECT sum(source_size)::DOUBLE / sum(w)::DOUBLE FROM s)),
pick AS (SELECT min(share) AS share FROM cuts WHERE lo <= share AND (hi IS NULL OR share < hi)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT share FROM pick) * w, cap::DOUBLE)) AS target FROM s),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS reps FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.reps, b.target - b.reps * b.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (reps + CASE WHEN budget > 0 AND (upto <= budget
                OR (upto - own <= budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
