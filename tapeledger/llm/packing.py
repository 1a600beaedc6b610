"""Packing into optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket limits with the least padding;
batches of at most a token budget form inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import staged, table, word_count

MAX_TOKENS = 8192
BUCKETS = 16
BATCH_TOKENS = 65536
SHARD_BATCHES = 16


def pieces(docs: DataFrame, length, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, n_tokens: documents longer than ``max_tokens`` become consecutive pieces of that length."""
    sizes = docs.select("doc_id", length.cast("long").alias("total"))
    last = F.greatest(F.expr(f"(total - 1) div {max_tokens}"), F.lit(0))
    cut = sizes.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    left = F.col("total") - F.col("piece") * max_tokens
    return cut.select("doc_id", "piece", F.least(left, F.lit(max_tokens)).alias("n_tokens"))


def best_limits(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper limits of at most ``buckets`` buckets that minimise the padding of (length, count) pairs.

    best[j] is the least padded volume of the lengths up to the j-th; one more bucket ending at j costs its
    length times its rows. For one bucket more, the candidates of where the last one starts are lines in that
    length, and the lower envelope of the lines gives each minimum in amortised constant time.
    """
    lengths = [n for n, _ in sorted(histogram)]
    if not lengths:
        return []
    upto = [0]
    for _, count in sorted(histogram):
        upto.append(upto[-1] + count)
    rounds = min(buckets, len(lengths))
    best = [n * upto[j + 1] for j, n in enumerate(lengths)]
    cuts = []
    for _ in range(1, rounds):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, start
        front, new, where = 0, [], []
        for j, n in enumerate(lengths):
            if j:
                slope, height = -upto[j], best[j - 1]
                while len(hull) - front >= 2:
                    (s1, h1, _), (s2, h2, _) = hull[-2], hull[-1]
                    if (height - h1) * (s1 - s2) <= (h2 - h1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, height, j))
            while len(hull) - front >= 2 and hull[front + 1][0] * n + hull[front + 1][1] <= hull[front][0] * n + hull[front][1]:
                front += 1
            value, start = n * upto[j + 1], 0
            if hull and (split := n * upto[j + 1] + hull[front][0] * n + hull[front][1]) < value:
                value, start = split, hull[front][2]
            new.append(value)
            where.append(start)
        cuts.append((best, where))
        best = new
    limits, j = [], len(lengths) - 1
    for _, where in reversed(cuts):
        limits.append(lengths[j])
        if not where[j]:
            return limits[::-1]
        j = where[j] - 1
    limits.append(lengths[j])
    return limits[::-1]


def pack(docs: DataFrame, length=None, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, piece, n_tokens, bucket, bucket_tokens, batch_id, padding: one row per piece of every document.

    Every batch holds pieces of one bucket, each padded to bucket_tokens, at most ``batch_tokens`` in all (one
    piece where a single one is larger). A null or empty text is one piece of 0 tokens. Rows that repeat a doc_id
    are packed each. An empty table gives no row; columns other than doc_id and text are not read. The histogram
    that reaches the driver has at most ``max_tokens`` + 1 rows, whatever the input.
    """
    parts = staged(pieces(docs, word_count() if length is None else length, max_tokens), "pieces")
    histogram = [tuple(r) for r in parts.groupBy("n_tokens").count().collect()]
    limits = best_limits(histogram, buckets) or [0]
    index = F.lit(len(limits) - 1)
    for i in reversed(range(len(limits) - 1)):
        index = F.when(F.col("n_tokens") <= limits[i], i).otherwise(index)
    tokens = F.element_at(F.array(*[F.lit(int(n)) for n in limits]), F.col("bucket") + 1).cast("long")
    parts = parts.withColumn("bucket", index).withColumn("bucket_tokens", tokens)
    rows = F.greatest(F.expr(f"{batch_tokens} div greatest(bucket_tokens, 1)"), F.lit(1))
    # a bucket is dealt into shards of some whole batches each, so that no task holds a bucket
    per_bucket: dict[int, int] = {}
    for n, count in histogram:
        at = next(i for i, limit in enumerate(limits) if n <= limit)
        per_bucket[at] = per_bucket.get(at, 0) + count
    shards = [
        max(1, per_bucket.get(i, 0) // (SHARD_BATCHES * max(1, batch_tokens // max(1, n)))) for i, n in enumerate(limits)
    ]
    n_shards = F.element_at(F.array(*[F.lit(n) for n in shards]), F.col("bucket") + 1)
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), n_shards))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")
    number = F.floor((F.row_number().over(order) - 1) / rows)
    return parts.withColumn("number", number).select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_tokens",
        F.format_string("%d-%d-%d", "bucket", "shard", "number").alias("batch_id"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
