"""Exact top-k search by vector approximations.

Vectors lie in blocks. Each block holds, beside the exact vectors, the cell of every component on a grid of the
block. A query block scans the cells for bounds of every score, and reads exact vectors from the best bound
downwards until no unread vector can reach the k-th score. Blocks give their k best; the k best of those are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import staged, table

K = 5
SCALE = 256
CELL_BITS = 6
QUERY_BLOCK = 256
VECTOR_BLOCK = 4096
READ = 32


def integral(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), copies of each distinct usable row."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & F.col("vec_id").isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return vectors.where(usable).select("vec_id", v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def grid(matrix: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and the origin and step of each dimension."""
    low = matrix.min(axis=0)
    step = np.maximum(-(-(matrix.max(axis=0) - low + 1) // (1 << bits)), 1)
    return ((matrix - low) // step).astype(np.uint8 if bits <= 8 else np.int64), low, step


def best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int = K, bits: int = CELL_BITS):
    """For each query row, positions and scores of the k best vectors of a block (ties to the smaller id), not its own."""
    cells, low, step = grid(matrix, bits)
    # components are whole, so a cell ends one below the next one's start
    floor = (low + cells * step).astype(np.float64)
    ceiling = floor + (step - 1)
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most = up @ ceiling.T + down @ floor.T
    least = up @ floor.T + down @ ceiling.T
    slack = 1e-9 * np.abs(q).sum(axis=1, keepdims=True) * max(1.0, np.abs(ceiling).max(), np.abs(floor).max())
    most, least = most + slack, least - slack
    mine = own[:, None] == ids[None, :]
    most[mine], least[mine] = -np.inf, -np.inf
    for row in range(len(queries)):
        limit = np.partition(least[row], -k)[-k] if len(ids) > k else -np.inf
        open_ = np.flatnonzero((most[row] >= limit) & ~mine[row])
        order = open_[np.argsort(-most[row, open_], kind="stable")]
        at = np.empty(0, np.int64)
        score = np.empty(0, np.int64)
        for start in range(0, len(order), READ):
            if len(score) >= k and most[row, order[start]] < score[k - 1]:
                break
            read = order[start:start + READ]
            at = np.concatenate([at, read])
            score = np.concatenate([score, matrix[read] @ queries[row]])
            first = np.lexsort((ids[at], -score))[:k]
            at, score = at[first], score[first]
        yield at, score


RESULT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])


def _searched(k: int, bits: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                matrix = np.array([c["v"] for c in r["vectors"]], np.int64)
                ids = np.array([c["vec_id"] for c in r["vectors"]], np.int64)
                copies = [c["copies"] for c in r["vectors"]]
                queries = np.array([c["v"] for c in r["queries"]], np.int64)
                own = np.array([c["vec_id"] for c in r["queries"]], np.int64)
                rows = [
                    (q["query"], q["vec_id"], int(ids[a]), int(s), copies[a])
                    for q, (at, score) in zip(r["queries"], best(queries, own, ids, matrix, k, bits)) for a, s in zip(at, score)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)
    return run


def nearest(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, bits: int = CELL_BITS,
            query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row, ties to smaller vec_id.

    Queries are the rows for which ``is_query`` holds, candidates all rows with another vec_id. Vectors that are null or
    empty, hold a null or non-finite component, or have no vec_id take no part; vectors are compared with those of their
    own length. A row that repeats another is a candidate of its own, but one query. Scores must fit a long. An empty
    table gives no row; columns other than vec_id and embedding are not read.
    """
    rows = staged(integral(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    wanted = rows.where(is_query).select("vec_id", "v", "dim", F.xxhash64("vec_id", "v").alias("query"))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("m"))
    counts = counts.select("dim", F.ceil(F.col("n") / vector_block).alias("vb"), F.greatest(F.ceil(F.col("m") / query_block), F.lit(1)).alias("qb"))
    place = F.xxhash64("vec_id", "v")
    blocks = rows.join(counts, "dim").withColumn("vector_at", F.pmod(place, F.col("vb"))).groupBy("dim", "vector_at", "qb").agg(
        F.collect_list(F.struct("vec_id", "v", "copies")).alias("vectors"))
    asked = wanted.join(counts, "dim").withColumn("query_at", F.pmod(place, F.col("qb"))).groupBy("dim", "query_at", "vb").agg(
        F.collect_list(F.struct("query", "vec_id", "v")).alias("queries"))
    # each block of queries meets each block of vectors once, under a key of the two
    left = asked.select("dim", "query_at", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("vector_at"))
    right = blocks.select("dim", "vector_at", "vectors", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("query_at"))
    met = left.join(right, ["dim", "query_at", "vector_at"]).select("queries", "vectors")
    found = met.mapInArrow(_searched(k, bits), "query long, query_id long, vec_id long, score long, copies long")
    found = found.select("query", "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))).alias("copy"))
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""
