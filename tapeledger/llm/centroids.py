"""Centroid clustering by heap-ordered bounds.

Vectors lie packed in blocks. A block keeps one heap per cluster: the gap between the distance to the second nearest
and to the nearest centroid of each member, taken when the member was last scanned, plus the drift that the cluster had
accumulated by then. As long as that key exceeds the drift by now, the member cannot have changed sides. Each round
pops what has expired, scans only those vectors exactly, and pushes them again; blocks whose heaps have not expired are
not read. What moved between clusters is summed, and the driver holds nothing but the k centroids.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import clustered, discard, staged, table

K = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
SEED = 3
BLOCK = 4096
# bounds are square roots in doubles: give way by more than their error
SLACK = 1e-9


def usable(dim: int):
    x = F.col("embedding")
    return x.isNotNull() & (F.size(x) == dim) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale).astype(np.int64)


PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("comps", pa.binary())])


def _packed(dim: int, scale: int, block: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                values = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                comps = whole_numbers(values, scale)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id").cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([comps.astype("<i8").tobytes()], pa.binary())], schema=PACKED)
    return run


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to each centroid."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * vectors.shape[1] * float(most) ** 2 < 2.0**52:  # every sum is a whole number that a double holds
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties to the smaller number), and how much closer it is for certain than the next."""
    cluster = distances.argmin(1)
    if distances.shape[1] == 1:
        return cluster, np.full(len(distances), np.inf)
    low = np.sqrt(np.partition(distances, 1, axis=1)[:, :2].astype(np.float64))
    return cluster, low[:, 1] - low[:, 0] - SLACK * (low[:, 1] + low[:, 0])


STATE = pa.schema([("block", pa.int64()), ("sizes", pa.list_(pa.int32())), ("tops", pa.list_(pa.float64())), ("keys", pa.binary()),
                   ("members", pa.binary()), ("moved", pa.list_(pa.int64()))])
STATE_SQL = "block long, sizes array<int>, tops array<double>, keys binary, members binary, moved array<long>"


def _heaps(row: dict, k: int) -> list[list[tuple[float, int]]]:
    """The heaps of a block, as they were written; a block without state has none of its members in one."""
    if row["sizes"] is None:
        return [[] for _ in range(k)]
    keys, members = np.frombuffer(row["keys"], "<f8"), np.frombuffer(row["members"], "<i4")
    ends = np.cumsum([0, *row["sizes"]])
    return [list(zip(keys[a:b].tolist(), members[a:b].tolist())) for a, b in zip(ends, ends[1:])]


def rescan(vectors: np.ndarray, heaps: list, centroids: np.ndarray, drift: list[float], first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pop expired members, scan them, push them again. Returns the popped, the cluster each had (-1: none) and has now."""
    popped, had = [], []
    if first:
        popped, had = list(range(len(vectors))), [-1] * len(vectors)
    for c, heap in enumerate(heaps):
        while heap and heap[0][0] <= drift[c]:
            popped.append(heapq.heappop(heap)[1])
            had.append(c)
    popped, had = np.array(popped, np.int64), np.array(had, np.int64)
    now, gap = nearest(squared(vectors[popped], centroids)) if len(popped) else (had, np.empty(0))
    for member, c, g in zip(popped.tolist(), now.tolist(), gap.tolist()):
        heapq.heappush(heaps[c], (g + drift[c], member))
    return popped, had, now


def _round(centroids: np.ndarray, drift: list[float], dim: int):
    """New heaps of the blocks at hand; a last row without a block holds what moved: per cluster sums, then the count."""
    k = len(centroids)

    def run(batches):
        moved = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block", "sizes", "keys", "members")}
                vectors = np.frombuffer(batch.column("comps")[i].as_buffer(), "<i8").reshape(-1, dim)
                heaps = _heaps(row, k)
                popped, had, now = rescan(vectors, heaps, centroids, drift, row["sizes"] is None)
                for side, sign in ((now, 1), (had, -1)):
                    change = (had != now) & (side >= 0)
                    np.add.at(moved[:, dim], side[change], sign)
                    np.add.at(moved[:, :dim], side[change], sign * vectors[popped[change]])
                flat = [x for heap in heaps for x in heap]
                keys, members = np.array([x[0] for x in flat], "<f8"), np.array([x[1] for x in flat], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (row["block"], [len(h) for h in heaps], [h[0][0] if h else math.inf for h in heaps], keys.tobytes(), members.tobytes(), None), STATE)], schema=STATE)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, None, moved.ravel().tolist()), STATE)], schema=STATE)
    return run


RESULT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _assigned(centroids: np.ndarray, drift: list[float], dim: int):
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("sizes", "keys", "members")}
                vectors = np.frombuffer(batch.column("comps")[i].as_buffer(), "<i8").reshape(-1, dim)
                heaps = _heaps(row, k)
                rescan(vectors, heaps, centroids, drift, row["sizes"] is None)
                cluster, distance = np.empty(len(vectors), np.int32), np.empty(len(vectors), np.int64)
                for c, heap in enumerate(heaps):
                    own = np.array([m for _, m in heap], np.int64)
                    cluster[own] = c
                    distance[own] = squared(vectors[own], centroids[c:c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array(distance)], schema=RESULT)
    return run


def digest(centroid) -> str:
    return hashlib.sha256(",".join(map(str, map(int, centroid))).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row.

    Usable are embeddings of ``dim`` components, none null or non-finite, as floor(scale * x). Rows that repeat, share a
    vec_id or have none are vectors of their own; one without a vec_id is never a first centroid, and of rows that share
    one the lesser vector comes first. Fewer than k rows with an id give as many centroids; without any there is no row,
    as for an empty table. Squared distances must fit a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(dim)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    named = rows.where("vec_id is not null").withColumn("at", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    start = named.orderBy("at", "embedding").limit(k).collect()  # k rows
    if not start:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256")).where("false")
    centroids = np.array([whole_numbers(np.array(r.embedding), scale) for r in start])
    k = len(centroids)
    packed = rows.mapInArrow(_packed(dim, scale, block), "ids array<long>, comps binary").withColumn("block", F.monotonically_increasing_id())
    blocks = clustered(packed, ["block"], "vector-blocks")  # the heaps come to the vectors, which stay where they are
    total, drift, state = np.zeros((k, dim + 1), object), [0.0] * k, None
    for _ in range(rounds):
        if state is None:
            state = blocks.select("block", F.lit(None).cast("array<int>").alias("sizes"), *[F.lit(None).cast("binary").alias(c) for c in ("keys", "members")], "comps")
            new, rest = staged(state.mapInArrow(_round(centroids, drift, dim), STATE_SQL), "heaps"), None
        else:
            expired = " or ".join(f"tops[{c}] <= {d!r}D" for c, d in enumerate(drift))
            at_hand = state.where(expired).select("block", "sizes", "keys", "members").join(blocks.select("block", "comps"), "block")
            rest = state.where(f"not ({expired})")
            new = staged(at_hand.mapInArrow(_round(centroids, drift, dim), STATE_SQL).unionByName(rest), "heaps")
        # one row per task and k * (dim + 1) sums, whatever the number of vectors
        sums = new.where("block is null").select(F.posexplode("moved").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        for at, n in sums.collect():
            total[at // (dim + 1), at % (dim + 1)] += int(n)
        if rest is not None:
            discard(old)  # noqa: F821 - of the round before
        old, state = new, new.where("block is not null")
        fresh = np.array([[s // t[dim] for s in t[:dim]] if t[dim] else list(map(int, c)) for t, c in zip(total.tolist(), centroids)], np.int64)
        went = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(new_, old_))) for new_, old_ in zip(fresh, centroids)]
        drift = [(d + went[c] + max((w for j, w in enumerate(went) if j != c), default=0.0)) * (1 + SLACK) for c, d in enumerate(drift)]
        centroids = fresh
    if state is None:
        state = blocks.select("block", F.lit(None).cast("array<int>").alias("sizes"), *[F.lit(None).cast("binary").alias(c) for c in ("keys", "members")])
    held = state.select("block", "sizes", "keys", "members").join(blocks, "block").select("ids", "comps", "sizes", "keys", "members")
    out = staged(held.mapInArrow(_assigned(centroids, drift, dim), "vec_id long, cluster int, distance long"), "assigned")
    per = dict(out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    names = [(c, int(per[c]), int(sum(per.values())), digest(centroids[c])) for c in per]
    per = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same rounds as one chain of SQL: assign, sum, floor."""
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL
  QUALIFY cluster < {K})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, cluster, d FROM (SELECT v.*, c.cluster,
    list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT cluster, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (
    SELECT cluster, unnest(v) AS x, unnest(range({DIM})) AS pos FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY pos) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON o.cluster = m.cluster)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.cluster = c.cluster"""


ORACLE = _oracle()
