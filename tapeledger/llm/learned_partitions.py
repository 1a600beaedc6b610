"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts so that few neighbours are
parted. A small classifier learns where the neighbours of a vector lie. It puts every vector of the table into one part,
and routes each query to its most probable parts, as many as held-out vectors needed to find their neighbours. The
vectors of these parts are compared exactly, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import staged, table

K = 5
# The model is fitted on at most SAMPLE rows; every row is indexed.
SAMPLE = 8192
MAX_PARTS = 1024
NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 30
HELD_OUT = 0.1
RECALL = 0.95
BALANCE = 0.05
QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096


def parts_for(n: int, most: int = MAX_PARTS) -> int:
    """A part holds about four times the square root of the number of vectors, until there are ``most`` parts."""
    return max(1, min(most, round(n**0.5 / 4)))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def neighbours_of(vectors: np.ndarray, among: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k rows of ``among`` nearest to each row; ``own``: row i of both is the same vector, and not its own neighbour."""
    out = []
    for start in range(0, len(vectors), 256):
        alike = vectors[start:start + 256] @ among.T
        if own:
            alike[np.arange(len(alike)), np.arange(start, start + len(alike))] = -2
        out.append(np.argpartition(-alike, k - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def balanced_parts(near: np.ndarray, parts: int, rng, balance: float = BALANCE, rounds: int = 40, sweeps: int = 10) -> np.ndarray:
    """Part of each node of the graph (node, its neighbours): halved along its slowest-mixing direction until there are
    enough parts, then nodes move to where most of their neighbours are, as far as the sizes stay balanced."""
    n, k = near.shape
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])

    def halve(nodes: np.ndarray, low: int, count: int) -> None:
        label[nodes] = low
        if count < 2 or len(nodes) < 2:
            return
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inner = (place[a] >= 0) & (place[b] >= 0)
        x, y = place[a[inner]], place[b[inner]]
        degree = np.bincount(x, minlength=len(nodes)) + 1e-9
        value = rng.normal(size=len(nodes))
        for _ in range(rounds):
            value -= (value * degree).sum() / degree.sum()
            value = 0.5 * value + 0.5 * np.bincount(x, weights=value[y], minlength=len(nodes)) / degree
            value /= np.abs(value).max() + 1e-30
        left = count // 2
        order = np.argsort(value, kind="stable")
        cut = len(nodes) * left // count
        halve(nodes[order[:cut]], low, left)
        halve(nodes[order[cut:]], low + left, count - left)

    halve(np.arange(n), 0, parts)
    most, least = int(n / parts * (1 + balance)) + 1, int(n / parts * (1 - balance))
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps if parts > 1 else 0):
        seen = np.zeros((n, parts), np.int32)
        np.add.at(seen, (a, label[b]), 1)
        own = seen[np.arange(n), label]
        to = seen.argmax(1)
        gain = seen.max(1) - own
        moved = 0
        for node in np.argsort(-gain, kind="stable").tolist():
            if gain[node] <= 0:
                break
            if size[to[node]] < most and size[label[node]] > least:
                size[label[node]] -= 1
                size[to[node]] += 1
                label[node] = to[node]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """Two layers of weights over unit vectors, and how many parts a query visits."""

    inner: np.ndarray
    bias: np.ndarray
    outer: np.ndarray
    shift: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return self.inner.shape[0]

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities, up to a constant for each row."""
        return np.maximum(vectors.astype(np.float32) @ self.inner + self.bias, 0) @ self.outer + self.shift

    def routes(self, vectors: np.ndarray) -> np.ndarray:
        """The parts of each row, the most probable first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")


def learn(vectors: np.ndarray, targets: np.ndarray, rng, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = 3e-3, batch: int = 256) -> Router:
    """Cross-entropy against the shares of ``targets``, by Adam."""
    dim, parts = vectors.shape[1], targets.shape[1]
    weights = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    vectors, targets, step = vectors.astype(np.float32), targets.astype(np.float32), 0
    total = epochs * -(-len(vectors) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(vectors))
        for start in range(0, len(order), batch):
            some = order[start:start + batch]
            x, t = vectors[some], targets[some]
            inside = x @ weights[0] + weights[1]
            active = np.maximum(inside, 0)
            out = active @ weights[2] + weights[3]
            out = np.exp(out - out.max(1, keepdims=True))
            error = (out / out.sum(1, keepdims=True) - t) / len(some)
            back = (error @ weights[2].T) * (inside > 0)
            step += 1
            now = rate * (1 - step / (total + 1))
            for w, g, f, s in zip(weights, (x.T @ back, back.sum(0), active.T @ error, error.sum(0)), first, second):
                f += 0.1 * (g - f)
                s += 0.001 * (g * g - s)
                w -= now * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Router(*weights, probes=parts)


def fit(sample: np.ndarray, parts: int, k: int = K, recall: float = RECALL, seed: int = 0) -> Router | None:
    """The router of a sample of vectors, in any order that is reproducible; None where there is too little to part."""
    rng = np.random.default_rng(seed)
    vectors = unit(sample.astype(np.float64)).astype(np.float32)
    n = len(vectors)
    if parts < 2 or n < 4 * parts or n <= NEIGHBOURS + 1:
        return None
    near = neighbours_of(vectors, vectors, NEIGHBOURS, True)
    label = balanced_parts(near, parts, rng)
    targets = np.zeros((n, parts), np.float32)
    np.add.at(targets, (np.repeat(np.arange(n), NEIGHBOURS), label[near].ravel()), 1)
    targets[np.arange(n), label] += 1
    targets /= targets.sum(1, keepdims=True)
    held = rng.permutation(n)[:max(int(n * HELD_OUT), 1)]
    train = np.setdiff1d(np.arange(n), held)
    router = learn(vectors[train], targets[train], rng)
    # how deep in a held-out vector's list the parts of its neighbours are
    part = router.scores(vectors).argmax(1)
    routes = router.routes(vectors[held])
    rank = np.empty_like(routes)
    np.put_along_axis(rank, routes, np.arange(parts)[None, :].repeat(len(held), 0), 1)
    nearest = neighbours_of(vectors[held], vectors, min(k + 1, n), False)
    nearest = [[j for j in row if j != i][:k] for i, row in zip(held, nearest)]
    depth = np.sort(np.concatenate([rank[r, part[np.array(row)]] for r, row in enumerate(nearest)]))
    router.probes = int(depth[min(int(np.ceil(recall * len(depth))), len(depth)) - 1]) + 1
    return router


# ---- index and search


def _placed(router: Router | None):
    def run(batches):
        for batch in batches:
            values = batch.column("v")
            out_part, out_probes = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            mine = np.flatnonzero(batch.column("dim").to_numpy(zero_copy_only=False) == (router.dim if router else -1))
            if len(mine):
                vectors = unit(np.concatenate([values[int(i)].values.to_numpy(zero_copy_only=False) for i in mine]).astype(np.float64).reshape(len(mine), -1))
                routes = router.routes(vectors)
                out_part[mine] = routes[:, 0]
                ask = batch.column("asks").to_numpy(zero_copy_only=False)
                for i, route in zip(mine.tolist(), routes[:, :router.probes].tolist()):
                    out_probes[i] = route if ask[i] else [route[0]]
            packed = pa.array([values[i].values.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed, batch.column("dim"), pa.array(out_part), pa.array(out_probes, pa.list_(pa.int32())), batch.column("asks")],
                names=["vec_id", "v", "dim", "part", "probes", "asks"])
    return run


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query the k rows of greatest cosine (ties to the smaller id) with another id, and the cosines.

    A product finds who may be among them; their cosines are summed row by row, so that equal vectors score equally.
    """
    norm, query_norm = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
    alike = (queries / query_norm[:, None]) @ (vectors / norm[:, None]).T
    alike[own[:, None] == ids[None, :]] = -np.inf
    for i in range(len(queries)):
        least = np.partition(alike[i], -k)[-k] if len(ids) > k else -np.inf
        some = np.flatnonzero((alike[i] >= least - 1e-9) & (alike[i] > -np.inf))
        score = (vectors[some] * queries[i]).sum(1) / (norm[some] * query_norm[i])
        first = np.lexsort((ids[some], -score))[:k]
        yield some[first], score[first]


def _rows(column, i: int, *names: str):
    items = column[i].values
    return [items.field(items.type.get_field_index(n)) for n in names]


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32)
    at = at[column.offset:column.offset + len(column) + 1]
    return data[at[0]:at[-1]].view("<f8").reshape(len(column), -1)


def _searched(k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                query, own, asked = _rows(batch.column("queries"), i, "query", "vec_id", "v")
                ids, held = _rows(batch.column("vectors"), i, "vec_id", "v")
                query, own, ids = query.to_numpy(), own.to_numpy(), ids.to_numpy()
                for q, o, (at, score) in zip(query, own, best(_matrix(asked), own, _matrix(held), ids, k)):
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), q)), pa.array(np.full(len(at), o)), pa.array(ids[at]), pa.array(score)], schema=FOUND)
    return run


def sampled(rows: DataFrame, n: int, dim: int, size: int) -> np.ndarray:
    """About ``size`` of the n vectors of a length, by the hash of their rows; never over a quarter more."""
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / n))
    got = rows.where(F.col("dim") == dim).where(share).select("vec_id", "v").limit(size + size // 4).toArrow().combine_chunks()
    values = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    order = np.lexsort((*values.T[::-1], got["vec_id"].to_numpy()))
    return values[order]


def nearest(vectors: DataFrame, is_query, k: int = K, sample: int = SAMPLE, recall: float = RECALL, parts: int | None = None,
            query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row by cosine, ties to smaller vec_id.

    Queries are the rows for which ``is_query`` holds, candidates all rows with another vec_id that lie in a part the
    query visits. Vectors that are null, empty or zero, hold a null or non-finite component, or have no vec_id take no
    part; vectors are compared with those of their own length, and those of another length than most are all compared.
    A row that repeats another is a candidate of its own, but one query. The model is fitted on about ``sample`` rows;
    ``parts`` follows the number of vectors. Below four sampled rows a part, all vectors are compared. An empty table
    gives no row; columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.size("embedding").alias("dim"), is_query.alias("asks"))
    lengths = usable.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths
    router = fit(sampled(usable, n, dim, sample), parts or parts_for(n), k, recall)
    indexed = usable.mapInArrow(_placed(router), "vec_id long, v binary, dim int, part int, probes array<int>, asks boolean")
    indexed = staged(indexed.withColumn("row", F.monotonically_increasing_id()), "indexed")
    wanted = indexed.where("asks").select("vec_id", "v", "dim", "probes", F.xxhash64("vec_id", "v").alias("query")).dropDuplicates(["vec_id", "v"])
    wanted = staged(wanted.select("vec_id", "v", "dim", "query", F.explode("probes").alias("part")), "routed")
    key = ["dim", "part"]
    asked = wanted.groupBy(*key).agg(F.ceil(F.count("*") / query_block).alias("qb"))
    held = indexed.groupBy(*key).agg(F.ceil(F.count("*") / vector_block).alias("vb"))
    sizes = staged(asked.join(held, key), "parts")
    blocks = indexed.join(sizes, key).withColumn("vector_at", F.pmod(F.hash("row"), F.col("vb"))).groupBy(*key, "vector_at", "qb").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("vectors"))
    asked = wanted.join(sizes, key).withColumn("query_at", F.pmod(F.hash("query", "vec_id"), F.col("qb"))).groupBy(*key, "query_at", "vb").agg(
        F.collect_list(F.struct("query", "vec_id", "v")).alias("queries"))
    # each block of queries meets each block of vectors of a part once, under a key of the two
    zero = F.lit(0).cast("long")
    left = asked.select(*key, "query_at", "queries", F.explode(F.sequence(zero, F.col("vb") - 1)).alias("vector_at"))
    right = blocks.select(*key, "vector_at", "vectors", F.explode(F.sequence(zero, F.col("qb") - 1)).alias("query_at"))
    met = left.join(right, [*key, "query_at", "vector_at"]).select("queries", "vectors")
    found = met.mapInArrow(_searched(k), "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
