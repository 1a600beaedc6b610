"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - threshold_k): all thresholds share the weights w of sparse text features, and the
thresholds are ordered. The severity of a text is its expected grade, the sum of these probabilities. The model is
fitted on a bounded sample of labelled rows, with an L1 penalty that leaves few weights, and scores every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, mixed, prefix_hash, span_hash, table, text_or_empty, utf8

SAMPLE = 8000
BITS = 20
PREFIXES = (4, 5)
LEAST_ROWS = 3
PENALTY = 5e-4
ROUNDS = 250
REJECT = 0.5


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[97:123] = True
    out[48:58] = True
    out[128:] = True
    return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, prefixes: tuple = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word prefix; words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = np.zeros(len(low) + 2, bool)
    solid[1:-1] = _letters()[low]
    starts, ends = solid[1:] & ~solid[:-1], ~solid[1:] & solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(low))]
    both = inner[solid[inner] & solid[inner + 1]]
    starts[both] = ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    total, back = prefix_hash(low)
    shift = np.uint64(64 - bits)
    rows, found = [row], [span_hash(total, back, start, end) >> shift]
    for n in prefixes:
        long_ = end - start > n
        s = start[long_]
        rows.append(row[long_])
        found.append(mixed(span_hash(total, back, s, s + n) + np.uint64(n)) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """Weights by feature and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, one column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(rows: np.ndarray, found: np.ndarray, grades: np.ndarray, bits: int = BITS, penalty: float = PENALTY,
        rounds: int = ROUNDS, least_rows: int = LEAST_ROWS) -> Model:
    """Accelerated proximal gradient on the mean negative log likelihood. rows, found: each feature of a row once.

    With fewer than two grades there is nothing to learn: weights are 0 and every text has the least grade.
    """
    n, top = len(grades), int(grades.max(initial=0))
    size = 1 << bits
    if n == 0 or top == 0 or (grades == grades[0]).all():
        return Model(np.zeros(size, np.float32), np.full(max(top, 1), 40.0))
    kinds, column, seen = np.unique(found, return_inverse=True, return_counts=True)
    use = seen[column] >= least_rows
    rows, column = rows[use], column[use]
    kinds_used, column = np.unique(column, return_inverse=True)
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(top)])
    thresholds = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    # features that barely move the loss of the bare thresholds never leave 0 under the penalty
    edges = np.concatenate([[1.0], 1 / (1 + np.exp(thresholds)), [0.0]])
    pull = (edges * (1 - edges))[:-1] - (edges * (1 - edges))[1:]
    start_slope = -(pull / np.maximum(edges[:-1] - edges[1:], 1e-9))[grades] / n
    strong = np.abs(np.bincount(column, start_slope[rows], len(kinds_used))) >= penalty / 2
    keep = strong[column]
    rows, column = rows[keep], column[keep]
    kinds_used, column = kinds_used[strong], (np.cumsum(strong) - 1)[column]
    # the loss of a row bends at most by 1/4 of the squared norm of its features
    step = 4.0 / max(1.0, np.bincount(rows, minlength=n).mean() * 0.05)
    w = np.zeros(len(kinds_used))
    z, t, momentum = w.copy(), thresholds.copy(), 1.0
    index = np.arange(n)

    def by_feature(w, thresholds):
        score = np.bincount(rows, w[column], n)
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[index, grades] - edge[index, grades + 1], 1e-9)
        by_score = -(slope[index, grades] - slope[index, grades + 1]) / p / n
        by_threshold = np.zeros(len(thresholds) + 2)
        np.add.at(by_threshold, grades, slope[index, grades] / p / n)
        np.add.at(by_threshold, grades + 1, -slope[index, grades + 1] / p / n)
        return -np.log(p).mean(), np.bincount(column, by_score[rows], len(w)), by_threshold[1:-1]

    last = np.inf
    for _ in range(rounds):
        loss, g, h = by_feature(z, t)
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        limits = np.maximum.accumulate(t - min(step, 4.0) * h)
        check = by_feature(new, limits)[0] + penalty * np.abs(new).sum()
        if check > last:  # too far: a shorter step, without momentum
            step, momentum, z, t = step / 2, 1.0, w.copy(), thresholds.copy()
            continue
        last = check
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        z = new + (momentum - 1) / after * (new - w)
        t = np.maximum.accumulate(limits + (momentum - 1) / after * (limits - thresholds))
        w, thresholds, momentum = new, limits, after
    out = np.zeros(size, np.float32)
    out[kinds[kinds_used]] = w
    return Model(out, thresholds)


def severity_grades(rows: np.ndarray, found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 from a yes/no label: 0 is not toxic; a toxic text has grade 2 if it holds more features that mark
    toxic texts (at least 20 times as common there) than the middle toxic text does."""
    yes = np.bincount(found[toxic[rows] == 1], minlength=1 << BITS)
    no = np.bincount(found[toxic[rows] == 0], minlength=1 << BITS)
    n_yes, n_no = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    marks = (yes >= 5) & (yes / n_yes >= 20 * (no + 0.5) / n_no)
    held = np.bincount(rows, marks[found], len(toxic))
    middle = np.median(held[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, 1 + (held > middle), 0)


def _distinct(rows: np.ndarray, found: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows.astype(np.int64) << bits) | found)
    return both >> bits, both & ((1 << bits) - 1)


SAMPLED = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("found", pa.list_(pa.int32()))])


def _sampled(batches):
    for batch in batches:
        for part in chunks(batch):
            rows, found = _distinct(*features(*utf8(part.column("text"))))
            at = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), lists], schema=SAMPLED)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, features and labels of the labelled documents whose ids have the ``most`` least hashes."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select("doc_id", text_or_empty().alias("text"))
    # the sample is bounded by ``most``, so it may be sent to every executor
    both = text.join(F.broadcast(chosen), "doc_id").mapInArrow(_sampled, "doc_id long, toxic int, found array<int>")
    got = both.toArrow().sort_by("doc_id")
    found = got.column("found").combine_chunks()
    lists = found if isinstance(found, pa.ListArray) else found.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(toxic), dtype=np.int32), sizes), lists.flatten().to_numpy(), toxic


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    rows, found, toxic = labelled_sample(docs, labels, most)
    return fit(rows, found, severity_grades(rows, found, toxic))


SCORED = "score double, severity double, toxic_probability double, grade int"


def _scored(weights: np.ndarray, thresholds: np.ndarray):
    model = Model(weights, thresholds)
    used = weights != 0

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                rows, found = features(*utf8(part.column("__text")))
                hit = used[found]
                rows, found = _distinct(rows[hit], found[hit])
                score = np.bincount(rows, weights[found].astype(np.float64), part.num_rows).astype(np.float64)
                above = model.above(score)
                edge = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
                grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1).astype(np.int32)
                names = [name for name in part.schema.names if name != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(name) for name in names], pa.array(score), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade)],
                    names=[*names, "score", "severity", "toxic_probability", "grade"])

    return run


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score, severity (expected grade), toxic_probability (of any grade above 0) and grade (the likeliest).

    A null or empty text has no features, so its severity is that of the thresholds alone. Rows are scored one by one:
    repeated rows and null ids come out as they are. Input columns named like the added ones are replaced; others pass
    through. An empty table gives no row.
    """
    added = ["score", "severity", "toxic_probability", "grade"]
    kept = docs.drop(*added)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], SCORED])
    return kept.withColumn("__text", text_or_empty()).mapInArrow(_scored(model.weights, model.thresholds), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = graded(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "severity", "toxic_probability", "grade", (F.col("toxic_probability") >= REJECT).alias("toxic"))
