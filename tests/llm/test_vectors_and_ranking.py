"""Learned partitions, K2-treap ranking and heap-ordered centroids: against brute force, and at the edges."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tapeledger.llm import centroids, learned_partitions, lexical_search

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType())])
NAN, INF = float("nan"), float("inf")


def floats(vector):
    return [float(np.float32(x)) for x in vector]


# ---- learned partitions


def cosine(a, b):
    return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))


def brute_cosine(rows, every, k=5):
    use = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in use:
        if q % every == 0:
            scores = sorted((-cosine(v, w), i) for i, w in use if i != q and len(w) == len(v))
            out.setdefault((q, tuple(v)), [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])])
    return out


def blobs(n, dim, kinds, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, dim))
    return [(i, floats(middle[rng.integers(kinds)] + 0.4 * rng.normal(size=dim)), "x") for i in range(n)]


ODD = [(2000, None, "x"), (2010, [], "x"), (2020, [0.0] * 16, "x"), (2030, [1.0, None] + [0.0] * 14, "x"), (2040, [NAN] * 16, "x"),
       (None, [1.0] * 16, "x"), (2050, [INF] + [0.0] * 15, "x"), (2060, [1.0, 2.0], "x"), (2061, [1.0, 2.5], "x")]


def test_learned_partitions_find_what_brute_force_finds(spark):
    rows = blobs(900, 16, 12) + ODD
    rows += [(1000 + i, rows[7][1], "x") for i in range(9)]  # ties
    got = learned_partitions.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, parts=12, query_block=20, vector_block=30).collect()
    want = {q: best for (q, _), best in brute_cosine(rows, 10).items()}
    assert {r.query_id for r in got} == set(want)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert math.isclose(r.score, cosine(dict((i, v) for i, v, _ in rows)[r.query_id], dict((i, v) for i, v, _ in rows)[r.vec_id]), rel_tol=1e-12)
    for best in ranks.values():
        best.sort()
        assert [n for n, _, _ in best] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in best] == sorted((-s, i) for _, i, s in best)
    hits = [(q, i) in found for q, best in want.items() for _, i, _ in best]
    assert sum(hits) / len(hits) >= 0.9


def test_router_visits_a_few_parts_where_neighbours_are_together():
    vectors = np.array([v for _, v, _ in blobs(3000, 16, 12)])
    router = learned_partitions.fit(vectors, 12)
    assert router.probes <= 6
    label = learned_partitions.balanced_parts(learned_partitions.neighbours_of(*[learned_partitions.unit(vectors)] * 2, 10, True), 12, np.random.default_rng(0))
    assert np.bincount(label).max() <= 3000 / 12 * 1.06 + 1 and np.bincount(label).min() >= 3000 / 12 * 0.94 - 1
    assert learned_partitions.fit(vectors[:20], 12) is None


def test_learned_partitions_without_a_model_are_exact(spark):
    rows = [(i, floats(v), "x") for i, v in enumerate(np.random.default_rng(2).normal(size=(40, 4)))] + [(5, floats([1, 2, 3, 4]), "x"), (10, floats([4, 3, 2, 1]), "x")] * 2
    got = learned_partitions.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, parts=1, query_block=2, vector_block=7).collect()
    want = sorted((q, n, i) for (q, _), best in brute_cosine(rows, 10).items() for n, i, _ in best)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want


def test_learned_partitions_of_nothing(spark):
    for rows in ([], [(0, [1.0], "x")], [(0, None, "x")]):
        assert learned_partitions.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect() == []


# ---- ranked lexical search

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)


def brute_ranked(docs, items, k=20):
    texts = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    out = []
    for item, text in dict.fromkeys(items):
        asked = TERM.findall((text or "").translate(LOW))
        scores = []
        for i, words in texts:
            m, score = 100 - 25 + (25 * len(words) * n) // total, 0
            for term in asked:
                tf, df = words.count(term), sum(term in set(w) for _, w in texts)
                score += tf and math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [(2, 7, 2, 5), (4096, 1 << 22, 256, 1 << 20)])
def test_ranking_equals_brute_force(spark, make_docs, prose, size):
    words = prose(3, 40) + ["Été", "x1", "1999"]
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(None, docs[4][1]), (7, "repeats an id été ÉTÉ"), (300, None), (301, ""), (302, "—\t.!"), (303, "Été-x1_x1 " * 5000)]
    items = [(i, " ".join(rng.choice(words, 9)) + ", unseenword X1") for i in range(7)] + [(2, "x1"), (2, "x1"), (50, None), (51, "..."), (None, "1999"), (52, "unseenword")]
    block_docs, cells, width, terms = size
    got = lexical_search.ranked(make_docs(docs).repartition(3), spark.createDataFrame([(*i, "x") for i in items], ITEMS), block_docs=block_docs, block_cells=cells, width=width, item_terms=terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranked(docs, items)


def test_ranking_of_nothing(spark, make_docs):
    items = spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert lexical_search.ranked(make_docs([]), items).collect() == []
    assert lexical_search.ranked(make_docs([None, ""]), items).collect() == []
    assert lexical_search.ranked(make_docs(["a"]), items.limit(0)).collect() == []
    clash = make_docs(["a c", "b"]).withColumn("score", F.lit("mine")).withColumn("item", F.lit(0))
    assert [r.doc_id for r in lexical_search.ranked(clash, items).collect()] == [1, 0]


def test_treap_holds_every_cell():
    rng = np.random.default_rng(1)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, 37, 300), rng.integers(0, 90, 300), rng.integers(1, 1000, 300))}
    rows, columns = (np.array([x[i] for x in cells]) for i in (0, 1))
    treap = lexical_search.Treap(rows, columns, np.array(list(cells.values())))
    for row in range(37):
        found = {}
        lexical_search.search(treap, np.array([row]), np.array([1]), lambda: 1, lambda at, score: found.update(zip(at.tolist(), score.tolist())), 4)
        assert found == {c: v for (r, c), v in cells.items() if r == row}
    assert treap.most[0] == max(cells.values())


# ---- centroid clustering


def brute_clusters(rows, k, rounds, dim, scale, seed):
    use = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in use if i is not None)
    centers = [v for _, v in start[:k]]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in use]
        for n in range(len(centers)):
            mine = [v for (_, v), o in zip(use, own) if o == n]
            if mine:
                centers[n] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in use]
    total = sum(d for _, d, _ in found)
    return sorted([(i, n, d, sum(x for _, x, m in found if m == n), total, hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, d, n in found], key=repr)


@pytest.mark.parametrize("rounds,block", [(0, 4096), (1, 7), (6, 16)])
def test_clusters_equal_brute_force(spark, rounds, block):
    rows = blobs(150, 16, 4, seed=3) + ODD + [(5, floats(np.arange(16)), "x"), (None, floats(-np.arange(16)), "x")]
    rows += [(400 + i, rows[9][1], "x") for i in range(20)] + [rows[11]] * 30
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=5, rounds=rounds, dim=16, block=block)
    want = brute_clusters(rows, 5, rounds, 16, 1024, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_clusters_with_few_far_or_no_vectors(spark):
    def run(rows, **more):
        return sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, VECTORS), dim=2, **more).collect()), key=repr)

    far = [(i, [float(1 << 14) * i, -float(1 << 14)], "x") for i in range(6)]  # sums a double does not hold
    assert run(far, k=3, rounds=4) == brute_clusters(far, 3, 4, 2, 1024, 3)
    assert run(far[:2], k=8, rounds=3) == brute_clusters(far[:2], 8, 3, 2, 1024, 3)
    assert run([]) == [] and run([(1, [1.0], "x"), (2, None, "x")]) == [] and run([(None, [1.0, 2.0], "x")]) == []


def test_heaps_rescan_only_what_may_have_moved():
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.integers(-50, 50, (200, 4)) + m for m in (0, 5000)])
    centers = np.array([[0, 0, 0, 0], [5000, 5000, 5000, 5000]])
    heaps, drift = [[], []], [0.0, 0.0]
    popped, had, now = centroids.rescan(vectors, heaps, centers, drift, True)
    assert len(popped) == 400 and (had == -1).all() and np.bincount(now).tolist() == [200, 200]
    assert len(centroids.rescan(vectors, heaps, centers, [100.0, 100.0], False)[0]) == 0
    moved = centers + 3000
    popped, had, now = centroids.rescan(vectors, heaps, moved, [12000.0, 12000.0], False)
    assert len(popped) == 400 and set(now[had == 0]) == {0}
