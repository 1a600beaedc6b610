"""Ranked lexical search by K2-treaps over the term-document grid.

Documents are dealt into blocks of columns where they are read; the rows of the grid are the terms that any item asks
for, by weight. A block's grid is a quadtree without its empty cells, whose every cell holds the greatest impact below
it. The rows of an item descend jointly: a range of documents is bounded by the sum of the cells in which its rows meet
the range, ranges are opened best first, and a block is done when no open range can reach the item's k-th best score so far.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import chunks, staged, table, utf8

K = 20
BLOCK_DOCS = 4096
BLOCK_CELLS = 1 << 22
OPEN = 256
ITEM_TERMS = 1 << 20

# Fixed by contract: what a term is, told in bytes of UTF-8 and, for SQL, in characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.translate(LOW))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, once; ``length`` counts the document's terms."""
    m = 75 + (25 * length * n) // total
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


# ---- the items: bounded groups of them, each group one pass over the documents


def _item_terms(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        raw = data.tobytes()
        out = [Counter(terms_of(raw[a:b])) for a, b in zip(at, at[1:])]
        kinds = [pa.array([list(c.keys()) for c in out], pa.list_(pa.binary())), pa.array([list(c.values()) for c in out], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *kinds], names=["item", "item_id", "terms", "times"])


def item_groups(items: DataFrame, limit: int = ITEM_TERMS):
    """Lists of (item, item_id, terms, times) with about ``limit`` terms each; an item is a distinct row."""
    rows = items.select("item_id", "text").distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    rows = staged(rows.mapInArrow(_item_terms, f"item long, item_id {kind}, terms array<binary>, times array<long>").where("size(terms) > 0"), "items")
    groups = -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // limit)
    for g in range(groups):
        yield sorted(map(tuple, rows.where(F.pmod("item", F.lit(groups)) == g).collect()), key=lambda r: (r[0], repr(r[1])))


# ---- documents to postings


POSTED = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.binary()), ("docs", pa.binary()), ("tfs", pa.binary()),
                    ("counts", pa.list_(pa.int64()))])
POSTED_SQL = "ids array<long>, lengths binary, terms binary, docs binary, tfs binary, counts array<long>"


def _posted(known: dict[bytes, int], block_docs: int, block_cells: int):
    """Blocks of postings of the known terms; a last row of a task has N, L and the documents of each term."""
    def block(ids, lengths, sizes, terms, tfs):
        docs = np.repeat(np.arange(len(ids), dtype="<i4"), sizes)
        arrays = np.array(lengths, "<i8"), np.array(terms, "<i4"), docs, np.array(tfs, "<i8")
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((ids, *[a.tobytes() for a in arrays], None), POSTED)], schema=POSTED)

    def run(batches):
        counts = np.zeros(2 + len(known), np.int64)
        ids, lengths, sizes, terms, tfs = [], [], [], [], []
        for batch in batches:
            for part in chunks(batch):
                data, at = utf8(part.column("text"))
                raw = data.tobytes()
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist()):
                    words = terms_of(raw[a:b])
                    if not words:
                        continue
                    counts[0] += 1
                    counts[1] += len(words)
                    found = Counter(map(known.get, words))
                    found.pop(None, None)
                    if found:
                        ids.append(doc)
                        lengths.append(len(words))
                        sizes.append(len(found))
                        terms.extend(found.keys())
                        tfs.extend(found.values())
                        if len(ids) == block_docs or len(terms) >= block_cells:
                            np.add.at(counts, np.array(terms) + 2, 1)
                            yield block(ids, lengths, sizes, terms, tfs)
                            ids, lengths, sizes, terms, tfs = [], [], [], [], []
        if ids:
            np.add.at(counts, np.array(terms) + 2, 1)
            yield block(ids, lengths, sizes, terms, tfs)
        if counts[0]:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, None, counts.tolist()), POSTED)], schema=POSTED)
    return run


# ---- the treap of a block


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers, each followed by a zero."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for q in range(4)] for m in range(16)], np.int64)


class Treap:
    """Cells of all levels, from the root (cell 0) down to single postings.

    ``first`` is the number of a cell's first child, ``mask`` which of its quadrants (row half, column half) have one, and
    ``most`` the greatest impact in it. Children lie side by side in the order of their quadrants.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.height = int(max(rows.max(initial=0), columns.max(initial=0))).bit_length()
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, value = code[order], values[order]
        levels = [(value, np.zeros(len(value), np.int64), np.zeros(len(value), np.int64))]
        for _ in range(self.height):
            parent = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            mask = np.add.reduceat(1 << (code & np.uint64(3)).astype(np.int64), start)
            value, code = np.maximum.reduceat(value, start), parent[start]
            levels.append((value, start, mask))
        levels.reverse()
        base = np.cumsum([0, *[len(v) for v, _, _ in levels]])
        self.most = np.concatenate([v for v, _, _ in levels])
        self.first = np.concatenate([s + base[i + 1] for i, (_, s, _) in enumerate(levels)])
        self.mask = np.concatenate([m for _, _, m in levels])

    def below(self, cells: np.ndarray, rows: np.ndarray, bit: np.ndarray, half: int) -> np.ndarray:
        """The child of each cell (-1: empty) towards its row, in the given half of its columns."""
        quadrant = ((rows[None, :] >> bit[:, None]) & 1) * 2 + half
        place = BELOW[self.mask[cells], quadrant]
        return np.where((cells >= 0) & (place >= 0), self.first[cells] + place, -1)


def search(treap: Treap, rows: np.ndarray, times: np.ndarray, least, found, width: int = OPEN) -> None:
    """Call ``found(columns, scores)`` with the documents that may be among the best; ``least()`` is the score to reach.

    Up to ``width`` ranges are opened at a time, always those of the highest bounds.
    """
    zero = np.zeros(1, np.int64)
    cells, bound, level, column = np.zeros((1, len(rows)), np.int64), (treap.most[0] * times).sum(keepdims=True), zero, zero
    while len(bound):
        open_ = bound >= least()
        if not open_.all():
            cells, bound, level, column = cells[open_], bound[open_], level[open_], column[open_]
            if not len(bound):
                return
        if len(bound) > width:
            order = np.argpartition(-bound, width)
            take, rest = order[:width], order[width:]
        else:
            take, rest = slice(None), slice(0, 0)
        new = []
        bit = treap.height - 1 - level[take]
        if treap.height == 0:
            found(column[take], bound[take])
            return
        for half in (0, 1):
            child = treap.below(cells[take], rows, bit, half)
            score = np.where(child >= 0, treap.most[child], 0) @ times
            down = level[take] + 1
            some = (score > 0) & (score >= least())
            ends = some & (down == treap.height)
            if ends.any():
                found(column[take][ends] * 2 + half, score[ends])
            some &= ~ends
            new.append((child[some], score[some], down[some], column[take][some] * 2 + half))
        cells, bound, level, column = (np.concatenate([old[rest], *parts]) for old, parts in zip((cells, bound, level, column), zip(*new)))


class Best:
    """The k best (score, then smaller id; a missing id last) seen so far."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def put(self, scores, ids) -> None:
        for score, doc in zip(scores, ids):
            entry = (score, math.inf if doc is None else doc)
            entry = (entry[0], -entry[1])
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _ranked(items: list, known: dict[bytes, int], counts: list[int], k: int, width: int, found_schema: pa.Schema):
    """The k best documents of each item over all blocks of a task."""
    n, total = counts[:2]
    weights = np.array([weight(n, df) for df in counts[2:]], np.int64)
    order = np.argsort(-weights, kind="stable")
    row_of = np.empty(len(order), np.int64)
    row_of[order] = np.arange(len(order))  # terms of like weight lie together, so that cells bound tightly
    asked = [(row_of[[known[t] for t in terms]], np.array(times, np.int64)) for _, _, terms, times in items]

    def run(batches):
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_pylist()
                length, terms, docs, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("lengths", "<i8"), ("terms", "<i4"), ("docs", "<i4"), ("tfs", "<i8")))
                by_length = np.argsort(length, kind="stable")
                column_of = np.empty(len(ids), np.int64)
                column_of[by_length] = np.arange(len(ids))
                value = impacts(weights[terms], tf, length[docs], n, total)
                has = value > 0
                if not has.any():
                    continue
                treap = Treap(row_of[terms[has]], column_of[docs[has]], value[has])
                here = np.zeros(len(order), bool)
                here[row_of[terms[has]]] = True
                for one, (rows, times) in zip(best, asked):
                    mine = here[rows]
                    if mine.any():
                        search(treap, rows[mine], times[mine], one.least, lambda at, score: one.put(score.tolist(), [ids[j] for j in by_length[at]]), width)
        rows = [(item, item_id, None if doc == -math.inf else -doc, score) for (item, item_id, _, _), one in zip(items, best) for score, doc in one.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), found_schema)], schema=found_schema)
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_docs: int = BLOCK_DOCS, block_cells: int = BLOCK_CELLS, width: int = OPEN,
           item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, equal scores by smaller doc_id.

    Counts are those of all documents; every document is searched whole. An item is a distinct row of ``items``, so rows
    that share an item_id with other texts are ranked apart. Rows that repeat a doc_id are documents of their own, one
    without a doc_id comes last among equals. Null texts have no term; an item without a term, or without a document
    that scores above 0, has no row, and an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    schema = f"item long, item_id {kind.simpleString()}, doc_id long, score long"
    arrow = pa.schema([("item", pa.int64()), ("item_id", pa.string() if kind.simpleString() == "string" else pa.int64() if kind.simpleString() == "bigint" else pa.int32()),
                       ("doc_id", pa.int64()), ("score", pa.int64())])
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    for group in item_groups(items, item_terms):
        known = {t: i for i, t in enumerate(sorted({t for _, _, terms, _ in group for t in terms}))}
        posted = staged(texts.mapInArrow(_posted(known, block_docs, block_cells), POSTED_SQL), "postings")
        sums = posted.where("counts is not null").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        counts = [0] * (2 + len(known))
        for at, n in sums.collect():  # one number for each term of the items
            counts[at] = n
        if counts[0]:
            out = out.unionByName(posted.where("counts is null").drop("counts").mapInArrow(_ranked(group, known, counts, k, width, arrow), schema))
    order = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_SQL}')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
g AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(terms) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(terms)::BIGINT * n) // total AS m FROM d, g WHERE len(terms) > 0),
s AS (SELECT q.i, m.doc_id, m.r, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY ALL),
o AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT i.item_id, o.rank::INTEGER AS rank, o.doc_id, o.score FROM o JOIN i ON i.i = o.i WHERE o.rank <= {K}
"""
