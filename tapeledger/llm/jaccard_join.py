"""N-gram Jaccard join by a MinHash LSH forest.

Every distinct shingle set has a label of minimum hashes in each of ``TREES`` trees; the labels of a tree are the leaves
of a prefix trie. The prefix by which a text looks for others is shortened tree by tree: to the depth at which a pair at
the threshold meets in some tree with the target probability, and further, down to ``LEAST`` hashes, as long as
the trie node stays uncrowded. So crowded nodes stay as deep as the target recall allows. All pairs below a node are
compared on their whole shingle sets, a pair that meets in several trees in one of them only; nodes are cut into blocks,
and pairs of blocks are compared apart. Only pairs whose sizes rule the threshold out are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import (
    chunks, discard, is_empty, mixed, prefix_hash, release, same, signed, span_hash, staged, table, text_or_empty, utf8, word_hashes, words_of,
)

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 4
RECALL = 0.999
LEAST = 3
CROWD = 64
FILTER_BITS = 1 << 27
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 19


def shortest_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Longest prefix by which a pair of similarity ``threshold`` meets in one of the trees with probability ``recall``."""
    return next((d for d in range(depth, 0, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and where each row starts.

    A row with fewer words than a shingle has one shingle of all its words, a row without words none.
    """
    start, end, first = words_of(data, offsets)
    words = word_hashes(data, start, end)
    count = np.diff(first)
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(per)), per)
    begin = first[row] + np.arange(at[-1]) - at[row]
    total, back = prefix_hash(words)
    values = span_hash(total, back, begin, np.minimum(begin + size, first[row + 1]))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    row, values = row[fresh], values[fresh]
    return values, np.searchsorted(row, np.arange(len(per) + 1))


def minimums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n minimum hashes of each non-empty row, as unsigned 32-bit integers."""
    rows = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, n), np.uint32)
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for i in range(n):
        a, b = np.uint32(seeds[2 * i] & np.uint64(0xFFFFFFFF)) | np.uint32(1), np.uint32(seeds[2 * i + 1] & np.uint64(0xFFFFFFFF)) | np.uint32(1)
        h = low * a + high * b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[rows, i] = np.minimum.reduceat(h, at[rows])
    return out


LABELS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("node", pa.int64()), ("shingles", pa.int64()), ("labels", pa.list_(pa.binary()))])


def _labelled(size: int, trees: int, depth: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column("text"))
                values, at = shingle_sets(data, offsets, size)
                lows = minimums(values, at, trees * depth).astype(">u4")
                count = np.diff(at)
                place = np.arange(len(values)) - at[np.repeat(np.arange(len(count)), count)]
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
                node = signed(mixed(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64)))
                step = 4 * depth
                raw = lows.tobytes()
                labels = [
                    [raw[(i * trees + t) * step:(i * trees + t + 1) * step] for t in range(trees)] if count[i] else [] for i in range(len(count))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("tag"), pa.array(node), pa.array(count.astype(np.int64)), pa.array(labels, pa.list_(pa.binary()))], schema=LABELS)
    return run


def _named(depth: int):
    """A trie node, named by 64 bits of its tree and prefix; two that share a name only make a node larger."""
    return F.xxhash64(F.lit(depth), "tree", F.substring("label", 1, 4 * depth))


def _shared(members: DataFrame, key: str, name: str) -> DataFrame:
    """key, how many members: of the trie nodes with several. A table of its own, so that Spark may split joins with it."""
    return staged(members.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) > 1), "trie-nodes")


def meetings(nodes: DataFrame, shortest: int, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """node, trie: in each tree, the trie node below which a text meets others; none where it is alone.

    ``shortest`` is the depth that the target recall asks for. From there on a prefix is shortened for as long as at most
    ``crowd`` texts share it, down to ``least``; texts that share a prefix share its crowd, so they stop at the same node.
    Trie nodes with the very same members are one.
    """
    least = min(least, shortest)
    leaves = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    below = staged(leaves.select("node", "tree", F.substring("label", 1, 4 * shortest).alias("label"), _named(least).alias("trie")), "leaves")
    found = _shared(below, "trie", "n")
    # of a text that is alone at the shortest prefix, nothing more is asked in this tree
    members = staged(below.join(found, "trie").select("node", "tree", "label", F.when((F.col("n") <= crowd) | F.lit(least == shortest), F.col("trie")).alias("trie")), "members")
    discard(below, found)
    for depth in range(least + 1, shortest + 1):
        at = members.where("trie is null").withColumn("at", _named(depth))
        counts = _shared(at, "at", "n")
        fits = F.lit(True) if depth == shortest else F.col("n") <= crowd
        deeper = at.drop("trie").join(counts, "at").select("node", "tree", "label", F.when(fits, F.col("at")).alias("trie"))
        old, members = members, staged(members.where("trie is not null").unionByName(deeper), "members")
        discard(old, counts)
    sets = members.groupBy("trie").agg(F.count("*").alias("n"), *[
        F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]).where("n > 1")
    kept = staged(sets.groupBy("n", "h0", "h1").agg(F.min("trie").alias("trie")).select("trie"), "trie-nodes")
    return staged(members.select("node", "trie").join(kept, "trie").select("node", "trie"), "met")


def common(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``one`` shares with each set of ``other`` (sets as of ``shingle_sets``)."""
    (values, at), (others, ends) = one, other
    n, m = len(at) - 1, len(ends) - 1
    row, column = np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(m), np.diff(ends))
    order = np.argsort(others, kind="stable")
    others, column = others[order], column[order]
    low = np.searchsorted(others, values, "left")
    per = np.searchsorted(others, values, "right") - low
    out = np.zeros(n * m, np.int64)
    often = per > max(8, m // 16)
    kinds = np.unique(low[often])
    for i in range(0, len(kinds), 4096):  # shingles that many have: a product of 0/1 matrices
        some = kinds[i:i + 4096]
        mine = np.flatnonzero(often & (low >= some[0]) & (low <= some[-1]))
        left, right = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        left[row[mine], np.searchsorted(some, low[mine])] = 1
        many = np.searchsorted(others, others[some], "right") - some
        place = np.repeat(some, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        right[column[place], np.repeat(np.arange(len(some)), many)] = 1
        out += (left @ right.T).astype(np.int64).ravel()
    rest = np.flatnonzero(~often & (per > 0))
    share = np.cumsum(per[rest]) >> 22
    for some in np.split(rest, np.flatnonzero(np.diff(share)) + 1) if len(rest) else []:  # the others: pair by pair
        many = per[some]
        place = np.repeat(low[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out += np.bincount(np.repeat(row[some], many) * m + column[place], minlength=n * m)
    return out.reshape(n, m)


def linked(one, other, threshold: float) -> np.ndarray:
    """Whether each set of ``one`` and each set of ``other`` reach the threshold."""
    both = common(one, other)
    either = np.diff(one[1])[:, None] + np.diff(other[1])[None, :] - both
    return both / np.maximum(either, 1) >= threshold


def reached(links: np.ndarray, mine: np.ndarray, others: np.ndarray, one_side: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least label that each row and each column gets to over the links, from labels that tell them apart."""
    none = np.iinfo(np.int64).max
    while True:
        rows = np.minimum(mine, np.where(links, others[None, :], none).min(1, initial=none))
        columns = rows if one_side else np.minimum(others, np.where(links, rows[:, None], none).min(0, initial=none))
        if (rows == mine).all() and (columns == others).all():
            return rows, columns
        mine, others = rows, columns


LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def first_meets(keys: np.ndarray, others: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the least of the trie nodes that two texts share, given the trie nodes of each (rows padded with -1)."""
    out = np.ones((len(keys), len(others)), bool)
    for column in range(keys.shape[1]):
        earlier = (keys[:, column] < here) & (keys[:, column] != PADDING)
        if earlier.any():
            rows = np.flatnonzero(earlier)
            for other in range(others.shape[1]):
                out[rows] &= keys[rows, column][:, None] != others[None, :, other]
    return out


PADDING = np.iinfo(np.int64).max


def _linked(size: int, threshold: float):
    """Of each block (texts), or pair of blocks (texts, others): node, a node it is connected with, number of its links there."""
    def sets_of(texts: pa.Array):
        at = texts.field("keys")
        count = np.diff(at.offsets.to_numpy())
        keys = np.full((len(texts), max(count.max(initial=0), 1)), PADDING)
        keys[np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = at.flatten().to_numpy()
        return texts.field("node").to_numpy(), shingle_sets(*utf8(texts.field("text")), size), keys

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.column("root")[i].as_py()
                nodes, sets, keys = sets_of(batch.column("texts")[i].values)
                if one_side := "others" not in batch.schema.names:
                    links = first_meets(keys, keys, here)
                    np.fill_diagonal(links, False)
                    if not links.any():
                        continue
                    links &= linked(sets, sets, threshold)
                    label, _ = reached(links, nodes, nodes, True)
                    count = links.sum(1)
                else:
                    more, others, more_keys = sets_of(batch.column("others")[i].values)
                    links = first_meets(keys, more_keys, here)
                    if not links.any():
                        continue
                    links &= linked(sets, others, threshold)
                    label = np.concatenate(reached(links, nodes, more, one_side))
                    nodes, count = np.concatenate([nodes, more]), np.concatenate([links.sum(1), links.sum(0)])
                has = count > 0
                if has.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[has], pa.int64()) for c in (nodes, label, count)], schema=LINKS)
    return run


def _holding(keys: DataFrame, limit: int = FILTER_BITS):
    """A bit for each (doc_id, tag) of ``keys``: map function that lets only rows pass that may be among them.

    The bits follow the number of keys up to ``limit``, beyond which more rows pass that are not.
    """
    n = keys.count()
    size = min(limit, 1 << max(10, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(size)).cast("long")
    words = keys.select(at.alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 AS INT)) AS bit")
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()

    def run(batches):
        for batch in batches:
            where = batch.column("at").to_numpy()
            yield batch.filter(pa.array((bits[where >> 6] >> (where & 63)) & 1 == 1))

    def held(rows: DataFrame) -> DataFrame:
        with_place = rows.withColumn("at", at)
        return with_place.mapInArrow(run, with_place.schema).drop("at")
    return held


def links_within(groups: DataFrame, text: DataFrame, size: int, threshold: float) -> DataFrame:
    """node, root, n: links of each node of ``groups`` (node, root, shingles, doc_id, tag, keys) within its group, in parts to be summed.

    Root names the group, keys holds all groups of a node: a pair that shares several is linked in the least of them.

    A group over the size of a block is cut by size band, so that a pair at the threshold is in one band or two successive
    ones, and by hash; each pair of its blocks that may hold links is a row of work of bounded size.
    """
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("shingles") / BLOCK_SHINGLES)).cast("long")
    step = max(-math.log(threshold), 1e-9) * (1 + 1e-9) if threshold > 0 else math.inf
    large = staged(groups.groupBy("root").agg(parts.alias("parts")).where("parts > 1").select("root", F.lit(True).alias("large")), "large-groups")
    banded = groups.join(large, "root", "left").withColumn("large", F.coalesce("large", F.lit(False))).withColumn(
        "band", F.when(F.col("large"), F.floor(F.log("shingles") / F.lit(step))).otherwise(0).cast("long"))
    banded = staged(banded, "banded")
    bands = staged(banded.groupBy("root", "band", "large").agg(parts.alias("parts")), "bands")
    placed = banded.join(bands.drop("large"), ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = staged(placed.select("node", "doc_id", "tag", "keys", "root", "band", "part", "large"), "placed-texts")
    key = ["root", "band", "part", "large"]
    # few texts meet any other: the rest stays where it is, and the join that follows moves texts at every size of input
    wanted = staged(placed.groupBy("node", "doc_id", "tag", "keys").agg(F.collect_list(F.struct(*key)).alias("at")), "wanted-texts")
    some = _holding(wanted.select("doc_id", "tag"))(text)
    held = same(some, wanted.hint("merge"), ["doc_id", "tag"]).groupBy("node").agg(F.first(F.struct("text", "keys", "at")).alias("r"))
    held = held.select("node", "r.text", "r.keys", F.explode("r.at").alias("at")).select("node", "text", "keys", "at.*")
    blocks = staged(held.groupBy(*key).agg(F.collect_list(F.struct("node", "text", "keys")).alias("texts")), "blocks")
    discard(banded, placed, wanted)
    release(text.sparkSession)
    run, schema = _linked(size, threshold), "node long, root long, n long"
    within = staged(blocks.select("root", "texts").mapInArrow(run, schema), "links")
    numbered = bands.where("large").select("root", "band", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    same_band = numbered.where("part + 1 < parts").select("root", "band", "part", F.col("band").alias("band2"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part2"))
    after = numbered.select("root", (F.col("band") - 1).alias("band"), F.col("band").alias("band2"), F.col("part").alias("part2"))
    next_band = numbered.select("root", "band", "part").join(after, ["root", "band"]).select("root", "band", "part", "band2", "part2")
    pairs = staged(same_band.unionByName(next_band), "block-pairs")
    if is_empty(pairs):
        discard(blocks)
        return within
    cut = blocks.where("large").select("root", "band", "part", "texts")
    others = cut.withColumnsRenamed({"band": "band2", "part": "part2", "texts": "others"})
    both = pairs.join(cut, ["root", "band", "part"]).join(others, ["root", "band2", "part2"]).select("root", "texts", "others")
    between = staged(both.mapInArrow(run, schema), "links-between")
    discard(blocks)
    return within.unionByName(between)


def components(links: DataFrame) -> DataFrame:
    """node, root of the nodes in links (a, b). Each round links every root to its least neighbour and contracts."""
    edges = staged(links.select("a", "b").distinct(), "edges")
    roots = staged(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not is_empty(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("least")).select("from", F.least("from", "least").alias("to"))
        up = staged(up, "parents")
        above = up.select(F.col("from").alias("to"), F.col("to").alias("top"))
        twice = staged(up.join(above, "to", "left").select("from", F.coalesce("top", "to").alias("to")), "parents")
        old, roots = roots, staged(roots.join(twice, roots["root"] == twice["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        done, edges = edges, staged(
            edges.join(twice.withColumnsRenamed({"from": "a", "to": "x"}), "a").join(twice.withColumnsRenamed({"from": "b", "to": "y"}), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        discard(up, twice, old, done)
    return roots


def similar(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL,
            trees: int = TREES, depth: int = DEPTH, least: int = LEAST, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, tag, node of each row, and node, root, n: a node it is connected with, and its verified links, in parts.

    A node is a distinct shingle set. Rows are shuffled by node, prefix or block, never by class; a crowded key only adds
    to sums and minimums, or to a join that Spark may split.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tag"), text_or_empty().alias("text"))
    labelled = staged(text.mapInArrow(_labelled(size, trees, depth), "doc_id long, tag long, node long, shingles long, labels array<binary>"), "labels")
    rows = staged(labelled.select("doc_id", "tag", "node"), "rows")
    nodes = labelled.where("shingles > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "tag")).alias("at"), F.first("labels").alias("labels"), F.first("shingles").alias("shingles"))
    nodes = staged(nodes, "nodes")
    discard(labelled)
    met = meetings(nodes.select("node", "labels"), shortest_depth(threshold, recall, trees, depth), least, crowd)
    release(spark)
    # a text is in one trie node of each tree at most, so its list is short
    keys = met.groupBy("node").agg(F.array_sort(F.collect_list("trie")).alias("keys"))
    groups = nodes.select("node", "at.doc_id", "at.tag", "shingles").join(keys, "node").withColumn("root", F.explode("keys"))
    groups = staged(groups, "groups")
    discard(met, nodes)
    links = links_within(groups, text, size, threshold)
    discard(groups)
    return rows, links


def _classes(docs: DataFrame, **parameters) -> tuple[DataFrame, DataFrame]:
    """(placed, classes): every row with the root of its class, and of each class its least id, size and the row that stays."""
    rows, links = similar(docs, **parameters)
    roots = components(links.where("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")))
    ends = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    placed = rows.join(roots, "node", "left").join(ends, "node", "left").select(
        "doc_id", "tag", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = staged(placed, "placed")
    classes = placed.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("stays"))
    return placed, staged(classes, "classes")  # a table of its own, so that Spark may split joins with it


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, tag, class_key, class_id, class_size, n_links of every row; a class is connected by links of similarity at least ``threshold``.

    class_key tells classes apart, class_id is the least doc_id of the class, tag the digest of the row's text. Texts with
    the same shingle set are copies: one node, not a link. n_links is the number of other shingle sets that reach the
    threshold with the text's: all that meet it in the forest are counted, and a pair at the threshold meets with
    probability ``recall`` at least. A null text is an empty one, and empty texts are copies of each other. Fewer than
    ``size`` words are one shingle; texts of any length are compared whole. Rows that repeat a doc_id are rows of their
    own; a null doc_id is the least, so a class with one has a null class_id only if it has no other id. An empty table
    gives no row. Other columns are not read.
    """
    placed, classes = _classes(docs, **parameters)
    return placed.join(classes.drop("stays"), "root").select("doc_id", "tag", F.col("root").alias("class_key"), "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class, the row with the least doc_id stays, all columns as they are.

    A row with a null doc_id stays only if its class has no other; of rows that repeat doc_id and text, one stays.
    """
    _, classes = _classes(docs, **parameters)
    chosen = classes.select("stays.doc_id", F.col("stays.tag").alias("__tag"))
    kept = same(docs.withColumn("__tag", F.xxhash64(text_or_empty())), chosen, ["doc_id", "__tag"])
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("__tag"))
    if not is_empty(rows.groupBy("doc_id", "__tag").count().where("count > 1")):
        kept = kept.dropDuplicates(["doc_id", "__tag"])
    return kept.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")
