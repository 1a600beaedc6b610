"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered,
then the numbers of adjacent blocks are paired, the distinct pairs sorted and numbered, and so on, until each
text has one number. Two texts share level and number exactly if they are equal: the numbers stand for
content, not for a digest of it, so nothing collides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import is_empty, pieces_of, release, same, staged, table, text_or_empty

BLOCK_CHARS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE = -(1 << 63)


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), UPPER, LOWER)


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names in sorted order within each partition; equal keys are one row, so they share a name."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame) -> DataFrame:
    """(doc_id, tag, idx, n, name) of blocks (doc_id, tag, idx, n, fp, block).

    Blocks travel once, to be made distinct and sorted. Names come back by the 64-bit value ``fp``; the blocks
    of which two share an fp (counted, not assumed away) are matched by their whole content instead.
    """
    names = staged(_named(blocks.select("fp", "block").distinct(), ["block"]).select("fp", "name"), "block-names")
    clash = staged(names.groupBy("fp").count().where("count > 1").select("fp"), "block-clashes")
    by_value = blocks.drop("block")
    if is_empty(clash):
        return by_value.join(names, "fp").drop("fp")
    among = blocks.join(clash, "fp", "left_semi")
    exact = staged(_named(among.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name")), "block-exact")
    return (
        by_value.join(clash, "fp", "left_anti").join(names, "fp").drop("fp")
        .unionByName(among.drop("fp").join(exact, "block").drop("block"))
    )


def identities(docs: DataFrame, text: Column, block_chars: int = BLOCK_CHARS, fp=F.xxhash64) -> DataFrame:
    """(doc_id, tag, level, name): one identity of each distinct (doc_id, tag); tag tells texts of one doc_id apart."""
    spark = docs.sparkSession
    cut = docs.select("doc_id", "tag", pieces_of(text, block_chars).alias("cut"))
    blocks = cut.select("doc_id", "tag", F.size("cut").alias("n"), F.posexplode("cut").alias("idx", "block"))
    level = staged(_block_names(blocks.withColumn("fp", fp("block"))), "level-0")
    most = level.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        release(spark)
        done.append(level.where("n = 1").select("doc_id", "tag", F.lit(depth).alias("level"), "name").distinct())
        if most <= 1:
            break
        pairs = (
            level.where("n > 1")
            .groupBy("doc_id", "tag", "n", F.expr("idx div 2").cast("int").alias("half"))
            .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"),
                 F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(NONE)).alias("b"))
            .select("doc_id", "tag", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.col("half").alias("idx"), "a", "b")
        )
        pairs = staged(pairs, "pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        depth, most = depth + 1, (most + 1) // 2
        level = staged(pairs.join(names, ["a", "b"]).drop("a", "b"), f"level-{depth}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, fp=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest doc_id stays.

    Texts are compared after lower-casing A-Z. A null text is an empty one. A null doc_id is the smallest; where
    a group has no other, its keep_id is null and its rows stay. A row that repeats a doc_id counts in group_size
    and shares the fate of that doc_id. An empty table gives no row; columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"), F.xxhash64(normalised()).alias("tag"))
    tagged = docs.select("doc_id", F.xxhash64(normalised()).alias("tag"), normalised().alias("text"))
    ids = staged(identities(tagged, F.col("text"), block_chars, fp), "identities")
    rows = staged(same(rows, ids, ["doc_id", "tag"]), "identified")
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = staged(groups, "groups")  # a table of its own, so that Spark may split the join
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
