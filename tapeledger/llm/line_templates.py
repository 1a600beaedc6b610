"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, where a token with
a digit is a variable field. Within a leaf, a token that fewer than ``min_docs`` documents have at its position is
a variable field too; what remains is the line's template. Lines whose template recurs in ``min_docs`` documents go;
documents of the same text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BLANKS, WORD, clustered, release, staged, table, text_or_empty

LEADING = 3
MIN_DOCS = 5
FIXED_SHARE = 0.5
FIELD = "<*>"
DIGIT_TOKEN = f"[^{BLANKS}]*[0-9][^{BLANKS}]*"
KEY = ["__id", "__tag"]
LINE = ["line_a", "line_b"]


def _masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGIT_TOKEN, FIELD)).otherwise(line)


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` dealt by document: __id is never null, __tag tells texts apart, so plain equality joins."""
    none = F.lit("0").cast(docs.schema["doc_id"].dataType)
    return clustered(docs.withColumns({"__id": F.coalesce("doc_id", none), "__tag": F.xxhash64(text_or_empty())}), KEY, "keyed-documents")


def _lines(docs: DataFrame) -> DataFrame:
    """Key, line_no, n tokens, leaf and the two digests of each masked line; a line here is what lies between line feeds."""
    cut = docs.select(*KEY, F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line_no", "line"))
    cut = cut.select(*KEY, "line_no", _masked(F.col("line")).alias("line")).select("*", _tokens(F.col("line")).alias("tokens"))
    path = [F.get("tokens", F.lit(i)) for i in range(LEADING)]
    joined = F.array_join("tokens", " ")
    return cut.select(
        *KEY, "line_no", F.size("tokens").alias("n"), F.xxhash64(F.size("tokens"), *path).alias("leaf"),
        F.xxhash64(joined).alias("line_a"), F.xxhash64(F.lit(1), joined).alias("line_b"),
    )


def _in_documents(rows: DataFrame, by: list[str], name: str = "docs") -> DataFrame:
    """Number of different texts of each ``by``; the text is part of the first grouping, so no group is gathered."""
    return rows.select(*by, "__tag").distinct().groupBy(*by).agg(F.count("*").alias(name))


def _templates(docs: DataFrame, lines: DataFrame, min_docs: int, fixed_share: float) -> DataFrame:
    """line_a, line_b, template of the lines in leaves that ``min_docs`` documents reach and that keep enough fixed tokens."""
    leaves = _in_documents(lines, ["leaf"]).where(F.col("docs") >= min_docs).select("leaf")
    leaves = staged(leaves, "leaves")  # a table of its own, so that Spark may split the join
    among = lines.join(leaves, "leaf", "left_semi").groupBy("leaf", *LINE, "__tag").agg(F.min(F.struct("__id", "line_no")).alias("at"))
    distinct = among.groupBy("leaf", *LINE).agg(F.count("*").alias("docs"), F.min(F.struct("__tag", F.col("at.__id"), F.col("at.line_no"))).alias("at"))
    distinct = staged(distinct.select("leaf", *LINE, "docs", "at.*"), "distinct-lines")
    # the text of one line of each kind, from the document where it stands
    wanted = distinct.groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "leaf", *LINE, "docs")).alias("wanted"))
    held = docs.select(*KEY, text_or_empty().alias("text")).join(wanted, KEY)
    held = held.select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("w"))
    held = held.select("w.leaf", "w.line_a", "w.line_b", "w.docs", _tokens(_masked(F.get("all", F.col("w.line_no")))).alias("tokens")).distinct()
    tokens = held.select("leaf", *LINE, "docs", F.posexplode("tokens").alias("at", "token"))
    tokens = staged(tokens, "line-tokens")
    fixed = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d")
    fixed = fixed.where(F.col("token") != FIELD).withColumn("fixed", F.lit(True))
    marked = tokens.join(fixed, ["leaf", "at", "token"], "left").select(
        "leaf", *LINE, "at", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)).alias("token"), F.coalesce("fixed", F.lit(False)).alias("fixed"))
    shape = marked.groupBy("leaf", *LINE).agg(
        F.count_if("fixed").alias("kept"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "token"))).alias("shape"))
    shape = shape.where(F.col("kept") >= fixed_share * F.col("n"))
    return shape.select(*LINE, F.sha2(F.to_json(F.struct("leaf", "shape.token")), 256).alias("template"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, fixed_share: float = FIXED_SHARE) -> DataFrame:
    """Of the documents of ``keyed``: key, n_lines, dropped (line numbers from 0, null for none), whole (left as it is)."""
    lines = staged(_lines(docs), "lines")
    useful = lines.where("n > 0")  # the path of a line of up to LEADING tokens is all of it
    kinds = staged(_templates(docs, useful, min_docs, fixed_share), "templates")
    release(docs.sparkSession)
    found = staged(useful.join(kinds, LINE).select(*KEY, "line_no", "n", "template"), "template-lines")
    often = _in_documents(found, ["template"]).where(F.col("docs") >= min_docs).select("template")
    often = staged(often, "often")
    drops = found.join(often, "template", "left_semi").distinct().groupBy(*KEY).agg(
        F.sort_array(F.collect_list("line_no")).alias("dropped"), F.sum("n").alias("lost"))
    totals = lines.groupBy(*KEY, "line_no").agg(F.max("n").alias("n")).groupBy(*KEY).agg(
        F.count("*").alias("n_lines"), F.sum("n").alias("words"))
    out = totals.join(drops, KEY, "left")
    whole = F.coalesce(F.col("lost") >= F.col("words"), F.lit(False))
    return out.select(*KEY, "n_lines", F.when(~whole, F.col("dropped")).alias("dropped"), whole.alias("whole"))


def drop_templates(docs: DataFrame, **parameters) -> DataFrame:
    """All columns of ``docs`` with the recurring lines taken out of text, and n_lines, n_dropped, whole.

    A template must recur in ``min_docs`` documents and have ``fixed_share`` of its tokens fixed; lines of a word or two count like others.
    Texts that are equal count as one document. A document all of whose words lie in recurring lines has nothing of its
    own, so it is a copy rather than a document with boilerplate: it stays whole, for near-duplicate removal; any other
    loses its recurring lines, however many they are. Texts of any length are read whole. A text without a dropped line stays as it is, null included (one empty line).
    Rows that repeat doc_id and text share their result; a null doc_id is an id like any other.
    An empty table gives no row. Input columns named like the added ones are replaced; others pass through.
    """
    rows = keyed(docs.drop("n_lines", "n_dropped", "whole"))  # texts move here, once
    release(docs.sparkSession)
    marks = staged(recurring_lines(rows, **parameters), "line-marks")
    out = rows.join(marks.withColumnRenamed("dropped", "__dropped"), KEY)
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains(F.col("__dropped"), i))
    out = out.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.withColumn("n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("__dropped").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
    return out.drop(*KEY, "__dropped")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "whole", "text")
