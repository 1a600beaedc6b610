"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeledger.session import release, remove, scratch_path

# Fixed by contract: what separates words.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here, on storage all executors see."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def clustered(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """As ``staged``, dealt by ``keys`` into buckets: equi joins on just these keys do not move the rows again.

    The catalog entry goes at once (the table is external, so its files stay); the frame keeps the layout.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = scratch_path(spark, label), f"clustered_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of staged frames that nothing reads any more."""
    for frame in frames:
        remove(frame.sparkSession, frame.staged_at)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key matches a null key; keeps the keys of the left."""
    other = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[o]) for k, o in other.items()])
    return left.join(right, on, how).drop(*other.values())


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def pieces_of(column, chars: int):
    """Consecutive pieces of ``chars`` characters; one empty piece for an empty text."""
    found = F.regexp_extract_all(column, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(F.length(column) == 0, F.array(F.lit(""))).otherwise(found)


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


# ---- numpy over the bytes of Arrow string columns ----------------------------------------------


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset at which each row starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20):
    """Slices of a batch that hold about ``limit`` bytes of text (one row at least)."""
    sizes = np.diff(utf8(batch.column(column))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash of ``values``, and the factors that bring a difference of two to a common place."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=total[1:])
    return total, powers(_INVERSE, n)


def span_hash(total: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal spans wherever they lie."""
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(BASE))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the first word of each row (words never cross rows)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_BLANK[data]
    starts = solid[1:] & ~solid[:-1]
    ends = ~solid[1:] & solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    both = inner[solid[inner] & solid[inner + 1]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(*prefix_hash(data), start, end)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---- rows that a document id does not tell apart ------------------------------------------------


def shared_ids(docs: DataFrame) -> DataFrame | None:
    """doc_id of the ids that several rows have; None if there is none."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    several = staged(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    return None if is_empty(several) else several


def tagged(rows: DataFrame, several: DataFrame | None, tag: str = "tag", text: str = "text") -> DataFrame:
    """Rows with a tag that with doc_id tells texts apart: 0, or for an id that several rows have the hash of the text."""
    if several is None:
        return rows.withColumn(tag, F.lit(0).cast("long"))
    several = several.withColumnRenamed("doc_id", "__several")
    out = rows.join(several, F.col("doc_id") == F.col("__several"), "left")
    return out.withColumn(tag, F.when(F.col("__several").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("__several")


def texts_by_id(docs: DataFrame, several: DataFrame | None) -> DataFrame:
    """doc_id, tag, text of the rows with an id; of equal rows one. ``several``: the ``shared_ids`` of ``docs``."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if several is None:
        return tagged(rows, None)
    shared = tagged(rows.join(several, "doc_id", "left_semi"), several).dropDuplicates(["doc_id", "tag"])
    return tagged(rows.join(several, "doc_id", "left_anti"), None).unionByName(shared)


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """doc_id, text of the rows with an id; of rows that share one, those with one text (that of the least digest)."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    several = staged(
        rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("tag")).where("n > 1").select("doc_id", "tag"), "shared-ids")
    if is_empty(several):
        return rows
    chosen = rows.join(several, "doc_id").where(F.xxhash64("text") == F.col("tag")).select("doc_id", "text").dropDuplicates(["doc_id"])
    return rows.join(several, "doc_id", "left_anti").unionByName(chosen)
