"""WARC archives: writing records with segments, and reading them back by segment reassembly.

A page is written as a response record, or as a revisit of the record that holds the same payload. The body of
a response is an HTTP message in chunked transfer framing; long ones are cut into a first segment and
continuation records. The reader parses each archive by the lengths its headers give, groups continuations by
the identifier of their origin, orders them by segment number, verifies the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeledger.session import scratch_path

from .common import is_empty, pieces_of, same, staged, table

SEGMENT_CHARS = 16384
CHUNK_CHARS = 4096
FILE_RECORDS = 2000
BATCH_BYTES = 4 << 20
END = "\r\n"
# Fixed values of the formats.
VERSION = "WARC/1.1"
HTTP_HEAD = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(digest: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: each 5 digits are 20 bits, which are 4 digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _lines(*headers: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat(F.lit(VERSION + END), *[F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(END)), F.lit("")) for k, v in headers], F.lit(END))


def _chunked(payload: Column) -> Column:
    framed = F.transform(
        F.filter(pieces_of(payload, CHUNK_CHARS), lambda c: c != ""),
        lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(END), c, F.lit(END)),
    )
    return F.concat(F.lit(HTTP_HEAD), F.array_join(framed, ""), F.lit(f"0{END}{END}"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write a record for each distinct (page_id, html) of pages (page_id, url, html) into gzip archives at ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id is a
    response and the others revisit it.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("content"))
    roles = keyed.groupBy("content").agg(F.max("page_id").alias("origin"))
    rows = same(keyed, staged(roles, "warc-roles"), ["content"])  # a table of its own, so that Spark may split the join
    again = staged(keyed.groupBy("page_id", "content").count().where("count > 1").select("page_id", "content"), "warc-repeats")
    if not is_empty(again):  # only rows that repeat a page and its payload have to meet
        repeated = same(rows, again, ["page_id", "content"]).groupBy("page_id", "content", "origin").agg(
            F.min(F.struct(F.col("url").isNull(), "url", "html")).alias("r")).select("page_id", "content", "origin", "r.url", "r.html")
        rows = same(rows, again, ["page_id", "content"], "left_anti").select(*repeated.columns).unionByName(repeated)
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.substring("content", 1, 32), F.lit(">"))
    revisit = (F.octet_length("html") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("origin"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("sha1")))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    url = F.regexp_replace("url", "[\r\n]+", " ")
    rows = rows.select(
        name(F.col("page_id")).alias("id"), revisit.alias("revisit"), name(F.col("origin")).alias("origin"),
        url.alias("url"), digest.alias("digest"), _chunked(F.col("html")).alias("body"),
    )
    body = F.when(F.col("revisit"), F.array(F.lit(HTTP_HEAD))).otherwise(pieces_of(F.col("body"), SEGMENT_CHARS))
    cut = rows.select("id", "revisit", "origin", "url", "digest", F.octet_length("body").alias("total"), body.alias("cut"))
    cut = cut.select("*", F.size("cut").alias("n"), F.posexplode("cut").alias("i", "part")).drop("cut")
    first, last = F.col("i") == 0, F.col("i") == F.col("n") - 1
    only = lambda when, value: F.when(when, value if isinstance(value, Column) else F.lit(value))
    head = _lines(
        ("WARC-Type", F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.concat(F.expr("substr(id, 1, length(id) - 1)"), F.lit(":"), (F.col("i") + 1).cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", only(first, F.col("digest"))),
        ("WARC-Refers-To", only(F.col("revisit"), F.col("origin"))),
        ("WARC-Profile", only(F.col("revisit"), REVISIT_PROFILE)),
        ("WARC-Segment-Number", only(F.col("n") > 1, (F.col("i") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", only(~first, F.col("id"))),
        ("WARC-Segment-Total-Length", only((F.col("n") > 1) & last, F.col("total").cast("string"))),
        ("Content-Type", only(first, "application/http; msgtype=response")),
        ("Content-Length", F.octet_length("part").cast("string")),
    )
    # two line ends close a record, so they are the writer's separator and its files are archives as they are
    cut.select(F.concat(head, F.col("part")).alias("value")).write.option("lineSep", END + END).option(
        "compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = pa.schema([
    ("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()),
    ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()),
])


def records(archive: bytes):
    """(headers, block) of each record of an archive; headers in lower case. Lengths rule, not separators."""
    at, size = 0, len(archive)
    while at < size:
        if archive[at:at + 2] == b"\r\n":
            at += 2
            continue
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        at = end + 4 + int(head["content-length"])
        if at > size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, archive[end + 4:at]


def _parsed(batches):
    rows, held = [], 0
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_py()
            archive = b""
            while raw:  # members of a gzip file, one after the other
                member = zlib.decompressobj(31)
                archive += member.decompress(raw)
                raw = member.unused_data
            for head, block in records(archive):
                get = head.get
                number = lambda key: int(get(key)) if get(key) else None
                rows.append((
                    get("warc-record-id"), get("warc-type"), get("warc-target-uri"), get("warc-payload-digest"), get("warc-refers-to"),
                    get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block,
                ))
                held += len(block)
                if held >= BATCH_BYTES:
                    yield _batch(rows, RECORD)
                    rows, held = [], 0
    if rows:
        yield _batch(rows, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at ``path``, blocks as they are in the file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, "id string, kind string, url string, digest string, refers_to string, origin string, segment long, total long, block binary")


def unchunked(message: bytes) -> bytes | None:
    """Payload of an HTTP message; chunked framing is decoded, null if it is broken."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


DECODED = pa.schema([
    ("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()),
    ("payload", pa.binary()), ("payload_digest", pa.string()), ("intact", pa.bool_()),
])


def _decoded(batches):
    for batch in batches:
        rows, held = [], 0
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["segment"])
            whole = [p["segment"] for p in parts] == list(range(1, len(parts) + 1))
            message = b"".join(p["block"] for p in parts)
            if len(parts) > 1 or parts[0]["segmented"]:
                whole = whole and parts[-1]["total"] == len(message)
            payload = unchunked(message) if whole and r["kind"] == "response" else None
            digest = payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode()
            intact = whole and (r["kind"] != "response" or r["digest"] in (None, f"sha1:{digest}"))
            rows.append((r["id"], r["kind"], r["url"], r["digest"], r["refers_to"], payload, digest or None, intact))
            held += len(message)
            if held >= BATCH_BYTES:
                yield _batch(rows, DECODED)
                rows, held = [], 0
        if rows:
            yield _batch(rows, DECODED)


def reassembled(found: DataFrame) -> DataFrame:
    """One row per logical record: id, kind, url, digest, refers_to, payload, payload_digest, intact.

    Segments may lie in any archive, in any order. Equal copies of a segment count once. A record of which a
    segment is missing, whose total length does not fit, whose framing is broken or whose digest differs is not
    intact; a payload that cannot be put together is null. A group is the segments of one record.
    """
    segmented = F.col("segment").isNotNull() | F.col("origin").isNotNull()
    part = F.struct(F.coalesce("segment", F.lit(1)).cast("long").alias("segment"), "total", segmented.alias("segmented"), "block")
    cols = ["id", "kind", "url", "digest", "refers_to"]
    single = found.where(~segmented).select(*cols, F.array(part).alias("parts"))
    key = F.coalesce("origin", "id").alias("id")
    lead = lambda c: F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c)
    many = found.where(segmented).select(key, "origin", "kind", "url", "digest", "refers_to", part.alias("part"))
    many = many.groupBy("id").agg(*[lead(c) for c in cols[1:]], F.collect_set("part").alias("parts"))
    return single.unionByName(many).mapInArrow(
        _decoded, "id string, kind string, url string, digest string, refers_to string, payload binary, payload_digest string, intact boolean")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages as archives, read them back: page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact.

    A null html is an empty payload, a null url gives a record without one, and a null page_id is a page of its own
    (the smallest, so a response only where no other has its payload). Rows that repeat page_id and html are one record. An
    empty table gives no row; other columns are not read. Both figures are those of the full payload: a revisit
    takes them from the response it refers to.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    back = reassembled(read_records(pages.sparkSession, path))
    back = staged(back.select("id", "kind", "url", "digest", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "intact"), "warc-records")
    page = lambda c: F.nullif(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    source = back.where("kind = 'response'").select(F.col("id").alias("refers_to"), F.col("bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"), F.col("intact").alias("of_intact"))
    revisits = back.where("kind = 'revisit'").join(source, "refers_to", "left").select(
        "id", "url", "kind", "refers_to", F.col("of_bytes").alias("bytes"), F.col("of_digest").alias("payload_digest"),
        F.coalesce(F.col("of_intact") & (F.col("digest") == F.concat(F.lit("sha1:"), F.col("of_digest"))), F.lit(False)).alias("intact"),
    )
    whole = back.where("kind = 'response'").select("id", "url", "kind", "refers_to", "bytes", "payload_digest", "intact")
    return whole.unionByName(revisits).select(
        page(F.col("id")).alias("page_id"), "url", F.col("kind").alias("record_type"), page(F.col("refers_to")).alias("refers_to"),
        F.col("bytes").alias("payload_bytes"), "payload_digest", "intact",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS origin, sha1(html) AS hex FROM p GROUP BY html),
d AS (SELECT html, origin, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS digest FROM g)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to, true AS intact
FROM p JOIN d USING (html)
"""
