"""Operators whose results a contract fixes: against brute force, at the edges."""

import base64
import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tapeledger.llm import exact_dedup, mixing, suffix_dedup, vector_search, warc

from .conftest import WORD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- exact dedup


def brute_exact(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for i, t in pairs:
        low = (t or "").translate(LOW)
        ids = [x for x in groups[low] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[low]), i == keep, hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = [(0, "Same TEXT"), (1, "same text"), (2, "ÉTÉ"), (3, "été"), (4, ""), (5, None), (6, "abcdefgh" * 9), (7, "abcdefgh" * 9 + "x"),
         (8, "ABCDEFGH" * 9), (9, "abcdefgh" * 9), (None, "same text"), (None, "alone"), (10, "abcd"), (10, "abcd"), (11, "abcdabcd"), (12, "abcd" * 3)]


@pytest.mark.parametrize("chars", [3, 8, 4096])
def test_exact_dedup_equals_brute_force(make_docs, chars):
    got = exact_dedup.exact_dedup(make_docs(CASES), block_chars=chars).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(CASES)


def test_exact_dedup_does_not_trust_the_digest(make_docs):
    got = exact_dedup.exact_dedup(make_docs(CASES), block_chars=4, fp=lambda c: F.length(c).cast("long") % 2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(CASES)


def test_exact_dedup_of_nothing_and_of_other_columns(make_docs):
    assert exact_dedup.exact_dedup(make_docs([])).collect() == []
    extra = make_docs(["a", "A"]).withColumn("name", F.lit(1)).withColumn("group_size", F.lit("x")).withColumn("tag", F.lit(0))
    assert {r.keep_id for r in exact_dedup.exact_dedup(extra).collect()} == {1}


# ---- suffix dedup


def brute_suffix(pairs, n=50):
    first, out = {}, {}
    for i, t in sorted(pairs):
        b, mark = (t or "").encode(), bytearray(len((t or "").encode()))
        for at in range(len(b) - n + 1):
            if first.setdefault(b[at:at + n], i) < i:
                mark[at:at + n] = b"\1" * n
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for at, m in enumerate(mark) if m and (not at or not mark[at - 1]))
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_suffix(docs, pairs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_suffix(pairs)


def test_suffix_dedup_equals_brute_force(make_docs, prose):
    a, b, c = (" ".join(prose(s, 60)) for s in range(3))
    texts = [a, "x" + a[30:140] + b, b[:49], b[10:59], b[10:60], a, a + c, c[:200] + "–" + c[200:], "é" * 200, "é" * 40, "ab" * 90, "ba" * 60, "", None, "z" * 50,
             a[:80] + a[:80], c[100:160] + a[40:130] + b[7:99], "ab" * 24]
    check_suffix(make_docs(texts), list(enumerate(texts)))


def test_suffix_dedup_with_heavy_anchors(make_docs, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_COUNT", 0)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_OF", 1)
    line = " ".join(prose(9, 12))
    texts = [" ".join(prose(s, 9)) + line + " ".join(prose(s + 50, 9)) for s in range(12)]
    check_suffix(make_docs(texts), list(enumerate(texts)))


def test_suffix_dedup_edges(make_docs, prose):
    text = " ".join(prose(1, 30))
    assert suffix_dedup.remove_repeats(make_docs([])).collect() == []
    docs = make_docs([(None, text), (3, text), (3, text), (4, text)]).withColumn("n_bytes", F.lit("old"))
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(-1, 0), (3, 0), (3, 0), (4, len(text.encode()))]


def test_multikey_quicksort_and_blind_trie_sort_like_sorted():
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.integers(97, 99, 70).astype(np.uint8)) for _ in range(40)]
    pieces += pieces[:7]
    at, group = np.full(len(pieces), 100), np.zeros(len(pieces), int)
    for length, shallow in ((20, 8), (50, 16)):
        which, begin, kind = suffix_dedup.equal_windows(pieces, at, group, length, shallow)
        found = [(100 - b, pieces[p][b:b + length]) for p, b in zip(which, begin)]
        assert found == sorted(found)
        assert all((kind[i] == kind[i - 1]) == (found[i] == found[i - 1]) for i in range(1, len(found)))


# ---- WARC


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def test_warc_round_trip(spark):
    long_ = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 3000
    rows = [(1, "http://a", "x"), (2, "http://b\r\nevil: 1", "x"), (3, None, None), (4, "http://d", ""), (5, "http://e", long_), (6, "http://f", long_ + "!"), (9, "u", "x"), (9, "u", "x"), (None, "n", "only")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("kind", F.lit(1))).collect()}
    assert len(got) == 8 and all(r.intact for r in got.values())
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {p: r.refers_to for p, r in got.items()} == {1: 9, 2: 9, 3: 4, 4: None, 5: None, 6: None, 9: None, None: None}
    assert {p for p, r in got.items() if r.record_type == "response"} == {4, 5, 6, 9, None}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_short_payloads_are_not_revisits(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "long payload"), (4, "d", "long payload")]
    got = {r.page_id: r.record_type for r in warc.round_trip(spark.createDataFrame(rows, PAGES), min_revisit_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def archive(tmp_path, *records):
    folder = tmp_path / "warc"
    folder.mkdir()
    for i, (head, block) in enumerate(records):
        lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
        (folder / f"{i}.warc.gz").write_bytes(gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"))
    return str(folder)


def test_segments_in_any_order_and_missing_ones(spark, tmp_path):
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n5;x=1\r\ndefgh\r\n0\r\n\r\n"
    def parts(name, total):
        return [
            ({"WARC-Type": "continuation", "WARC-Record-ID": f"{name}2", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": 2, "WARC-Segment-Total-Length": total}, message[20:]),
            ({"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Segment-Number": 1}, message[:20])]
    whole, short, lost = parts("<a>", len(message)), parts("<b>", len(message) + 1), parts("<c>", len(message))[:1]
    plain = ({"WARC-Type": "response", "WARC-Record-ID": "<d>"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    broken = ({"WARC-Type": "response", "WARC-Record-ID": "<e>"}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc")
    path = archive(tmp_path, *whole, whole[0], *short, *lost, plain, broken)
    got = {r.id: (r.payload and bytes(r.payload), r.intact) for r in warc.reassembled(warc.read_records(spark, path)).collect()}
    assert got["<a>"] == (b"abcdefgh", True) and got["<d>"] == (b"body", True)
    assert got["<b>"] == (None, False) and got["<c>"] == (None, False) and got["<e>"][0] is None


# ---- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        share = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if 3 * sizes[s] <= share * weight[s]}
        if not above:
            return {s: 3 * sizes[s] if s in full else share * weight[s] for s in order}
        full |= above


def test_mixing_targets_and_taken_words(make_docs, prose):
    texts, sources = [], []
    for s, (name, n) in enumerate([("b", 300), ("a", 20), (None, 40), ("é", 15), ("z", 1), ("empty", 3)]):
        for i in range(n):
            texts.append(None if name == "empty" else " ".join(prose(1000 * s + i, 5 + i % 23)))
            sources.append(name)
    docs = make_docs(texts, sources)
    got = mixing.mix(docs).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = sources[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[s]
        assert math.isclose(r.target, want[s], rel_tol=1e-12) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 28 for s in sizes) and len(got) == len(texts)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    copies = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in got)


def test_mixing_of_rows_that_ids_do_not_tell_apart(make_docs, prose):
    """Two sources of 500 words whose ids are null, and a third whose rows are all the same."""
    texts = [(None, " ".join(prose(i, 5))) for i in range(200)] + [(7, "the same five words again")] * 100
    docs = make_docs(texts, ["a"] * 100 + ["b"] * 100 + ["c"] * 100)
    got = mixing.mix(docs).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert {r.n for r in got} == {100} and len(got) == 3
    assert all(abs(r.taken - r.target) <= 5 for r in got)
    again = mixing.mix(docs.repartition(5)).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert {(r.target, r.taken) for r in again} == {(r.target, r.taken) for r in got}
    assert mixing.mixed_documents(docs).count() * 5 == sum(r.taken for r in got)


def test_mixing_edges(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    assert [(r.taken, r.target) for r in mixing.mix(make_docs([None, ""])).collect()] == [(0, 0.0)] * 2
    clash = make_docs([(None, "a b"), (1, "c"), (1, "c")]).withColumn("target", F.lit("x")).withColumn("h", F.lit(0))
    assert sum(r.taken for r in mixing.mix(clash).collect()) == 4


# ---- vectors


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType())])


def brute_nearest(rows, every, k=5):
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in use if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2, 7), (256, 4096)])
def test_nearest_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)], "x") for i in range(90)]
    rows += [(i, [0.5, -0.5, 0.25, 0.0, 0.0, 1.0], "x") for i in range(90, 110)]  # ties
    rows += [(5, rows[5][1], "x"), (200, None, "x"), (201, [], "x"), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (220, [float("nan")] * 6, "x"),
             (None, [1.0] * 6, "x"), (230, [float("inf")] + [0.0] * 5, "x"), (240, [1.0, 2.0], "x"), (241, [1.0, 2.5], "x"), (250, [0.0] * 6, "x")]
    got = vector_search.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, query_block=blocks[0], vector_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == brute_nearest(rows, 10)


def test_nearest_of_nothing(spark):
    assert vector_search.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0], "x")], VECTORS)
    assert vector_search.nearest(one, F.col("vec_id") % 10 == 0).collect() == []
