"""Toxicity, passages, packing, near duplicates, line templates and the pipeline: held-out accuracy, brute force, edges."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeledger.llm import jaccard_join, line_templates, packing, passages, toxicity
from tapeledger.llm.common import utf8

from .conftest import WORD

SF = "/root/testdata/sf0.01"


# ---- toxicity


def labelled(n, seed):
    pick = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = [pick.choice(["river", "stone", "walks", "green", "été", "house", "slow", "light"]) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(pick.randrange(1, 6) if bad else 0):
            words[pick.randrange(40)] = pick.choice(["Vile!", "rotten", "vermin"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def arrays(texts):
    return toxicity._distinct(*toxicity.features(*utf8(pa.array(texts, pa.string()))))


def test_toxicity_on_held_out_texts():
    texts, toxic = labelled(600, 1)
    rows, found = arrays(texts)
    grades = toxicity.severity_grades(rows, found, toxic)
    assert set(grades) == {0, 1, 2} and ((grades > 0) == (toxic == 1)).all()
    model = toxicity.fit(rows, found, grades, rounds=150)
    assert (np.diff(model.thresholds) >= 0).all() and (model.weights != 0).sum() < 100
    texts, toxic = labelled(400, 2)
    rows, found = arrays(texts)
    above = model.above(np.bincount(rows, model.weights[found], len(texts)))
    assert (np.diff(above, axis=1) <= 0).all()
    assert ((above[:, 0] >= 0.5) == (toxic == 1)).mean() > 0.98
    hard = toxicity.severity_grades(rows, found, toxic)
    assert above.sum(axis=1)[hard == 2].mean() > above.sum(axis=1)[hard == 1].mean() > above.sum(axis=1)[hard == 0].mean()


def test_toxicity_edges(spark, make_docs):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 1, 1), (2, 0, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs([(0, "bad " * 9), (1, "good"), (None, None), (3, ""), (3, "x" * 300_000), (0, "bad " * 9)])
    model = toxicity.train(docs, labels)
    out = toxicity.graded(docs.withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(7)), model)
    assert out.count() == 6 and out.where("severity is null or severity < 0 or toxic <> 7").count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.graded(docs, nothing).where("toxic_probability >= 0.5").count() == 0
    assert toxicity.graded(make_docs([]), toxicity.train(make_docs([]), labels)).collect() == []


# ---- passages


def test_fenwick_chain_equals_brute_force():
    pick = random.Random(4)
    for _ in range(30):
        found = sorted({(pick.randrange(60), pick.randrange(60)) for _ in range(12)})
        k, cost = 4, 0.1
        best = {}
        for a, b in found:
            best[a, b] = max([k, *[k + s - cost * ((a - x) + (b - y)) for (x, y), s in best.items() if x < a and y < b and s > cost * ((a - x) + (b - y))]])
        path = passages.chains(found, k, cost)
        top = max(best.values())
        if path:
            score = k
            for (x, y), (a, b) in itertools.pairwise(path[0]):
                assert x < a and y < b
                score += k - cost * ((a - x) + (b - y))
            assert abs(score - top) < 1e-9
        else:
            assert top == k


def covered(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.ref_id, r.ref_start, r.ref_end))
    return {d: sorted(x) for d, x in got.items()}


def test_passages_exact_and_edited(make_docs, prose):
    p, q, r = prose(1, 60), prose(2, 80), prose(3, 55)
    edited = q[:20] + ["changed"] + q[21:40] + q[42:60] + ["new", "words"] + q[60:]
    texts = [prose(10, 30) + p + prose(11, 30), q, prose(12, 9) + p, edited, prose(13, 40) + p[:45], p + edited, r, prose(14, 70)]
    got = covered(passages.repeated_passages(make_docs([" \n".join(t) for t in texts])))
    assert got[2] == [(9, 69, 0, 30, 90)]
    assert [x[2] for x in got[3]] == [1] and got[3][0][0] == 0 and got[3][0][1] == len(edited)
    assert {x[:3] for x in got[5]} == {(0, 60, 0), (0, 60, 2), (60, 60 + len(edited), 1), (60, 60 + len(edited), 3)}  # every earlier holder
    assert set(got) == {2, 3, 5}


def test_passages_edges(make_docs, prose):
    text = " ".join(prose(1, 70))
    assert covered(passages.repeated_passages(make_docs([]))) == {}
    docs = make_docs([(None, text), (1, text), (1, text), (2, ""), (3, None), (4, text), (5, "same " * 5000), (6, "same " * 5000), (7, "  " + text + "  ")])
    got = covered(passages.repeated_passages(docs.withColumn("pos", F.lit(1)).withColumn("seed", F.lit("s"))))
    assert got[4] == [(0, 70, 1, 0, 70)] and got[7] == [(0, 70, 1, 0, 70)] and 1 not in got and 2 not in got


@pytest.mark.parametrize("heavy", [False, True])
def test_passages_around_gaps_and_of_many_holders(make_docs, prose, monkeypatch, heavy):
    if heavy:  # every seed goes the way of the frequent ones
        monkeypatch.setattr(passages, "HEAVY_COUNT", 0)
        monkeypatch.setattr(passages, "SAMPLE_OF", 1)
    p, q, r = prose(1, 60), prose(2, 60), prose(3, 70)
    texts = {0: p + prose(4, 100) + q, 3: p + prose(5, 100) + q}  # two passages, nothing alike between
    texts |= {1: r[:35] + prose(6, 20), 2: prose(7, 20) + r[35:], 10: prose(8, 20) + r, 20: r + prose(9, 20)}  # pieces come first
    phrase = prose(11, 45)
    texts |= {100 + i: prose(100 + i, 20) + phrase for i in range(9)}  # too short for a passage, and frequent
    texts |= {200: phrase + prose(12, 30), 201: prose(13, 20) + phrase + prose(12, 30)}
    got = covered(passages.repeated_passages(make_docs([(d, " ".join(t)) for d, t in texts.items()])))
    assert got == {3: [(0, 60, 0, 0, 60), (160, 220, 0, 160, 220)], 20: [(0, 70, 10, 20, 90)], 201: [(20, 95, 200, 0, 75)]}


@pytest.mark.parametrize("heavy", [False, True])
def test_passages_whose_seeds_all_have_many_holders(make_docs, prose, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(passages, "HEAVY_COUNT", 0)
        monkeypatch.setattr(passages, "SAMPLE_OF", 1)
    p, texts = prose(1, 75), {}
    for i in range(21):  # pieces too short for a passage come first, so that they are all that seeds and long grams point to
        at = i % 3 * 15
        texts[i] = prose(100 + i, 20) + p[at:at + 45] + prose(200 + i, 20)
    texts |= {500: prose(10, 20) + p + prose(11, 20), 600: prose(14, 30) + p + prose(15, 20), 602: p[20:] + prose(18, 20)}
    got = covered(passages.repeated_passages(make_docs([(d, " ".join(t)) for d, t in texts.items()])))
    assert got == {600: [(30, 105, 500, 20, 95)], 602: [(0, 55, 500, 40, 95)]}


def test_strings_around_crowded_long_grams(prose):
    words = prose(1, 130)
    _, place, _, _, long = passages.seeds_of(*utf8(pa.array([" ".join(words)])))
    found = place[long]
    schema = pa.schema([("text", pa.string()), ("places", pa.list_(pa.struct([("pos", pa.int32())]))),
                        ("spans", pa.list_(pa.struct([("start_word", pa.int64()), ("end_word", pa.int64())])))])
    for spans in ([], [(0, 130)], [(0, 60), (50, 90)]):
        row = {"text": " ".join(words), "places": [{"pos": int(a)} for a in found], "spans": [{"start_word": a, "end_word": b} for a, b in spans]}
        part = pa.RecordBatch.from_pylist([row, {"text": "", "places": [], "spans": []}, row], schema)
        of, keys, pos = passages.crowded_keys(part, 25, 50, True)
        inside = lambda a, b: any(x <= a and b <= y for x, y in ([(0, 90)] if len(spans) == 2 else spans))
        wanted = [a for a in range(81) if not inside(a, a + 50)]
        for i in (0, 2):
            assert pos[of == i].tolist() == wanted
        assert keys[of == 0].tolist() == keys[of == 2].tolist() and len(set(keys)) == len(wanted) and set(of) <= {0, 2}
        assert sorted(set(passages.crowded_keys(part, 25, 50, False)[2])) == list(range(81))


def test_passages_of_rows_that_share_an_id(make_docs, prose):
    p, q = " ".join(prose(1, 60)), " ".join(prose(2, 60))
    docs = make_docs([(0, p), (0, q), (1, "own words " + p), (1, q + " own words"), (1, "own words " + p), (2, p + " " + q), (None, p)])
    got = covered(passages.repeated_passages(docs))
    assert {(2, 62, 0, 0, 60), (0, 60, 0, 0, 60)} == set(got[1]) and len(got[1]) == 2
    assert {(0, 60, 0), (60, 120, 0)} <= {x[:3] for x in got[2]} and 0 not in got


@pytest.mark.parametrize("identity, wanted", [(1.0, 1.0), (0.95, 0.98), (0.9, 0.95), (0.85, 0.9)])
def test_passages_recall_by_identity(make_docs, prose, identity, wanted):
    pick, texts = random.Random(7), []
    for i in range(60):
        p = prose(1000 + i, 60)
        edited = list(p)
        for at in pick.sample(range(60), round(60 * (1 - identity))):
            edited[at] = f"other{pick.randrange(10 ** 6)}"
        texts += [prose(2000 + i, 40) + p + prose(3000 + i, 30), prose(4000 + i, 25) + edited + prose(5000 + i, 35)]
    got = covered(passages.repeated_passages(make_docs([" ".join(t) for t in texts])))
    found = sum(any(x[2] == 2 * i and x[1] - x[0] >= 50 for x in got.get(2 * i + 1, [])) for i in range(60))
    print("identity", identity, "found", found, "of 60")
    assert found >= wanted * 60 and all(d % 2 and x[2] == d - 1 for d, rows in got.items() for x in rows)


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    got = covered(passages.op2_passages(spark, SF))
    n, first, missed = passages.MIN_WORDS, {}, 0
    for doc in sorted(texts):
        words, within = texts[doc], set()
        grams = [hash(tuple(words[i:i + n])) for i in range(len(words) - n + 1)]
        for i, g in enumerate(grams):
            if first.setdefault(g, doc) < doc:
                within.update(range(i, i + n))
        missed += len(within - {w for x in got.get(doc, []) for w in range(x[0], x[1])})
    assert missed == 0
    for doc, rows in got.items():
        for start, end, ref, ref_start, ref_end in rows:
            a, b = texts[doc][start:end], texts[ref][ref_start:ref_end]
            assert ref < doc and len(a) == end - start >= n
            line = [0] * (len(b) + 1)  # longest common subsequence
            if a != b:
                for x in a:
                    diagonal = 0
                    for j, y in enumerate(b):
                        diagonal, line[j + 1] = line[j + 1], diagonal + 1 if x == y else max(line[j + 1], line[j])
                assert line[-1] >= passages.IDENTITY * len(a) * 0.99


# ---- packing


def padded(histogram, limits):
    return sum(c * next(x for x in limits if x >= n) for n, c in histogram)


def test_bucket_limits_are_optimal():
    pick = random.Random(3)
    for buckets in (1, 2, 3, 5):
        for _ in range(40):
            histogram = [(n, pick.randrange(1, 9)) for n in pick.sample(range(40), pick.randrange(1, 9))]
            lengths = sorted(n for n, _ in histogram)
            best = min(padded(histogram, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(buckets, len(lengths)) - 1))
            got = packing.best_limits(histogram, buckets)
            assert len(got) <= buckets and padded(histogram, got) == best
    assert packing.best_limits([], 4) == []


def test_pack_keeps_every_token_within_the_budget(make_docs):
    pick = random.Random(8)
    texts = ["w " * pick.randrange(0, 300) for _ in range(400)] + [None, "", "x " * 1000]
    docs = make_docs(texts).withColumn("bucket", F.lit(9)).unionByName(make_docs([(None, "a b"), (7, "dup"), (7, "dup")]).withColumn("bucket", F.lit(9)))
    out = packing.pack(docs, max_tokens=128, buckets=4, batch_tokens=1024).collect()
    assert sum(r.n_tokens for r in out) == sum(len(WORD.findall(t or "")) for t in texts) + 4
    assert {r.piece for r in out if r.doc_id == 402} == set(range(8))
    batches = {}
    for r in out:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault(r.batch_id, []).append(r)
    assert all(len({r.bucket for r in b}) == 1 and sum(r.bucket_tokens for r in b) <= 1024 for b in batches.values())
    assert packing.pack(make_docs([])).collect() == []


# ---- near duplicates


def brute_classes(texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both and both / len(sets[a] | sets[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in range(len(texts))}


def edited_texts(prose):
    pick, texts = random.Random(6), []
    for s in range(30):
        words = prose(s, pick.randrange(3, 200))
        texts.append(" ".join(words))
        for _ in range(pick.randrange(0, 12 if s else 60)):
            copy = list(words)
            for _ in range(pick.randrange(0, 3)):
                copy[pick.randrange(len(copy))] = f"edit{pick.randrange(99)}"
            texts.append((" \n" if pick.random() < 0.2 else " ").join(copy))
    return texts + ["", None, " \n"]


def test_near_duplicates_equal_brute_force(make_docs, prose):
    texts = edited_texts(prose)
    docs = make_docs(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs.withColumn("node", F.lit("n"))).collect()}
    want = brute_classes(texts)
    assert {d: r.class_id for d, r in got.items()} == want
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def hub_and_copies(n):
    """An original, and copies edited at own places: each reaches 0.8 with the original, hardly any two with each other."""
    pick = random.Random(8)
    hub = [f"w{i}" for i in range(220)]
    texts = [" ".join(hub)]
    for c in range(n):
        words = list(hub)
        for at in pick.sample(range(5, 215, 7), 4):
            words[at] = f"edit{c}x{at}"
        texts.append(" ".join(words))
    return texts


def test_near_duplicates_around_one_original(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 150)
    texts = hub_and_copies(1000)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(make_docs(texts)).collect()}
    assert {r.class_id for r in got.values()} == {0} and got[0].n_links == 1000


def shingle_links(texts):
    """Per text, how many other shingle sets reach 0.8 with its own."""
    sets, number = [], {}
    for t in texts:
        w = WORD.findall(t or "")
        sets.append(frozenset(number.setdefault(tuple(w[i:i + 5]), len(number)) for i in range(max(1, len(w) - 4))) if w else frozenset())
    kinds = list(set(sets))
    count = dict.fromkeys(kinds, 0)
    for a, b in itertools.combinations(kinds, 2):
        both = len(a & b)
        if both and both / (len(a) + len(b) - both) >= 0.8:
            count[a] += 1
            count[b] += 1
    return [count[s] for s in sets]


@pytest.mark.parametrize("block", [40, 512])
def test_link_counts_equal_brute_force(make_docs, prose, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", block)
    texts = hub_and_copies(120) + edited_texts(prose)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == shingle_links(texts)


def test_near_duplicates_edges(make_docs, prose):
    assert jaccard_join.near_duplicates(make_docs([])).collect() == []
    text = " ".join(prose(1, 40))
    docs = make_docs([(None, text), (2, text), (2, text), (2, "other words here"), (None, "alone")])
    rows = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r.class_id or -1, r.class_size) for r in rows) == [(-1, 1), (2, 1), (2, 3), (2, 3), (2, 3)]
    assert sorted((r.doc_id or -1, r.text) for r in jaccard_join.one_of_each(docs).collect()) == [(-1, "alone"), (2, text), (2, "other words here")]


def test_trie_depth_reaches_its_recall():
    d = jaccard_join.shortest_depth(0.8, 0.99, 16, 8)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.99 > 1 - (1 - 0.8 ** (d + 1)) ** 16


# ---- line templates


def test_line_templates(make_docs, prose):
    texts = []
    for i in range(12):
        own = [" ".join(prose(100 * i + j, 20)) for j in range(6)]
        own.insert(2, f"Posted on 2024-01-{i:02d} by user{i} in the forum")
        own.insert(5, "All rights reserved by the publisher")
        if i < 3:
            own.append("Only three documents have this line")
        texts.append("\n".join(own))
    copy = "\n".join(" ".join(prose(9000 + j, 15)) for j in range(4))
    texts += [copy] * 7 + ["All rights reserved by the publisher", "", None, "a b", "\n\n"]
    out = {r.doc_id: r for r in line_templates.drop_templates(make_docs(texts).withColumn("whole", F.lit(3)).withColumn("leaf", F.lit(1))).collect()}
    for i in range(12):
        lines = texts[i].split("\n")
        assert out[i].text == "\n".join(x for x in lines if not x.startswith(("Posted", "All rights"))) and out[i].n_dropped == 2
    assert all(out[i].text == copy and out[i].n_dropped == 0 for i in range(12, 19))  # seven times one text
    assert out[19].whole and (out[20].text, out[21].text, out[22].text, out[23].text) == ("", None, "a b", "\n\n")
    assert out[23].n_lines == 3


def test_recurring_lines_go_however_many_they_are(make_docs, prose):
    """Texts that are mostly boilerplate lose it; near copies keep what is theirs, and the text that has nothing else stays."""
    boiler = [" ".join(prose(50 + j, 30)) for j in range(4)]
    own = [" ".join(prose(400 + i, 4)) for i in range(9)]
    texts = ["\n".join([*boiler, o]) for o in own] + ["\n".join(boiler), boiler[0]]
    out = {r.doc_id: r for r in line_templates.drop_templates(make_docs(texts)).collect()}
    assert [out[i].text for i in range(9)] == own and all(out[i].n_dropped == 4 and not out[i].whole for i in range(9))
    assert all(out[i].text == texts[i] and out[i].whole for i in (9, 10))


def test_short_lines_recur_like_others(make_docs, prose):
    short = ["All rights reserved.", "And ornd.", "Of."]
    own = [" ".join(prose(700 + i, 20)) for i in range(8)]
    texts = ["\n".join([own[i], *short, f"mine {i + 1}x{own[i][:5]} only", f"just{'abcdefgh'[i]}"]) for i in range(8)]
    texts[7] = texts[7].replace("\nOf.", "\nOf")
    out = {r.doc_id: r.text for r in line_templates.drop_templates(make_docs(texts)).collect()}
    for i in range(8):
        gone = {*short, texts[i].split("\n")[4]}  # 'mine <*> only' is one template
        assert out[i].split("\n") == [x for x in texts[i].split("\n") if x not in gone]


def test_line_templates_edges(make_docs):
    assert line_templates.drop_templates(make_docs([])).collect() == []
    line = "the footer of every page here"
    docs = make_docs([(None, f"{line}\n" + "own words come here too and more of them"), (1, f"{line}\n" + "x " * 30), (1, f"{line}\n" + "x " * 30)])
    assert all(line in r.text for r in line_templates.drop_templates(docs).collect())  # repeated rows are one document
    assert all(line not in r.text for r in line_templates.drop_templates(docs, min_docs=2).collect())


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and len(clean - ids) <= 0.01 * len(clean) and len(toxic - ids) >= 0.9 * len(toxic)
    lines = corpus_pipeline.drop_lines(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == docs.count() and lines.where("n_chars <> length(text)").count() == 0
    some = [r.text for r in docs.where("doc_id < 300").orderBy("doc_id").collect()]
    left = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id < 300"), SF)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(brute_classes(some).values()))
    assert corpus_pipeline.mix_sources(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.pack_lengths(spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
