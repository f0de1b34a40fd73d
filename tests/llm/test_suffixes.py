import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, suffixes


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(df, length, **more):
    got = suffixes.remove_repeats(df, length, **more).withColumn("kept", F.sha2("kept", 256))
    return sorted(map(tuple, got.collect()), key=str)


def random_rows(rng, n, length, passages):
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(length // 2, 3 * length))) for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choices("abcdé ", k=rng.randint(0, 2 * length))))
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.randint(0, len(p) // 3)
                parts.append(p[a : len(p) - rng.randint(0, len(p) // 3)])
        rows.append((rng.randint(1, n), "".join(parts)))
    return rows


@pytest.mark.parametrize("length,gram,block", [(40, 8, 4), (64, 32, 16), (7, 3, 16), (50, 50, 8), (1, 32, 16)])
def test_matches_brute_force(spark, length, gram, block):
    rng = random.Random(length)
    rows = random_rows(rng, 40, length, 5)
    rows += [(100, "ab" * (3 * length)), (101, "x" * (2 * length)), (102, "x" * (length + 1)), (103, "xyz" * length)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(df, length, gram=gram, block=block) == brute(rows, length)


def test_chunks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(suffixes, "CHUNK", 128)
    rows = random_rows(rng, 20, 60, 4) + [(50, "".join(rng.choices("ab", k=3000)) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(df, 60) == brute(rows, 60)


def test_edge_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    rows = [(1, None), (2, ""), (3, "short"), (None, text), (4, text[:450]), (4, text[:450]), (5, "é" * 300), (6, "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("x")).withColumn("n", F.lit(1))
    assert report(df, 400) == brute(rows, 400)


def test_empty_table(spark):
    assert report(spark.createDataFrame([], "doc_id long, text string"), 400) == []


def test_query_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    rows = catalog.queries()["op9_suffix_dedup"](spark, sf_small).collect()
    got = sorted((tuple(r)[:5] for r in rows), key=str)
    assert got == brute(docs, 400) and any(r[2] for r in got)
    originals = {r.doc_id: r.text for r in docs}
    assert all(r.text == originals[r.doc_id] for r in rows if not r.n_removed)
    assert all(len(r.text.replace("\ufffd", "").encode()) <= r.n_bytes - r.n_removed for r in rows)


def test_hot_groups_are_dealt_and_copies_counted_once(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "PIECES", 4)
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=300))
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, text) for i in range(40)] + [(None, text)] * 20 + [(7, text), (7, text)]
    rows += [(100 + i, "".join(rng.choices("xyz", k=50)) + passage + "".join(rng.choices("uvw", k=50))) for i in range(40)]
    rows += [(200, text[:150] + "".join(rng.choices("xyz", k=80))), (201, "".join(rng.choices("xyz", k=80)) + text[200:]), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert report(df, 60) == brute(rows, 60)


def test_dealt_join(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "PIECES", 8)
    rows = spark.createDataFrame([(1, i) for i in range(80)] + [(None, 1), (2, 1), (3, 2), (3, 4)], "k int, v int")
    classes = spark.createDataFrame([(1, 80, "a"), (3, 2, "b"), (9, 5, "c")], "k int, n int, c string")
    got = common.dealt_join(rows, classes, ["k"], "n", ["v"], 84).collect()
    assert sorted((r.k, r.v, r.c) for r in got) == sorted([(1, i, "a") for i in range(80)] + [(3, 2, "b"), (3, 4, "b")])
    left = common.dealt_join(rows, classes, ["k"], "n", ["v"], 84, "left").collect()
    assert len(left) == 84 and sum(r.c is None for r in left) == 2
