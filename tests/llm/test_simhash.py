import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def brute_fp(text, k=4):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def cluster(rng, centres, members, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.append(c)
        for _ in range(members):
            x = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    for n in [0, 1, 3, 4, 5, 50]:
        text = " ".join("".join(rng.choices("aBcÉ中", k=3)) for _ in range(n))
        assert simhash.text_fingerprint(text.encode(), 4) == brute_fp(text)
    assert simhash.text_fingerprint(None, 4) == 0
    assert simhash.text_fingerprint(" ".encode(), 4) == brute_fp(" ") != 0


def test_segments_leave_one_bit():
    for bits in range(1, 9):
        parts = simhash.segments(bits)
        assert sum(w for _, w in parts) == 64
        assert bits // len(parts) <= 1


@pytest.mark.parametrize("hot", [4096, 6])
def test_links_span_brute_force(spark, hot):
    rng = random.Random(hot)
    fps = cluster(rng, 30, 25, 6) + [rng.getrandbits(64) for _ in range(200)]
    fps = sorted(set(fps) | {0, 2**64 - 1, 2**63})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 4, hot).collect()]
    assert all(0 < bin(a ^ b).count("1") <= 4 for a, b in got)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(at[a])] = find(at[b])
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want))


def test_near_duplicates_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (5, "the quick brown fox jumps over it", "x"),
        (3, "The QUICK brown\tfox jumps over it", "y"),
        (3, "other words that are not the same", "y"),
        (9, None, None),
        (8, "", "z"),
        (7, " \n ", "z"),
        (None, "other words that are not the same", None),
        (None, "a null id on its own here", None),
        (11, long, "v"),
        (12, long, "v"),
        (12, long, "v"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("key", F.lit(1))
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    comps = brute_components(ids, fps)
    assert got == sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, comps)), key=str)


def test_keep_one(spark):
    rows = [(5, "a b c d e f", 1), (3, "A b c d e f", 2), (3, "A b c d e f", 1), (4, "", 0), (9, None, 0), (8, "q r s t u", 7), (8, "1 2 3 4 5", 7)]
    rows += [(None, "no id here at all", 1), (None, "no id here at all", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int")
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    want = [(3, "A b c d e f", 1), (4, "", 0), (8, "q r s t u", 7), (8, "1 2 3 4 5", 7), (None, "no id here at all", 1)]
    assert got == sorted(want, key=str)
    assert simhash.keep_one(df.limit(0)).collect() == [] and simhash.keep_one(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_query_matches_brute_force(spark, sf_small):
    from tidemark.llm import catalog

    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in docs], [brute_fp(r.text) for r in docs]
    want = sorted((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps)))
    assert sorted(map(tuple, catalog.queries()["op10_simhash"](spark, sf_small).collect())) == want
