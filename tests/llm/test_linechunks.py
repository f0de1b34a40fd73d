import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, linechunks


def brute(rows, min_bytes=linechunks.MIN_BYTES):
    """The first occurrence, in order of doc_id (null first), of each chunk's bytes stays."""
    import xxhash

    def th(t):
        return xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63 else 0)

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, th(rows[k][1]), k))
    seen, out, done = set(), {}, {}
    for k in order:
        i, t = rows[k]
        if (i, t) in done:  # one occurrence
            out[k] = out[done[i, t]]
            continue
        done[i, t] = k
        lines, gone = (t or "").split("\n"), set()
        n = 0
        for first, size, chunk in linechunks.chunks((t or "").encode(), min_bytes=min_bytes):
            if chunk in seen:
                gone |= set(range(first, first + size))
                n += 1
            seen.add(chunk)
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out[k] = (i, 0 if t is None else len(lines), len(gone), n, hashlib.sha256(kept.encode()).hexdigest())
    return sorted(out.values(), key=str)


def many(rng, n):
    shared = [[f"shared {rng.randrange(10**6)} line {'é' * rng.randrange(30)}" for _ in range(rng.randint(3, 12))] for _ in range(6)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += [f"own {rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))]
            if rng.random() < 0.6:
                lines += rng.choice(shared)
        rows.append((rng.choice([i, 7, None]), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_matches_brute_force(spark, min_bytes):
    rows = many(random.Random(min_bytes), 120)
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "one line " * 50), (7, rows[5][1]), (7, rows[5][1]), (504, "long line\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("hash", F.lit(1)).withColumn("row", F.lit("x"))
    out = linechunks.remove_chunks(df, min_bytes=min_bytes).select(
        "doc.doc_id", "n_lines", F.aggregate("removed", F.lit(0), lambda n, r: n + r["n"]), F.size("removed"), F.sha2(F.coalesce("text", F.lit("")), 256)
    )
    want = brute(rows, min_bytes)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("values", [1, 5, 200])
def test_chunks_of_one_digest_are_compared_by_their_bytes(spark, monkeypatch, values):
    def weak(chunk, digest_size):
        class Digest:
            def digest(self):
                return bytes([sum(chunk) % values]) * digest_size

        return Digest()

    rows = many(random.Random(values), 60) + [(900, "a b\nc d\n" * 3), (900, "a b\nc d\n" * 3), (None, "b a\nc d")]
    monkeypatch.setattr(linechunks, "blake2b", weak)
    out = linechunks.chunks_report(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert sorted(set(map(tuple, out.collect())), key=str) == sorted(set(want), key=str)
    assert any(r[2] for r in want)


def test_borders_resist_shifts():
    rng = random.Random(9)
    lines = [f"line {rng.randrange(10**9)}".encode() for _ in range(400)]
    whole = {tuple(lines[a:b]) for a, b in linechunks.cut(lines, 2, 3)}
    moved = [b"new", *lines[:100], b"put in", *lines[100:]]
    again = {tuple(moved[a:b]) for a, b in linechunks.cut(moved, 2, 3)}
    assert len(whole & again) > 0.9 * len(whole)


def test_equal_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    rows = many(random.Random(4), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    class Same:
        xxh64_intdigest = staticmethod(lambda b, seed=0: __import__("xxhash").xxh64_intdigest(b, seed))
        xxh3_64_intdigest = staticmethod(lambda b: 1)

    monkeypatch.setattr(linechunks, "xxhash", Same)
    got = linechunks.chunks_report(df).collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_columns_and_empty_table(spark):
    rows = many(random.Random(1), 20)
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in rows], "doc_id long, text string, lines string, n_chars long")
    out = linechunks.without_chunks(df)
    assert out.schema == df.schema and out.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert linechunks.chunks_report(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, catalog.queries()["op6_line_dedup"](spark, sf_small).collect()), key=str)
    assert got == brute([tuple(r) for r in docs])


def test_planted_passages_go_whole(spark):
    rng = random.Random(11)
    say = lambda kind, words: " ".join([kind, *(f"w{rng.randrange(10**6)}" for _ in range(words))])
    # one long line (also of a script without blanks), two short ones, up to six, and one with a blank line inside
    passages = [[say("planted", 60)], ["植" * 150 + str(rng.random())], ["planted Home", "planted About"], ["planted a", "", "planted b"]]
    passages += [[say("planted", rng.choice([2, 20])) for _ in range(n)] for n in (2, 3, 4, 5, 6)]
    rows, own = [], {}
    for i in range(90):
        head, tail = ([say("own", 8) for _ in range(rng.randint(1, 4))] for _ in range(2))
        rows.append((i, "\n".join([*head, *passages[i % len(passages)], *tail])))
        own[i] = "\n".join([*head, *tail])
    df = spark.createDataFrame([*rows, (100, say("own", 60) + "\nplanted Home"), (101, "planted Home\nonce more")], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in linechunks.without_chunks(df).collect()}
    assert all(got[i] == (text if i < len(passages) else own[i]) for i, text in rows)
    assert got[100].endswith("\nplanted Home") and got[101] == "planted Home\nonce more"


def test_every_line_stays_where_it_occurs_first(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * 9 for _ in range(rng.randint(1, 30)))) for i in range(60)]
    got = {r.doc_id: r.text for r in linechunks.without_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {x for _, t in rows for x in t.split("\n")} <= {x for t in got.values() for x in t.split("\n")}


def test_borders_depend_on_content_alone():
    rng = random.Random(13)
    lines = [f"line {rng.randrange(10**9)}".encode() for _ in range(400)]
    borders = lambda x: {lines.index(x[b - 1]) for _, b in linechunks.cut(x, 2, 3)}
    assert all({b for b in borders(lines) if b > k + 2} == {b for b in borders(lines[k:]) if b > k + 2} for k in range(1, 20))
