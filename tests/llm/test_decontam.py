import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import catalog, decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    def words(t):
        return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(window, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found |= set() if item is None else {str(item)}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


DOCS = [
    (1, "a b c d e f"),
    (1, "a b c d e f"),
    (2, None),
    (3, ""),
    (4, "x A, b-C!! d\ny É q É q"),
    (None, "b c d e"),
    (5, "q " * 20_000 + "a b c"),
    (6, "short one"),
    (7, "one"),
    (8, "zz a b c zz b c d zz"),
]
ITEMS = [(10, "a b c d"), (9, "A B C"), (9, "short"), (11, None), (12, "..."), (None, "é q"), (13, "b c d"), (13, "b c d")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    got = decontam.contamination_report(docs.withColumn("n_words", F.lit("x")), items.withColumn("doc_id", F.lit(1)), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS, 3)


def test_blocks_give_the_same(spark):
    docs, items = frames(spark)
    one = decontam.find_contamination(docs, items, 3)
    many = decontam.find_contamination(docs, items, 3, block_bytes=6)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)


def test_spans_are_offsets_of_the_original(spark):
    docs, items = frames(spark)
    row = decontam.find_contamination(docs, items, 3).where("doc_id = 4").first()
    text = row.text
    assert [text[s.start : s.end] for s in row.contamination.spans] == ["A, b-C!! d"]
    assert row.contamination.items == ["10", "13", "9"]


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontam.contamination_report(docs.limit(0), items).collect() == []
    clean = decontam.contamination_report(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated for r in clean)


def test_query_matches_sql(spark, sf_small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    want = sorted(con.sql(decontam.ORACLE).fetchall())
    got = sorted(map(tuple, catalog.queries()["op1_decontamination"](spark, sf_small).collect()))
    assert got == want and any(r[5] for r in got)
