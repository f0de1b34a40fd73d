import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import catalog, tokenids

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)

TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\n", "x\ty z", "don't we'll", "é 中文 😀 ok",
    "end<|endoftext|> of <|endoftext|> it", "foo.\nBar baz\nqux.  A b　c  d", "a\x1cb c\x1f d\x85e", "tab\t\tx  \r\n y",
    "1234 56a !?# ...  '", "w " * 5000,
]


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def test_units_give_the_tokenizers_ids():
    e = tokenids.Encoder(PATH)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab'Z1 \n\t.é 中 ", k=30)) for _ in range(2000)]
    for got, t in zip(e.encode(texts), texts):
        assert np.frombuffer(got, e.type).tolist() == plain(t)[:-1], repr(t)


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE_UNITS", 5)
    e = tokenids.Encoder(PATH)
    for part in (TEXTS[:9], TEXTS[5:], TEXTS):
        for got, t in zip(e.encode(part), part):
            assert np.frombuffer(got, e.type).tolist() == plain(t)[:-1]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(kind, n, width):
    ids = np.random.default_rng(n).integers(0, 1 << (8 * width), n).astype(f"<u{width}")
    assert (tokenids.from_planes(tokenids.to_planes(ids, kind), n, width, kind) == ids).all()


def want(rows):
    start, out = 0, []
    for i, t in rows:
        ids = plain(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 7), ("byte", 1 << 16)])
def test_files_round_trip(spark, kind, block):
    rows = [(3 * i, t) for i, t in enumerate(TEXTS)] + [(1000, None)]
    shuffled = random.Random(2).sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("part", F.lit(0))
    got = tokenids.ids_report(df.repartition(4), PATH, block=block, kind=kind).collect()
    assert sorted(map(tuple, got)) == want(rows)


def test_ties_nulls_and_empty(spark):
    rows = [(None, "no id"), (1, "same"), (1, "same"), (1, "other"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tokenids.ids_report(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert sorted(r.ids_crc32 for r in got) == sorted(w[3] for w in want(rows))
    assert tokenids.ids_report(df.limit(0), PATH).collect() == []


def test_query_matches_plain_encoding(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect()
    got = catalog.queries()["op4_token_ids"](spark, sf_small).collect()
    assert sorted(map(tuple, got)) == want([(r.doc_id, r.text) for r in docs])


def test_distinct_units_are_looked_up_once_for_all_texts(monkeypatch):
    e, asked = tokenids.Encoder(PATH), []
    remembered = e.remembered
    monkeypatch.setattr(e, "remembered", lambda units: asked.append(sorted(units)) or remembered(units))
    texts = ["", *["one two two\nthree", "two  two", "two three"] * 300]
    for got, t in zip(e.encode(texts), texts):
        assert np.frombuffer(got, e.type).tolist() == plain(t)[:-1]
    assert asked == [["\none", "\nthree", "\ntwo", "three", "two"]]
    assert e.encode([]) == [] and e.encode([""]) == [b""]


def test_texts_are_gathered_by_bytes(monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc_id": [2 * i, 2 * i + 1], "text": ["a" * 100, "b"]}) for i in range(10)]
    monkeypatch.setattr(tokenids, "GATHERED", 300)
    parts = list(tokenids.gathered(iter(batches)))
    assert [i for ids, _ in parts for i in ids] == list(range(20))
    assert [t for _, texts in parts for t in texts] == ["a" * 100, "b"] * 10
    assert 1 < len(parts) < 10 and list(tokenids.gathered(iter([]))) == []
