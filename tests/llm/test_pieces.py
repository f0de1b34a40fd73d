import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import catalog, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n a", "tab\tx", "don't we'll", "é 中文 😀 ok", "▁x▁▁y", "    four",
    "foo.\nBar baz\nqux.", "<s> </s> <unk> <0x41>", "\x00\x01", "ﬁ Å é", "aaaaaaaaaaaaaaaa", "1234567890", "w " * 3000,
]


def test_encoding_is_the_librarys():
    m = pieces.Transducer(PATH)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abcdeinost  \n.é中", k=40)) for _ in range(1500)]
    texts += ["".join(rng.choices(["the", "tion", "ing", " ", "er", "en", "sch", "que", ".", "\n"], k=30)) for _ in range(500)]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<i4")
        assert ids.tolist() == LIBRARY.encode(t), repr(t)
        assert m.decode(ids) == t.replace("▁", " "), repr(t)


def test_merging_whole_units_agrees_with_the_path():
    m = pieces.Transducer(PATH)
    rng = random.Random(2)
    for _ in range(300):
        unit = "▁" + "".join(rng.choices("abcdehinorst", k=rng.randint(1, 25)))
        assert m.shortest(unit) == m.merged(unit)


def test_unigram_weights_take_the_least_path():
    m = pieces.Transducer(PATH)
    m.kind, m.pieces, m.scores = pieces.UNIGRAM, {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [-1.0, -1.0, -1.5, -1.2, -3.5]
    m.begins = {"a", "b", "ab"}
    assert m.shortest("aba") == ["a", "ba"]
    assert m.shortest("abab") == ["ab", "ab"]


def test_small_caches(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    m = pieces.Transducer(PATH)
    for t in TEXTS:
        assert np.frombuffer(m.encode(t), "<i4").tolist() == LIBRARY.encode(t)


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, " a"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("0", F.lit(1)).withColumn("doc_id2", F.lit("z"))
    got = pieces.decode(pieces.encode(df, PATH), PATH)
    assert got.columns == [*df.columns, "piece_ids", "decoded"]
    for r in got.collect():
        assert r.piece_ids == LIBRARY.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.pieces_report(df.limit(0), PATH).collect() == []


def test_query_matches_the_library(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    ids = spark.createDataFrame([(r.doc_id, LIBRARY.encode(r.text)) for r in docs], "doc_id long, ids array<int>")
    want = ids.select("doc_id", F.size("ids").cast("long"), F.xxhash64("ids"), F.lit(True))
    got = catalog.queries()["op7_sentencepiece"](spark, sf_small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
