import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import catalog, rankbpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CONTENT, PATTERN = rankbpe.rank_file(PATH), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding(
    "plain",
    pat_str=PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))},
    special_tokens={},
)
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n a", "tab\tx", "don't we'll I'D", "é 中文 😀 ok", "<|endoftext|>", "    four",
    "x\x1cy \x1f z", "a　b\xa0\xa0c", "nul\x00x", "a​b", "1234567890", "w " * 3000, "aaaa" * 500, "\r\n\r\n  x", "é ́x", "ǅ ² ½ Ⅷ",
]


def test_pieces_give_the_ids_of_the_whole():
    coder = rankbpe.Ranks(CONTENT, PATTERN)
    rng = random.Random(1)
    blanks = ["\x1c", "\x85", "　", "\xa0", " ", "​", "᠎", "\t", "\r\n", " ", "  ", "\n\n"]
    words = ["the", "'s", "'", "don't", "12", "!?", "é", "中文", "́", "²", *blanks]
    for _ in range(1500):
        text = "".join(rng.choices(words, k=30))
        assert coder.encode(text, size=3) == LIBRARY.encode_ordinary(text), repr(text)
        assert "".join(p for p, _ in coder.pieces(text, 3)) == text


def test_long_blank_runs_are_one_match(monkeypatch):
    monkeypatch.setattr(rankbpe.Ranks, "RUN", rankbpe.re.compile(f"[{rankbpe.BLANKS}]{{2,}}"))
    coder = rankbpe.Ranks(CONTENT, PATTERN)
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "7", "'s", " ", "  ", "\n", "\t ", "　"], k=25))
        assert coder.encode(text, size=1) == LIBRARY.encode_ordinary(text), repr(text)


def test_very_long_texts():
    coder = rankbpe.Ranks(CONTENT, PATTERN)
    # the library alone runs out of stack on so many blanks
    for text in ("a" + " " * 1_500_000 + "b", " " * 1_500_000, "x\n" * 200_000, "ab" * 300_000, "中" * 200_000):
        ids = coder.encode(text)
        assert coder.decode(ids) == text.encode()
    words = "some words and 12 more, don't " * 20_000
    assert coder.encode(words) == LIBRARY.encode_ordinary(words)


def test_edge_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, " a"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("0", F.lit(1)).withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(2))
    got = rankbpe.decode(rankbpe.encode(df, CONTENT, PATTERN), CONTENT, PATTERN)
    assert sorted(got.columns) == sorted(df.columns)
    for r in got.collect():
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert rankbpe.ranks_report(df.limit(0), PATH, PATTERN).collect() == []


def test_ids_cut_inside_characters_and_unknown_ids(spark):
    ids = LIBRARY.encode_ordinary("😀")
    df = spark.createDataFrame([(1, ids[:1]), (2, [10**6]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in rankbpe.decode(df, CONTENT, PATTERN).collect()}
    assert bytes(got[1]) == LIBRARY.decode_bytes(ids[:1]) and got[2] is None and bytes(got[3]) == bytes(got[4]) == b""


@pytest.mark.parametrize("extra", [[], [(None, "x"), (5, None), (5, "again"), (5, "again")]])
def test_query_matches_the_library(spark, sf_small, tmp_path, extra):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    if extra:
        docs = docs.unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        sf_small = str(tmp_path)
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = catalog.queries()["op11_rank_bpe"](spark, sf_small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
