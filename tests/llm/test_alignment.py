import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, catalog

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
VALUES = alignment.byte_values()
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n a", "tab\tx", "don't we'll", "é 中文 😀 ok", "a▁b", "    four", "x \n y", "x\n\n  y", "\nx\n",
    "foo.\nBar baz\nqux.", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01", "ﬁ Å é", "aaaaaaaaaaaaaaaa", "1234567890", "w " * 3000, "a\x1cb c\x85d", "a　b\xa0 c",
    "é ́x", "a ​ b", "क्षि 😀😀é", "x" * 5000, "the end\n", " ▁",
]


def tokens(text):
    """Ids and bytes of the whole text's tokens of both sides, by plain decoding; None where they differ from it."""
    if not text:
        return None
    a = [(i, bytes(VALUES[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def spans(side):
    at, out = 0, []
    for i, data in side:
        out.append((at, at + len(data), i))
        at += len(data)
    return out


def plain(text):
    """(groups, links) by definition: common ends, and overlapping ranges."""
    both = tokens(text)
    if both is None:
        return None
    a, b = map(spans, both)
    ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    groups, before = [], 0
    a_in, b_in = iter(a), iter(b)
    a_next, b_next = next(a_in, None), next(b_in, None)
    for end in ends:
        own = [[], []]
        while a_next and a_next[1] <= end:
            own[0].append(str(a_next[2]))
            a_next = next(a_in, None)
        while b_next and b_next[1] <= end:
            own[1].append(str(b_next[2]))
            b_next = next(b_in, None)
        groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
        before = end
    assert before == len((" " + text).encode())
    if len(a) * len(b) < 10**6:
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
    else:
        links, start = [], 0
        for x in a:
            while b[start][1] <= x[0]:
                start += 1
            k = start
            while k < len(b) and b[k][0] < x[1]:
                links.append((x[2], b[k][2]))
                k += 1
    return groups, links, len(a), len(b)


def brute(rows):
    done = [(doc_id, plain(text)) for doc_id, text in rows]
    count = Counter(link for _, x in done if x for link in x[1])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, x in done:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, a, b = x
        best = sum(count[link] == most[link[1]] for link in links)
        out.append((doc_id, a, b, len(groups), len(links), best, sum(count[link] for link in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_units_give_the_alignment_of_the_whole(monkeypatch):
    aligner = alignment.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert aligner.apart
    rng = random.Random(1)
    words = ["the", "'s", "don't", "12", "!?", "é", "中文", "😀", "́", "क्षि", " ", "  ", "\n", "\n ", "\t", "\x1c", "\x85", "　", "​", "tion", "<s>"]
    texts = TEXTS + ["".join(rng.choices(words, k=25)) for _ in range(800)]
    for t, got in zip(texts, aligner.lines(texts)):
        want = plain(t)
        if want is None:
            assert got is None, repr(t)
        else:
            groups, links, n_groups, a, b = got
            assert groups == ";".join(want[0]) and n_groups == len(want[0]) and (a, b) == want[2:], repr(t)
            packed = alignment.np.frombuffer(links, "<i8").tolist()
            assert Counter(packed) == Counter(x << 32 | y for x, y in want[1])


def test_spans_of_the_libraries_are_the_cuts():
    """Ends found from offsets and proto spans are those of the decoded bytes."""
    aligner = alignment.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    for unit in (" don't", " 中文😀é", " क्षि", "\nfoo", "\n\n x", " 😀😀", " é‍", " a 中 b\n é"):
        data = unit.encode()
        found = aligner.a.encode(unit, add_special_tokens=False)
        ids, ends = aligner.a_spans(unit, data)
        assert ends.tolist() == alignment.np.cumsum([len(aligner.a_bytes[i]) for i in ids.tolist()]).tolist()
        # sure cuts are those of the offsets
        at = alignment.np.cumsum([0, *(len(c.encode()) for c in unit)])
        for k, (_, end) in enumerate(found.offsets):
            assert (k + 1 < len(ids) and found.offsets[k + 1][0] < end) or at[end] == ends[k]
        ids, ends = aligner.b_spans(unit, data)
        assert ends.tolist() == alignment.np.cumsum([len(aligner.b_bytes[i]) for i in ids.tolist()]).tolist()


def test_refined_ends():
    np = alignment.np
    refined = lambda *x: alignment.Aligner.refined(*map(np.array, x)).tolist()
    # two tokens end inside a character: their coarse ends are its end
    assert refined([1, 4, 4, 4, 5], [True, False, False, True, True], [1, 1, 1, 1, 1]) == [1, 2, 3, 4, 5]
    assert refined([3, 3, 4], [False, True, True], [2, 1, 1]) == [2, 3, 4]
    assert refined([9, 9], [True, True], [2, 3]) == [2, 5]


def test_whole_texts_as_units_and_small_caches(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_UNITS", 3)
    aligner = alignment.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    first = [aligner.lines([t])[0] for t in TEXTS]
    aligner.apart = False
    assert [aligner.lines([t])[0] for t in TEXTS] == first


def test_edge_rows(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, " a"), (3, " a"), (99, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("links", F.lit("z")).withColumn("groups", F.lit(None))
    got = alignment.alignment_report(df.repartition(3), A_PATH, B_PATH)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == brute(rows)
    assert alignment.alignment_report(df.limit(0), A_PATH, B_PATH).collect() == []
    plain_rows = alignment.align_tokens(df.where("doc_id = 2"), open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read()).collect()
    assert [r.groups for r in plain_rows] == [";".join(plain("a")[0])]


def test_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "end", "naïve", "12", "foo-bar", "中"], k=rng.randint(0, 40)))) for i in range(300)]
    aligned = alignment.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    got = alignment.with_counts(alignment.stored(aligned, "test")).collect()
    want = {r[0]: r for r in brute(rows)}
    assert {r.doc_id: (r.n_links, r.n_best, r.count_sum) for r in got} == {i: r[4:7] for i, r in want.items()}


def test_query_matches_brute_force(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = catalog.queries()["op13_alignment"](spark, sf_small)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == brute(rows)
