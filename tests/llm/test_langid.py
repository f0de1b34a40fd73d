import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import catalog, langid


def test_windows_hold_the_whole_text():
    for t in [b"", b"a", b"x" * 256, b"y" * 257, bytes(range(1, 256)) * 9]:
        w = langid.text_windows(t)
        assert w.tobytes().rstrip(b"\0") == t and w.shape == (-(-len(t) // 256), 256)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = langid.Net(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, labels = rng.integers(0, 256, (5, 24)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.predict(windows)
        return -np.log(p[np.arange(5), labels]).mean()

    for name, g in net.gradients(windows, labels).items():
        w = net.weights[name]
        for k in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(k, w.shape)
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            down = loss()
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at])), name


def corpus(spark, n=240):
    rng = random.Random(3)
    make = {"xx": "abcde ", "yy": "fghij ", "zz": "klmé "}
    rows = [(i, "".join(rng.choices(make[lang], k=rng.randint(20, 600))) + "q", lang) for i in range(n) for lang in [rng.choice(list(make))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_edge_rows(spark):
    odd = spark.createDataFrame([(1, None, "xx"), (2, "", None), (3, "123 ... _ 45", "yy"), (None, "abc dea ", None), (4, "é" * 30_000, None), (4, "é" * 30_000, None)], "doc_id long, text string, lang string")
    docs = corpus(spark).unionAll(odd).withColumn("score", F.lit("x"))
    got = langid.language_report(docs).collect()
    assert len(got) == 246 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == "und" for r in got) == 3
    right = {(r.doc_id, r.lang) for r in corpus(spark).collect()}
    assert sum((r.doc_id, r.lang_pred) in right for r in got) > 225
    assert langid.language_report(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = catalog.queries()["op5_language_id"](spark, d).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_letters():
    assert all(map(langid.has_letter, ("a", "1 é", "½ ²ª", "中", "٣ب")))
    assert not any(map(langid.has_letter, ("", "12 ½ ² Ⅷ", "٣", "_-", "́")))


def test_every_language_is_learned_and_repeats_are_bounded(spark, monkeypatch):
    """More languages than any list holds, and one id that has a third of the rows."""
    seen = {}
    monkeypatch.setattr(langid.Net, "train", lambda self, windows, labels: seen.update(languages=self.languages, rows=len(labels)))
    rows = [(i, f"text of language number {i % 230}", f"l{i % 230:03}") for i in range(690)] + [(None, "the same text", "l000")] * 345
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    langid.learn(df, sample_rows=2)
    assert len(seen["languages"]) > 200 and seen["rows"] <= 2 * 230
