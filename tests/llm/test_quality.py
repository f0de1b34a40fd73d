import random
import re

from pyspark.sql import functions as F

from tidemark.llm import catalog, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, dup, len(covered))


def stats(df):
    out = quality.with_statistics(df).select("doc.doc_id", *quality.BASE).collect()
    return sorted(((r[0], *r[1:]) for r in out), key=str)


def texts():
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n\t \n"), (4, "a b c"), (5, "a b c d"), (6, "a a a a a a"), (6, "a a a a a a"), (7, "x\nx \nx\n\nx")]
    rows += [(8, "é$ ü| <中>\r\n#*%& a\x0bb\x0cc"), (None, "a b c a b c"), (9, "a b c x a b c y b c x a"), (10, "q" * 50_000), (11, "a b c d e f")]
    for n in range(60):
        rows.append((100 + n, "".join(rng.choice(["a ", "b ", "cc\n", "É ", "d# ", " "]) for _ in range(rng.choice([5, 30, 200])))))
    rows.append((200, " ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w5 w6 w7"))
    return rows


def test_statistics_match_brute_force(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("packed", F.lit(1))
    assert stats(df) == sorted(((i, *brute(t)) for i, t in texts()), key=str)


def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        low = i % 4 == 0
        docs.append((i, " ".join(f"w{rng.randrange(3000)}" + ("***" if low else "") for _ in range(rng.randint(60, 120)))))
        if i % 2 == 0:
            labels.append((i, 0 if low else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_keeps_clean_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in quality.quality_report(docs, labels).collect()}
    assert got == {i: i % 4 != 0 for i in range(400)}
    kept = quality.keep_quality(docs.withColumn("kept", F.lit(0)), labels)
    assert kept.columns == ["doc_id", "text", "kept"] and kept.count() == 300


def test_base_and_edge_tables(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "w " * 60), (3, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_report(odd, labels.limit(0)).collect()}
    assert got == {1: (True, False), 2: (True, False), None: (True, False), 3: (False, True)}
    assert quality.quality_report(docs.limit(0), labels).collect() == []
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert quality.quality_report(docs, nulls).where("kept").count() == 400


def test_query_over_the_table(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = catalog.queries()["op8_quality_rules"](spark, sf_small).collect()
    assert sorted((r.doc_id, *r[1:6]) for r in got) == sorted((i, *brute(t)) for i, t in docs.items())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_plan_is_native(spark, sf_small):
    plan = catalog.queries()["op8_quality_rules"](spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_agrees_with_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = catalog.queries()["op8_quality_rules"](spark, d).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) > 0.95 * len(got)
