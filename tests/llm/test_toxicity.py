import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import catalog, toxicity

BAD = ["grumbuxo", "zwelkfrat", "plomquist"]


def corpus(spark, n=900):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeilnorstu", k=rng.randint(2, 8))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        bad = i % 3 == 0
        if bad:
            for _ in range(8):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_windows_cover_the_whole_text():
    for t in [b"", b"a", b"x" * 1000, b"word " * 999, b"a\nb" * 200]:
        assert b"".join(toxicity.windows(t)) == t.replace(b"\n", b" ")
    assert toxicity.windows(None) == []


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.toxicity_report(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) > 0.9 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_report(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_edge_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "words"), (3, " ".join(BAD) * 20_000)], "doc_id long, text string")
    model = docs.unionAll(odd)
    got = toxicity.toxicity_report(model, labels).collect()
    assert len(got) == 305 and all(r.score is not None for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity.toxicity_report(odd, none).collect())
    assert toxicity.toxicity_report(docs.limit(0), labels).collect() == []


def test_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = catalog.queries()["op2_toxicity"](spark, d).where("held_out").join(labels, "doc_id").collect()
    yes, no = ([r.score for r in got if r.toxic == side] for side in (1, 0))
    assert sum(a > b for a in yes for b in no) > 0.88 * len(yes) * len(no)
    assert sum(s >= 0.7 for s in no) < 0.02 * len(no)


def test_words_of_few_texts_count():
    rng = random.Random(3)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    one, two = (["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(300)] for letters in ("abcdeilnorstu", "fghjkmpqvwxyz"))
    rows = [(False, say(one, 80)) for _ in range(600)] + [(True, say(one, 80) + " " + say(BAD, 4)) for _ in range(400)]
    # a small language: 2% of the toxic texts
    rows += [(False, say(two, 80)) for _ in range(80)] + [(True, say(two, 40) + " bocooxy " + say(two, 40)) for _ in range(8)]
    marks = toxicity.dictionaries([(y, t.encode()) for y, t in rows])[1]
    assert all(w.encode() in marks for w in [*BAD, "bocooxy"])


def test_short_words_count():
    rows = [(False, f"plain words number {i} here") for i in range(200)] + [(True, f"plain zut number {i} here") for i in range(200)]
    assert toxicity.dictionaries([(y, t.encode()) for y, t in rows])[1].endswith(b" zut ")


def test_any_two_classes_give_a_model(spark):
    docs, labels = corpus(spark, 16)
    varied = spark.createDataFrame([(i, f"{'bad' if i % 4 else 'good'}{i} text number{i * 7919} of its own") for i in range(16)], "doc_id long, text string")
    for table in (docs, varied):
        for few in (labels, labels.where("toxic = 0 OR doc_id = 0")):
            ordinary, toxic, _, _, weights, _ = toxicity.learn(table, few)
            assert ordinary and toxic and weights is not None


def test_query_finds_held_out_toxic_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = catalog.queries()["op2_toxicity"](spark, d).where("held_out").join(labels, "doc_id").collect()
    found = [r.predicted for r in got if r.toxic == 1]
    assert sum(found) > 0.5 * len(found)


def test_an_id_with_a_third_of_the_rows_gives_one_text(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(7, f"again {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, 100).collect()
    assert len(sample) == len({r.id for r in sample}) and {r.id for r in sample} <= set(range(60))
