import corpus_pipeline
import public_tokenizers
import sentencepiece
import test_decontam
import test_quality
import test_simhash

from tidemark.llm import linechunks, quality
from tidemark.llm.common import read


def brute_quality(spark, sf_dir, rows):
    rules = quality.learn_rules(quality.labelled_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    rates = {r.doc_id: r for r in quality.with_statistics(df).select("doc.doc_id", *quality.FEATURES).collect()}

    def kept(r):
        n, _, _, _, repeat = test_quality.brute(r.text)
        if n < 50 or 100 * repeat > 50 * n:
            return False
        met = lambda rule: all((rates[r.doc_id][f] > at) == greater for f, greater, at in rule.conditions)
        return not any(met(rule) for rule in rules)

    return [r for r in rows if kept(r)]


def brute_lines(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        lines, gone = r.text.split("\n"), set()
        for first, n, chunk in linechunks.chunks(r.text.encode()):
            if chunk in seen:
                gone |= set(range(first, first + n))
            seen.add(chunk)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    return out


def test_run_matches_brute_force(spark, sf_small):
    rows = brute_lines(brute_quality(spark, sf_small, read(spark, sf_small, "documents").collect()))
    components = test_simhash.brute_components([r[0] for r in rows], [test_simhash.brute_fp(r[1]) for r in rows])
    rows = [r for r, c in zip(rows, components) if r[0] == c]
    items = [tuple(r) for r in read(spark, sf_small, "benchmark").select("item_id", "text").collect()]
    hit = {r[0] for r in test_decontam.brute([r[:2] for r in rows], items, 10) if r[5]}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((*r, library.encode(r[1]), r[1]) for r in rows if r[0] not in hit)
    got = corpus_pipeline.run(spark, sf_small)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "decoded"]
    assert sorted(map(tuple, got.collect())) == want and 50 < len(want) < 200


def test_stages_keep_the_columns(spark, sf_small):
    docs = read(spark, sf_small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).schema.names == docs.schema.names


def test_stages_on_empty_and_odd_rows(spark, sf_small):
    docs = read(spark, sf_small, "documents")
    none = docs.limit(0)
    text = " ".join(f"word{i}" for i in range(80))
    odd = spark.createDataFrame([(None, text, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", 0), (2, text, None, None, 1), (2, text, None, None, 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_small).count() == 0
        stage(spark, odd, sf_small).collect()
