"""The pipeline's stages and their decisions."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from patternweave.llm import quality, runtime

CLASH = "doc_id long, text string, lang string, score double, spans string, rest long, n_lines long, n_chars int"


def test_stages_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = runtime.load(spark, sf_dir, "documents")
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = runtime.materialize(stage(spark, docs, sf_dir), f"test-{k}")
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept.append(out.count())
        before, docs = docs, out
    assert 1000 > kept[0] > kept[1] > kept[2] > kept[3] == kept[4] > 500
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    for r in docs.collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    labels = {r.doc_id: r.quality for r in runtime.load(spark, sf_dir, "labels").collect()}
    first = {r.doc_id for r in pipeline.drop_low_quality(spark, runtime.load(spark, sf_dir, "documents"), sf_dir).collect()}
    assert sum((d in first) == bool(q) for d, q in labels.items()) > 0.97 * len(labels)


def test_stages_on_odd_rows(spark, sf_dir):
    long = "word " * 60
    rows = [(0, long, "en", 0.0, "x", 1, 2, 3), (1, None, None, None, None, None, None, None), (2, "", "en", 1.0, "x", 1, 2, 0), (None, long + "more", "en", 0.5, "x", 1, 2, 3), (3, long + "\nother words here", "en", 0.5, "x", 1, 2, 3), (3, long + "\nother words here", "en", 0.5, "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, CLASH)
    for _, stage in pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf_dir)
            assert out.columns == docs.columns and out.count() <= table.count()
    cut = {r.doc_id: r for r in pipeline.cut_repeated_lines(spark, docs, sf_dir).collect()}
    assert cut[3].text == "other words here" and cut[3].score == 0.5 and cut[3].n_lines == 2
    assert set(cut) == {0, 1, 2, 3, None}
    assert pipeline.tokenize(spark, docs, sf_dir).count() == 6


def test_run_is_registered(spark, sf_dir):
    assert entry.queries()["pipeline"] is pipeline.run
    assert pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < out.count() <= 200
    assert quality.GOOD == 0.3
