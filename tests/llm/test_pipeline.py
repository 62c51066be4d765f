import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import quality, toxicity
from edgeloom.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A few odd documents with columns of clashing names; no labels, one item."""
    at = str(tmp_path_factory.mktemp("odd"))
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, f"x {item}"), (None, "no key here"), (6, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "a", 1, True, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h1 string, n_words int, keep boolean, score double")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_odd_documents(spark, odd):
    docs = table(spark, odd, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), odd).collect() == [], name
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        kept[name] = sorted((r.doc_id or 0) for r in out.collect())
    assert kept["toxicity"] == kept["quality"] == [0, 1, 2, 3, 3, 4, 6]  # nothing was learned
    assert kept["near_duplicates"] == [0, 1, 3, 4, 6] and kept["decontamination"] == [0, 1, 2, 3, 3, 6]
    assert sorted((r.doc_id or 0, r.round_trip) for r in corpus_pipeline.run(spark, odd).collect()) == [(0, True), (1, True), (3, True), (6, True)]


def test_whole_table(spark):
    docs = table(spark, DIR, "documents")
    out = corpus_pipeline.run(spark, DIR).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == lib.encode(texts[r.doc_id]) and r.round_trip for r in out)
    assert len({texts[r.doc_id] for r in out}) == len(out)
    labels = table(spark, DIR, "labels")
    bad = {r.doc_id for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()}
    clean = docs.filter(~F.col("doc_id").isin(list(bad)))
    poor = {r.doc_id for r in quality.quality(clean, quality.train(clean, labels)).filter("NOT keep").collect()}
    assert not {r.doc_id for r in out} & (bad | poor)
