import random

import corpus_pipeline
import pytest
from newsloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id

from .fixtures import DOC_SCHEMA

LANGS = {"en": "the of and house water going thing with from tree river".split(),
         "de": "der und haus wasser gehen ding mit von ich baum fluss".split()}


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(1)

    def text(lang, n):
        return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "s", "er"]) for _ in range(n))

    docs = [(i, text(lang, rng.randint(30, 60)), lang) for i in range(80) for lang in [("en", "de")[i % 2]]]
    item = text("en", 25)
    docs += [(100, docs[0][1], "en"), (101, docs[0][1], "en"), (102, docs[3][1] + " x", "de"), (103, None, "en"), (104, "123 !!!", "de"),
             (105, "", None), (106, text("en", 20) + " " + item + " " + text("en", 20), "en")]
    full = [(i, t, lang, "s", 1, "w", "n", 1, 1, True, "x", "v", 1) for i, t, lang in docs]
    spark.createDataFrame(full, DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = set(range(80)) | set(range(100, 107))
    assert left["language_id"] == whole - {103, 104, 105}
    assert left["exact_dedup"] == left["language_id"] - {0, 100}
    assert left["ngram_jaccard_join"] == left["exact_dedup"] - {102}
    assert left["benchmark_decontamination"] == left["ngram_jaccard_join"] - {106}
    assert left["byte_bpe"] == left["benchmark_decontamination"]
    run = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in run.collect()} == left["byte_bpe"]
    assert run.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_use_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    assert all((language_id, exact_dedup, jaccard_join, decontaminate, byte_bpe))


def _stages(spark, docs, folder, count):
    for _, stage in corpus_pipeline.STAGES[:count]:
        docs = stage(spark, docs, folder)
    return docs


def test_rows_that_share_an_id(spark, folder):
    """Repeated rows, one id on several texts, and null ids: every row is decided by its own text."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    clean, other, third = [r.text for r in docs.filter("doc_id IN (10, 12, 14)").orderBy("doc_id").collect()]
    rows = [(1, clean), (1, clean), (1, other + " " + item + " " + other), (1, "!!!"), (None, third), (None, item + " " + third), (2, clean + " s"), (1, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "w", "n", 1, 1, True, "x", "v", 1) for i, t in rows], DOC_SCHEMA)

    def left(count):
        return sorted([(r.doc_id or 0, r.text) for r in _stages(spark, frame, folder, count).collect()])

    known = [(i or 0, t) for i, t in rows if t and t != "!!!"]
    assert left(1) == sorted(known)
    known.remove((1, clean))
    assert left(2) == sorted(known)
    assert left(3) == sorted(set(known) - {(2, clean + " s")})
    assert left(4) == sorted([(1, clean), (0, third)])


def test_empty_table(spark, folder):
    nothing = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for count in range(1, 6):
        assert _stages(spark, nothing, folder, count).collect() == []
