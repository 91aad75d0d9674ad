import itertools
import random

import numpy as np
from newsloom.llm import language_id as L

from .fixtures import documents, empty, messy, rows


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([5, 4, 1])
    scores, t, s = rng.normal(size=(3, 5, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, pairs = L.forward_backward(scores, lengths, t, s)
    want_pairs = np.zeros((k, k))
    for i, n in enumerate(lengths):
        total, g, p = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(s[path[0]] + sum(scores[i, j, y] for j, y in enumerate(path))
                       + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for j, y in enumerate(path):
                g[j, y] += w
            for a, b in zip(path, path[1:]):
                p[a, b] += w
        assert np.allclose(gamma[i, :n], g / total)
        assert not gamma[i, n:].any()
        want_pairs += p / total
    assert np.allclose(pairs, want_pairs)


VOCABULARY = {"en": "the of and house water going thing with from", "de": "der und haus wasser gehen ding mit von ich",
              "fr": "le et maison eau aller chose avec dans je"}


def corpus(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(rng.randint(3, 30))), lang))
    return out


def frame(spark, data):
    filled = [(i, t, lang, *r[3:]) for (i, t, lang), r in zip(data, rows([(i, t) for i, t, _ in data]))]
    from .fixtures import DOC_SCHEMA
    return spark.createDataFrame(filled, DOC_SCHEMA)


def test_held_out_accuracy_and_code_switching(spark):
    data = corpus()
    model = L.train(frame(spark, data))
    assert model.langs == ["de", "en", "fr"]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!!", "fr"), (1003, "the house water " * 3000, "fr"),
           (1004, "der und haus wasser the of and house thing with", None), (None, "le et maison", None), (1005, "x" * 200_000, "en")]
    got = {r.doc_id: r for r in L.predict(frame(spark, data + odd), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in data if i % 1 == 0]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[1003].n_words == 9000 and got[1003].score > 0.99
    assert got[1004].lang_pred in ("en", "de") and 0.3 < got[1004].score < 0.75   # switched half way
    assert got[None].lang_pred == "fr"
    assert got[1005].n_words == 1


def test_labels_source_and_id_are_no_inputs(spark):
    data = corpus()
    model = L.train(frame(spark, data))
    texts = frame(spark, data)
    from pyspark.sql import functions as F
    other = texts.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, L.predict(texts, model).collect())) == sorted(map(key, L.predict(other, model).collect()))


def test_held_out_rows_do_not_train(spark):
    import zlib
    data = corpus(90)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in data]
    assert "zz" in {lang for _, _, lang in changed}
    assert L.train(frame(spark, changed)).langs == ["de", "en", "fr"]


def test_nothing_to_learn_from(spark):
    assert L.train(empty(spark)) is None
    assert L.predict(empty(spark), None).collect() == []
    unlabelled = frame(spark, [(1, "words here", None), (2, None, "en")])
    assert L.train(unlabelled) is None
    assert {r.lang_pred for r in L.predict(messy(spark), None).collect()} == {"und"}
    assert documents(spark, []).count() == 0


def test_segments_of_a_chain_change_nothing(spark, monkeypatch):
    """Messages cross the borders of segments: the same shares as over one chain."""
    model = L.train(frame(spark, corpus()))
    rng = np.random.default_rng(4)
    words = [w for v in VOCABULARY.values() for w in v.split()] + ["zzz"]
    codes = rng.integers(0, len(words), 700)
    offsets = np.array([0, 0, 1, 8, 15, 400, 400, 700])
    table = model.emissions(words)
    whole = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if a == b:
            whole.append(np.zeros(3))
        else:
            gamma, _ = L.forward_backward(table[codes[a:b]][None], np.array([b - a]), model.transitions, model.start)
            whole.append(gamma[0].sum(axis=0))
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(L, "SEGMENT", size)
        assert np.allclose(L._shares(codes, offsets, table, model), whole), size


def test_training_reads_whole_texts_and_is_deterministic(spark):
    """The tail of a long text trains, and rows that share an id give the same model in any order."""
    data = [(i, "same words here " * 400 + f"{lang} tail{lang} end{lang} " * 100, lang) for i, lang in
            [(k, ("en", "de")[k % 2]) for k in range(1, 60)]]
    model = L.train(frame(spark, data))
    assert any("tailen" in f for f in model.index)
    twice = data + [(i, "other text for this id", lang) for i, _, lang in data]
    one, two = L.train(frame(spark, twice).repartition(1)), L.train(frame(spark, twice[::-1]).repartition(5))
    assert one.index == two.index and np.array_equal(one.weights, two.weights)


def test_rows_are_kept_by_their_own_text(spark):
    model = L.train(frame(spark, corpus()))
    rows_ = [(1, "the of house water", "en"), (1, "12 !!", "en"), (None, "le et maison", "fr"), (None, None, "fr")]
    kept = L.keep_known(frame(spark, rows_), model, 0.3)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "le et maison"), (1, "the of house water")]
    assert kept.columns == frame(spark, rows_).columns
    assert L.keep_known(empty(spark), model, 0.3).collect() == []
    assert L.keep_known(frame(spark, rows_), None, 0.3).collect() == []
