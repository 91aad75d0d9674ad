"""TF-IDF vectors in stored blocks: packed where the texts are read, met without a shuffle."""
import random

from newsloom.operators import dedup, tfidf


def _rows(seed=3, n=90):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rnd.paretovariate(0.8)) % 150}" for _ in range(rnd.randint(3, 40))]
        rows += [(i, " ".join(words)), (500 + i, " ".join(words + [f"only{i}"]))]
        if i % 9 == 0:
            rows.append((900 + i, rows[-2][1]))   # an exact copy
    return rows + [(2000, None), (2001, ""), (None, "w1 w2 w3")]


def _found(df, **more):
    return {(r.doc_a, r.doc_b, round(r.cosine, 9)) for r in dedup.near_duplicate_pairs(df, threshold=0.7, **more).collect()}


def test_vectors_are_not_shuffled_to_their_pairs(spark):
    df = spark.createDataFrame(_rows(), "id long, text string").repartition(4)
    pairs = dedup.near_duplicate_pairs(df, threshold=0.7, hot_rows=1)   # blocks of 16 documents
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan, plan
    lineage = pairs.rdd.toDebugString().decode()
    assert "Cartesian" in lineage and "Shuffled" not in lineage, lineage
    assert len(pairs.collect()) > 80


def test_a_large_dictionary_is_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), "id long, text string").repartition(3)
    want = _found(df)
    monkeypatch.setattr(tfidf, "BLOCK_DICTIONARY", 10)
    assert len(want) > 80 and _found(df) == want
    monkeypatch.undo()
    monkeypatch.setattr(dedup, "BROADCAST_ODD", 0)
    assert _found(df, hot_rows=1) == want


def test_hashes_that_collide_are_made_anew(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(_rows(), "id long, text string").repartition(3)
    want = _found(df)
    exact = tfidf._hash
    monkeypatch.setattr(tfidf, "_hash", lambda term, seed: F.length(term).cast("long") if seed == 0 else exact(term, seed))
    assert _found(df) == want


def test_a_repeated_id_counts_all_its_texts(spark):
    """Texts of one id are one document: its terms count once in df, and its repeats in tf."""
    once = [(i, f"alpha beta{i % 4} gamma{i % 3} delta{i // 2}") for i in range(20)]
    twice = once + [(3, "beta9 epsilon"), (7, "beta9 epsilon zeta"), (7, "beta9 epsilon zeta")]
    joined = [(i, t + (" beta9 epsilon" if i == 3 else " beta9 epsilon zeta beta9 epsilon zeta" if i == 7 else "")) for i, t in once]
    got = [{(r.id, len(r.tids), round(sum(w * w for w in r.ws), 9)) for r in
            dedup.tfidf_on_distinct(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text", "id").collect()}
           for rows in (twice, joined)]
    assert {x[:2] for x in got[0]} == {x[:2] for x in got[1]} and len(got[0]) == 20


def test_blocks_are_cut_by_documents_and_terms():
    import numpy as np

    class Context:
        partitionId = staticmethod(lambda: 2)

    import pyspark
    kept, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: Context)
    try:
        parts = [{"ids": np.arange(k, k + 5), "sizes": np.array([3, 0, 50, 2, 4]), "tid": np.arange(59) + k, "n": np.arange(59)} for k in (0, 10, 20)]
        for terms, docs in ((1000, 1000), (7, 1000), (1000, 2), (1, 1)):
            blocks = list(tfidf._cut(iter(parts), terms, docs))
            assert np.concatenate([b["ids"] for b, _ in blocks]).tolist() == [*range(5), *range(10, 15), *range(20, 25)]
            assert np.concatenate([b["tid"] for b, _ in blocks]).tolist() == [x + k for k in (0, 10, 20) for x in range(59)]
            assert len({n for _, n in blocks}) == len(blocks)
            for b, _ in blocks:
                assert len(b["ids"]) <= docs and b["sizes"].sum() == len(b["tid"]) and (len(b["tid"]) <= terms or len(b["ids"][b["sizes"] > 0]) == 1)
    finally:
        pyspark.TaskContext.get = kept
