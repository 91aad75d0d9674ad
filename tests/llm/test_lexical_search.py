import math
import random
import re
import uuid
from collections import Counter

import pytest
from newsloom.llm import lexical_search as L
from newsloom.session import ensure_checkpoint_dir

from .fixtures import documents, empty, messy

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM_SCHEMA = "item_id long, text string, doc_id long, term string, rank int, score long"


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(L.UPPER, L.LOWER)))


def brute(docs, items, k=10):
    rows = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc, c, n in rows:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in ts if t in c)
            if score > 0:
                scored.append((-score, -1 if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    path = f"{ensure_checkpoint_dir(spark)}/lexical-test-{uuid.uuid4().hex}"
    asked = spark.createDataFrame([(i, t, 9, "x", 1, 2) for i, t in items], ITEM_SCHEMA)
    return sorted([tuple(r) for r in L.search(L.build_index(docs, path), asked, **kw).collect()], key=str)


ITEMS = [(1, "alpha BETA beta"), (2, None), (3, "nothing known"), (4, "word1x1 word5x5 one"), (None, "one two"), (1, "one"),
         (5, "日本語 ß"), (6, "!!!"), (7, "123")]


def test_messy_rows(spark):
    df = messy(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert run(spark, df, ITEMS) == brute(docs, ITEMS)


def test_empty_tables(spark):
    assert run(spark, empty(spark), ITEMS) == []
    assert run(spark, messy(spark), []) == []
    assert run(spark, documents(spark, [(1, None), (2, "..")]), ITEMS) == []


@pytest.mark.parametrize("shard, block", [(40, 500_000), (1000, 25), (10**9, 500_000)])
def test_many_shards_and_blocks(spark, monkeypatch, shard, block):
    """Strata over several shards, several strata in a shard, ties, copies and a hot text."""
    monkeypatch.setattr(L, "SHARD_TERMS", shard)
    monkeypatch.setattr(L, "QUERY_ROWS", block)
    random.seed(3)
    vocabulary = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(vocabulary, k=random.choice([3, 5, 5, 8, 20, 60])))) for i in range(300)]
    rows += [(1000 + i, "the hot text of w1 and w2") for i in range(150)]
    items = [(i, " ".join(random.choices(vocabulary, k=12))) for i in range(25)]
    assert run(spark, documents(spark, rows), items) == brute(rows, items)
    assert run(spark, documents(spark, rows), items, k=3) == brute(rows, items, 3)


def test_a_stratum_below_the_kth_score_is_not_visited():
    """Bounds order the visit and end it; equal bounds are visited."""
    import numpy as np

    sizes = np.array([1, 1, 1, 1])
    scores = np.array([5, 9, 7, 7])
    visited = []

    def score_of(mask):
        visited.extend(np.flatnonzero(mask).tolist())
        return np.flatnonzero(mask), scores[mask]

    docs, found = L.visit_strata(np.array([6, 10, 8, 7]), sizes, 2, score_of)
    assert 0 not in visited and sorted(visited) == [1, 2, 3]
    assert sorted(found.tolist(), reverse=True)[:2] == [9, 7]


def test_index_holds_every_row(spark):
    df = messy(spark)
    path = f"{ensure_checkpoint_dir(spark)}/lexical-test-{uuid.uuid4().hex}"
    index = L.build_index(df, path)
    rows = [terms(r.text) for r in df.collect()]
    held = {r.term: r.n for r in spark.read.parquet(index.path).filter("term IS NOT NULL").selectExpr(
        "term", "size(docs) AS n").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert held == dict(Counter(t for ts in rows for t in set(ts)))
    assert (index.n_docs, index.n_terms) == (sum(map(bool, rows)), sum(map(len, rows)))
