import datetime as dt

import numpy as np
import pandas as pd
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from newsloom.plans import vectorq
from newsloom.operators import enrich, loader, vectors
from tests.conftest import SF01

EPOCH = dt.datetime(2024, 1, 1)


def load_np():
    t = pq.read_table(f"{SF01}/embeddings.parquet").to_pydict()
    ids = np.array(t["vec_id"], dtype=np.int64)
    m = np.array(t["embedding"], dtype=np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ts = [EPOCH + dt.timedelta(minutes=int(i) * 37) for i in ids]
    return ids, m, np.array(t["label"]), ts


def test_highlights_match_newest_first_walk(spark):
    ids, m, labels, ts = load_np()
    expected = set()
    for g in set(labels.tolist()):
        idx = [i for i in np.argsort(-ids) if labels[i] == g]  # ts grows with id: newest first
        chosen = []
        for i in idx:
            if all(float(m[i] @ m[j]) <= vectorq.THRESHOLD for j in chosen):
                chosen.append(i)
            if len(chosen) == 5:
                break
        expected |= {(int(g), int(ids[i])) for i in chosen}
    got = {(r.label, r.id) for r in vectorq.d12_semantic_highlights(spark, SF01).collect()}
    assert got == expected


def test_incremental_load_matches_sequential_loader(spark):
    ids, m, _, ts = load_np()
    now = dt.datetime.fromisoformat(vectorq.NOW_LOAD)
    pos = {int(i): k for k, i in enumerate(ids)}
    history = [int(i) for i, t in zip(ids, ts) if t < now + dt.timedelta(hours=24)]
    batch = sorted((int(i) for i, t in zip(ids, ts) if t >= now), key=lambda i: (ts[pos[i]], i))
    table_urls = {i: ts[pos[i]] for i in history}           # url key = vec id; inserted_at = ts
    inserted_now = []
    expected = {}
    for i in batch:
        if i in table_urls or i in expected:
            expected[i + 1_000_000] = "url_duplicate"
            continue
        recent = [h for h, at in table_urls.items() if at > now - dt.timedelta(hours=48)] + inserted_now
        sims = [float(m[pos[i]] @ m[pos[h]]) for h in recent]
        if sims and max(sims) >= vectorq.THRESHOLD:
            hist_hit = any(float(m[pos[i]] @ m[pos[h]]) >= vectorq.THRESHOLD for h in recent if h not in inserted_now)
            expected[i + 1_000_000] = "semantic_history" if hist_hit else "semantic_batch"
            continue
        inserted_now.append(i)
        expected[i + 1_000_000] = "inserted"
    got = {r.id: r.decision for r in vectorq.d13_incremental_semantic_dedup(spark, SF01).collect()}
    assert got == expected
    ins = sorted(r.new_id for r in vectorq.d13_incremental_semantic_dedup(spark, SF01).collect() if r.new_id)
    assert ins == list(range(max(history) + 1, max(history) + 1 + len(inserted_now)))


def test_ivf_recall_against_exact(spark):
    for folder in (SF01, SF01.replace("sf0.01", "sf0.1")):
        exact = {(r.q, r.c) for r in vectorq.d10_topk_nearest_vectors(spark, folder).collect()}
        approx = {(r.q, r.c) for r in vectorq.d11_ivf_approximate_topk(spark, folder).collect()}
        assert all(q != c for q, c in approx)
        recall = len(exact & approx) / len(exact)
        assert recall >= 0.9, (folder, recall)
    # every returned pair is a real pair with its exact similarity
    ids, m, _, _ = load_np()
    pos = {int(i): k for k, i in enumerate(ids)}
    for r in vectorq.d11_ivf_approximate_topk(spark, SF01).limit(50).collect():
        assert abs(float(m[pos[r.q]] @ m[pos[r.c]]) - r.sim) < 1e-5


def test_query_set_search_is_exact(spark):
    ids, m, _, _ = load_np()
    v = vectorq.vecs(spark, SF01)
    got = {}
    for r in vectors.topk_of_queries(v.filter("id % 50 = 3"), v, k=4, block_rows=64).collect():
        got.setdefault(r.q, []).append((r.rank, r.c))
    for q in [i for i in ids if i % 50 == 3]:
        sims = m @ m[list(ids).index(q)]
        best = sorted(((-s, int(i)) for s, i in zip(sims, ids) if i != q))[:4]
        assert [c for _, c in sorted(got[int(q)])] == [i for _, i in best]


def test_cosine_expression_nulls(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vectors.cosine("a", "b").alias("c")).collect()]
    assert got[0] == 1.0 and got[1] is None


def test_streaming_semantic_dedup_matches_daily_loader_walk(spark):
    from newsloom.plans import streamq
    from tests.conftest import SF001
    t = pq.read_table(f"{SF001}/embeddings.parquet").to_pydict()
    ids = np.array(t["vec_id"], dtype=np.int64)
    m = np.array(t["embedding"], dtype=np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    pos = {int(i): k for k, i in enumerate(ids)}
    ts = {int(i): EPOCH + dt.timedelta(minutes=int(i) * 37) for i in ids}
    days = {}
    for i in ids:
        days.setdefault(ts[int(i)].date(), []).append(int(i))
    history = {}          # id -> inserted_at
    expected = {}
    for day in sorted(days):
        batch = sorted(days[day], key=lambda i: (ts[i], i))
        now = max(ts[i] for i in batch).replace(microsecond=0)
        recent = [h for h, at in history.items() if at > now - dt.timedelta(hours=48)]
        accepted = []
        for i in batch:
            hist_hit = any(float(m[pos[i]] @ m[pos[h]]) >= vectorq.THRESHOLD for h in recent)
            batch_hit = any(float(m[pos[i]] @ m[pos[a]]) >= vectorq.THRESHOLD for a in accepted)
            if hist_hit:
                expected[i] = "semantic_history"
            elif batch_hit:
                expected[i] = "semantic_batch"
            else:
                expected[i] = "inserted"
                accepted.append(i)
        for a in accepted:
            history[a] = ts[a]
    got = {r.id: r.decision for r in streamq.j4_stream_semantic_dedup(spark, SF001).collect()}
    assert got == expected


def test_ivf_block_size_does_not_change_result(spark):
    v = vectorq.vecs(spark, SF01)
    big = {(r.q, r.c, round(r.sim, 9)) for r in vectors.ivf_topk(v, 5, 16, 4).collect()}
    small = {(r.q, r.c, round(r.sim, 9)) for r in vectors.ivf_topk(v, 5, 16, 4, block_rows=16).collect()}
    assert big == small


def test_rows_travel_once_per_large_block():
    """A row's copies are bounded by the rows over ``TILE_ROWS``, not over the (small) block that is asked for."""
    assert [vectors._tiles(n, 256) for n in (0, 1, 300, 10_000, 615_000)] == [1, 1, 2, vectors.TILES, 76]


def test_chunked_kernels_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (90, 4)).astype("float32")   # equal and zero vectors are among them
    monkeypatch.setattr(vectors, "CHUNK", 200)
    monkeypatch.setattr(vectors, "PROBED", 16)
    ids = rng.permutation(90).astype("int64")
    n, ok = vectors._matrix(pd.Series(list(m)))
    got = vectors._best_of(n[:50], ok[:50], ids[:50], n, ok, ids, 4)
    sims = (n @ n.T).round(vectors.SIM_DIGITS)
    want = []
    for q in np.flatnonzero(ok[:50]):
        near = sorted((-sims[q, c], ids[c]) for c in np.flatnonzero(ok) if c != q)[:4]
        want += [(ids[q], c) for _, c in near]
    assert list(zip(got.q, got.c)) == want
    pairs = {(r, c) for rows, cols, _ in vectors._similar(n, ok, n, ok, 0.5, True) for r, c in zip(rows, cols)}
    full = n @ n.T
    assert pairs == {(r, c) for r in range(90) for c in range(90) if ok[r] and ok[c] and full[r, c] > 0.5}


def test_walk_by_stretches_equals_the_walk(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((150, 3)).astype("float32")
    m[::10] = 0
    rows = [(i + 1, v.tolist() if i % 17 else None) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "_ord long, vec array<float>")
    kept = []
    for o, v in rows:
        x = np.array(v or [0.0] * 3)
        if not any(x.any() and np.any(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9 for _, y in kept):
            kept.append((o, x))
    got = sorted(r._ord for r in loader.first_of_similar(df, 0.9, block_rows=16, first_stretch=20).collect())
    assert got == [o for o, _ in kept]
    assert loader.first_of_similar(df.limit(0), 0.9).count() == 0


def test_highlights_embed_only_rows_they_reach(spark):
    rows = [(i, "g", f"t{i}" if i < 380 else "same", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, title string, ts timestamp").withColumn("summary", F.lit(""))
    seen = []

    def embed(part):
        seen.append(part.count())
        return enrich.embed_articles(part, out="vec")

    args = dict(n=5, threshold=0.85, group_col="g", id_col="id", vec_col="vec", ts_col="ts")
    got = sorted(map(tuple, vectors.semantic_highlights(df, embed=embed, **args).collect()))
    assert got == sorted(map(tuple, vectors.semantic_highlights(enrich.embed_articles(df, out="vec"), **args).collect()))
    assert [r[1] for r in got] == [376, 377, 378, 379, 399] and sum(seen) == 20 + 80


def test_a_query_meets_a_tile_of_cells_once():
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 4))
    cells = rng.integers(0, 6, 40)
    rows = [(0, i, m[i], np.array([0, 2, 5] if i % 2 else [1]), 0) for i in range(20)]
    rows += [(0, i, m[i], np.array([cells[i - 20]]), 1) for i in range(20, 60)]
    got = vectors._probed_topk(3)(pd.DataFrame(rows, columns=["tile", "id", "vec", "cells", "_side"]))
    n, _ = vectors._matrix(pd.Series(list(m)))
    want = set()
    for i in range(20):
        near = [c for c in range(20, 60) if cells[c - 20] in ((0, 2, 5) if i % 2 else (1,))]
        want |= {(i, c) for c in sorted(near, key=lambda c: -(n[i] @ n[c]))[:3]}
    assert set(zip(got.q, got.c)) == want
