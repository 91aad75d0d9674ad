import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import ann_index, signatures, vectors

EPOCH = dt.datetime(2024, 1, 1)
SCHEMA = "id long, vec array<float>, ts timestamp"


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], t) for i, v, t in rows], SCHEMA).repartition(partitions)


def clustered(n, dim=24, groups=30, noise=0.25, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim))


def best_earlier(rows, threshold, hours):
    out = {}
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v, _ in rows if v is not None and np.any(v)}
    for i, _, t in rows:
        found = [(-round(float(unit[i] @ unit[j]), 9), j) for j, _, u in rows if i in unit and j in unit
                 and ((u, j) < (t, i)) and u > t - dt.timedelta(hours=hours)]
        if found and -min(found)[0] >= threshold:
            out[i] = min(found)[1]
    return out


def test_bands_reach_the_recall():
    for threshold, recall in ((0.85, 0.9999), (0.85, 0.9), (0.95, 0.99)):
        bands, rows = signatures.choose_bands(threshold, recall)
        agree = 1 - np.arccos(threshold) / np.pi
        assert bands * rows <= signatures.MAX_BITS and 1 - (1 - agree ** rows) ** bands >= recall


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_signed_neighbours_equal_the_exact_ones(spark, block_rows):
    """Copies, a hot vector, null and zero vectors, ties in time; blocks of any size."""
    v = clustered(260)
    rows = [(i, x, EPOCH + dt.timedelta(minutes=40 * i)) for i, x in enumerate(v)]
    rows += [(1000 + i, v[5], EPOCH + dt.timedelta(minutes=30 * (i // 2))) for i in range(90)]
    rows += [(2000, None, EPOCH), (2001, np.zeros(24), EPOCH), (2002, np.zeros(24), EPOCH + dt.timedelta(hours=1))]
    want = best_earlier(rows, 0.85, 48)
    got = signatures.nearest_in_window(frame(spark, rows), 0.85, 48, block_rows=block_rows)
    assert {r.q: r.c for r in got.collect()} == want
    exact = vectors.window_nearest(frame(spark, rows, 2), 48, block_rows=block_rows)
    assert {r.q: r.c for r in exact.collect() if r.sim >= 0.85} == want


def test_recall_at_the_threshold(spark):
    """Pairs right at the threshold, with bands for 0.9: at least that share is found."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        rows += [(2 * i, a, EPOCH + dt.timedelta(days=3 * i)), (2 * i + 1, 0.8501 * a + np.sqrt(1 - 0.8501 ** 2) * b, EPOCH + dt.timedelta(days=3 * i, hours=1))]
    found = signatures.nearest_in_window(frame(spark, rows), 0.85, 48, recall=0.9).count()
    assert found >= 0.9 * 600
    assert signatures.nearest_in_window(frame(spark, rows), 0.85, 48).count() >= 598


def test_unrelated_rows_are_not_compared(spark, monkeypatch):
    """Of unrelated vectors only few meet in a bucket."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(64), EPOCH + dt.timedelta(minutes=i)) for i in range(400)]
    bands, n = signatures.choose_bands(0.85, 0.99)
    keys = frame(spark, rows).select("id", F.posexplode(signatures.band_keys(bands, n)("vec")).alias("b", "h"))
    pairs = keys.groupBy("b", "h").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert pairs < 0.03 * 400 * 399 / 2


def test_empty(spark):
    assert signatures.nearest_in_window(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block_rows, partitions", [(3, 1), (64, 5)])
def test_equal_vectors_tie_by_id(spark, block_rows, partitions):
    base = clustered(12, 8, 4)
    rows = [(10 * i + j, base[i], EPOCH + dt.timedelta(hours=(7 * i + 3 * j) % 40)) for i in range(12) for j in range(6)]
    df = frame(spark, rows[::-1], partitions)
    unit = np.float32(base).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = (unit @ unit.T).round(9)
    ids = [i for i, _, _ in rows]
    want = {(q, c) for q in ids for c in sorted((c for c in ids if c != q), key=lambda c: (-s[q // 10, c // 10], c))[:4]}
    assert {(r.q, r.c) for r in vectors.topk_nearest(df, 4, block_rows=block_rows).collect()} == want
    asked = vectors.topk_of_queries(df.filter("id < 50"), df, 4, block_rows=block_rows)
    assert {(r.q, r.c) for r in asked.collect()} == {(q, c) for q, c in want if q < 50}
    assert {r.q: r.c for r in vectors.window_nearest(df, 48, block_rows=block_rows).collect()} == best_earlier(rows, -1, 48)


def recall(spark, path, df, k=5, **options):
    queries = df.filter("id % 10 = 0")
    exact = {(r.q, r.c) for r in vectors.topk_of_queries(queries, df, k).collect()}
    got = ann_index.search(spark, path, queries, k, **options).collect()
    assert all(r.q != r.c and r.rank <= k for r in got)
    return len(exact & {(r.q, r.c) for r in got}) / len(exact)


def test_stored_index_survives_sessions_and_appends(spark, tmp_path):
    """Built in one session, appended to in a second, searched in a third; recall stays over 0.9 without a new fit."""
    v = clustered(3000, groups=60, noise=0.5)
    rows = [(i, x, EPOCH) for i, x in enumerate(v)] + [(9000, None, EPOCH), (9001, np.zeros(24), EPOCH)]
    path = str(tmp_path / "index")
    first, later = frame(spark, rows[:2000]), frame(spark.newSession(), rows[2000:])
    ann_index.build(first, path)
    assert recall(spark, path, first) >= 0.9
    before = spark.read.parquet(f"{path}/model").collect()
    ann_index.append(later, path)
    assert spark.read.parquet(f"{path}/model").collect() == before
    third = spark.newSession()
    stored = third.read.parquet(f"{path}/rows")
    assert stored.count() == 3000 and stored.select("id").distinct().count() == 3000
    assert recall(third, path, frame(third, rows[:3000])) >= 0.9
    # A small block size spreads a cell over tasks and changes nothing.
    asked = frame(third, rows[:40])
    one, two = (sorted(map(tuple, ann_index.search(third, path, asked, 3, block_rows=b).collect())) for b in (5, 1024))
    assert one == two


def test_search_reads_probed_cells_only(spark, tmp_path):
    df = frame(spark, [(i, x, EPOCH) for i, x in enumerate(clustered(400))])
    path = str(tmp_path / "index")
    ann_index.build(df, path, lists=16)
    plan = ann_index.search(spark, path, df.limit(2), 2, nprobe=1)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(cell" in plan


def test_tiny_and_empty_indexes(spark, tmp_path):
    one = frame(spark, [(1, [1.0, 2.0, 3.0], EPOCH)])
    ann_index.build(one, str(tmp_path / "a"))
    assert ann_index.search(spark, str(tmp_path / "a"), one, 3).collect() == []
    other = frame(spark, [(2, [1.0, 2.0, 3.0], EPOCH), (3, None, EPOCH), (4, [1.0], EPOCH)])
    assert [(r.q, r.c) for r in ann_index.search(spark, str(tmp_path / "a"), other, 3).collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        ann_index.build(frame(spark, [(1, None, EPOCH)]), str(tmp_path / "b"))
