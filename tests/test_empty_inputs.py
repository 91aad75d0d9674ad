"""Operators must accept empty inputs (an empty landing run or micro-batch)."""
from pyspark.sql import functions as F

from newsloom.operators import dedup, loader, metrics, ranking, vectors
from newsloom.operators.filters import enrich_for_analysis


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.greedy_dedup(docs, "doc_id", "text").count() == 0
    assert dedup.near_duplicate_pairs(docs, "doc_id", "text").count() == 0
    vecs = spark.createDataFrame([], "id long, vec array<float>, label int, ts timestamp")
    assert vectors.semantic_highlights(vecs, 5, 0.5, "label").count() == 0
    assert vectors.window_nearest(vecs).count() == 0
    assert vectors.topk_nearest(vecs, 3).count() == 0
    batch = spark.createDataFrame([], "id long, url string, vec array<float>, seq timestamp")
    hist = spark.createDataFrame([], "id long, url string, vec array<float>, inserted_at timestamp")
    assert loader.incremental_load(batch, hist, "2024-01-01 00:00:00").count() == 0
    assert ranking.sequential_ids(docs, [F.col("doc_id")]).count() == 0
    news = spark.createDataFrame([], "id long, source string, category string, sentiment string, published_ts timestamp")
    row = metrics.sentiment_kpis(enrich_for_analysis(news)).first()
    assert row.total == 0 and row.sentiment_score == 0.0
