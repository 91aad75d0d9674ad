"""Driver tables -> the domain frames the operators work on.

``news_view`` maps ``documents`` (+ ``labels``) onto the 14-column news
schema with one fixed rule that the SQL oracle repeats.  ``event_news``
maps the ``events`` stream onto (ts, key, sentiment) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the adapter rule (shared with the SQL oracle).
NEWS_EPOCH = "2024-01-01 00:00:00"
MINUTES_PER_ID = 37
URL_PREFIX = "https://n.example/"
N_CATEGORIES = 7


def sentiment_from_labels(quality: Column, toxic: Column) -> Column:
    return (F.when(toxic == 1, F.lit("Negative"))
             .when(quality == 1, F.lit("Positive"))
             .otherwise(F.lit("Neutral")))


def minutes_after(epoch: str, minutes: Column) -> Column:
    """``epoch`` plus a bigint number of minutes (whole days and the rest, so neither part overflows an int)."""
    per_day = F.lit(24 * 60).cast("long")
    days, rest = F.floor(minutes / per_day).cast("int"), F.pmod(minutes, per_day).cast("int")
    return F.to_timestamp(F.lit(epoch)) + F.make_dt_interval(days, F.lit(0), rest)


def news_view(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents ⟕ labels -> news rows (id, source, ..., published_ts).

    ``labels`` is keyed by doc_id; the left join is an equi-join that Spark
    plans as broadcast when the label table is small and sort-merge when not.
    """
    d = documents.select("doc_id", "text", "lang", "source")
    lab = labels.select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"),
        F.col("source"),
        F.col("lang").alias("language"),
        F.concat(F.lit("cat"), (F.col("doc_id") % N_CATEGORIES).cast("string")).alias("category"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("summary"),
        F.col("text").alias("full_text"),
        F.concat(F.lit(URL_PREFIX), F.col("doc_id").cast("string")).alias("url"),
        sentiment_from_labels(F.col("quality"), F.col("toxic")).alias("sentiment"),
        minutes_after(NEWS_EPOCH, F.col("doc_id") * MINUTES_PER_ID).alias("published_ts"),
    )


def event_sentiment(event_type: Column) -> Column:
    return (F.when(event_type.isin("purchase", "signup"), F.lit("positive"))
             .when(event_type == "error", F.lit("negative"))
             .otherwise(F.lit("neutral")))


def event_news(events: DataFrame) -> DataFrame:
    """events -> (event_id, ts, user_id, sentiment) with ts as a zoned timestamp."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        event_sentiment(F.col("event_type")).alias("sentiment"),
    )
