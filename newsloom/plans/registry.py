"""Query registry: one Spark callable per operator, with its SQL oracle.

``register(key, sql=...)`` records a function ``(spark, sf_dir) -> DataFrame``
and, when the operator is SQL-expressible, the equivalent DuckDB query over
the driver's tables.  ``__spark_entry__`` exposes both dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


# SQL fragments shared by the oracles.  They state the same adapter rule as
# ``newsloom.operators.adapt`` in DuckDB syntax.
NEWS_CTE = """
news AS (
  SELECT d.doc_id AS id, d.source AS source, d.lang AS language,
         'cat' || CAST(d.doc_id % 7 AS VARCHAR) AS category,
         substr(d.text, 1, 80) AS title, d.text AS summary, d.text AS full_text,
         'https://n.example/' || CAST(d.doc_id AS VARCHAR) AS url,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 AS BIGINT)) AS published_ts
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

VIZ_CTE = NEWS_CTE + """,
local AS (
  SELECT *, timezone('Africa/Cairo', published_ts AT TIME ZONE 'UTC') AS local_ts FROM news
),
viz AS (
  SELECT id, source, language, category, title, summary, url, sentiment, published_ts,
         CAST(local_ts AS DATE) AS date, hour(local_ts) AS hour, dayname(local_ts) AS weekday,
         dayname(local_ts) IN ('Friday', 'Saturday') AS is_weekend, lower(sentiment) AS sentiment_lower
  FROM local
)"""

EVENTS_CTE = """
ev AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM events
)"""
