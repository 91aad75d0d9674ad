"""Registered dashboard queries: KPIs, charts and facets over the news view."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import metrics
from newsloom.plans.common import viz
from newsloom.plans.registry import VIZ_CTE, register


@register("e1_sentiment_kpis", sql=f"""
WITH {VIZ_CTE}
SELECT count(*) AS total,
       count(*) FILTER (WHERE sentiment_lower = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment_lower = 'negative') AS negative,
       count(*) - count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative') AS neutral,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_lower = 'positive') / nullif(count(*), 0), 0), 6) AS pos_rate,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_lower = 'negative') / nullif(count(*), 0), 0), 6) AS neg_rate,
       round(coalesce(100.0 * (count(*) - count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative')) / nullif(count(*), 0), 0), 6) AS neu_rate,
       round(coalesce(100.0 * (count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative')) / nullif(count(*), 0), 0), 6) AS sentiment_score
FROM viz
""")
def e1_sentiment_kpis(spark, sf):
    return metrics.sentiment_kpis(viz(spark, sf))


@register("e2_distinct_counts", sql=f"""
WITH {VIZ_CTE}
SELECT count(DISTINCT source) AS n_sources, count(DISTINCT category) AS n_categories FROM viz
""")
def e2_distinct_counts(spark, sf):
    return metrics.distinct_counts(viz(spark, sf))


@register("e3_daily_volume", sql=f"""
WITH {VIZ_CTE}
SELECT date, count(*) AS count FROM viz WHERE date IS NOT NULL GROUP BY date
""")
def e3_daily_volume(spark, sf):
    return metrics.daily_volume(viz(spark, sf))


@register("e4_daily_sentiment_score", sql=f"""
WITH {VIZ_CTE}
SELECT date, count(*) AS count,
       round((count(*) FILTER (WHERE sentiment_lower = 'positive')
              - count(*) FILTER (WHERE sentiment_lower = 'negative')) * 100.0 / count(*), 6) AS sentiment_score
FROM viz WHERE date IS NOT NULL GROUP BY date
""")
def e4_daily_sentiment_score(spark, sf):
    return metrics.daily_timeline(viz(spark, sf))


@register("e5_sentiment_share", sql=f"""
WITH {VIZ_CTE}, c AS (SELECT sentiment_lower, count(*) AS count FROM viz GROUP BY sentiment_lower)
SELECT sentiment_lower, count, round(count * 1.0 / sum(count) OVER (), 6) AS share FROM c
""")
def e5_sentiment_share(spark, sf):
    return metrics.sentiment_share(viz(spark, sf))


@register("e6_category_sentiment_crosstab", sql=f"""
WITH {VIZ_CTE}
SELECT category,
       count(*) FILTER (WHERE sentiment_lower = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment_lower = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment_lower = 'negative') AS negative
FROM viz GROUP BY category
""")
def e6_category_sentiment_crosstab(spark, sf):
    return metrics.category_sentiment_crosstab(viz(spark, sf))


@register("e7_hourly_score", sql=f"""
WITH {VIZ_CTE}
SELECT hour, count(*) AS count,
       round((count(*) FILTER (WHERE sentiment_lower = 'positive')
              - count(*) FILTER (WHERE sentiment_lower = 'negative')) * 1.0 / count(*), 6) AS score
FROM viz WHERE hour IS NOT NULL GROUP BY hour
""")
def e7_hourly_score(spark, sf):
    return metrics.hourly_score(viz(spark, sf))


@register("e8_mean_source_score", sql=f"""
WITH {VIZ_CTE}, s AS (
  SELECT source, (count(*) FILTER (WHERE sentiment_lower = 'positive')
                  - count(*) FILTER (WHERE sentiment_lower = 'negative')) * 100.0 / count(*) AS score
  FROM viz WHERE source IS NOT NULL GROUP BY source)
SELECT round(coalesce(avg(score), 0), 6) AS avg_source_score, count(*) AS n_sources FROM s
""")
def e8_mean_source_score(spark, sf):
    return metrics.mean_source_score(viz(spark, sf))


@register("e9_sentiment_extremes", sql=f"""
WITH {VIZ_CTE}, d AS (
  SELECT date, count(*) FILTER (WHERE sentiment_lower = 'positive') AS p,
         count(*) FILTER (WHERE sentiment_lower = 'negative') AS n
  FROM viz WHERE date IS NOT NULL GROUP BY date)
SELECT CASE WHEN max(p) > 0 THEN arg_max(date, (p, -(date - DATE '1970-01-01'))) END AS most_positive_date,
       coalesce(max(p), 0) AS most_positive_count,
       CASE WHEN max(n) > 0 THEN arg_max(date, (n, -(date - DATE '1970-01-01'))) END AS most_negative_date,
       coalesce(max(n), 0) AS most_negative_count
FROM d
""")
def e9_sentiment_extremes(spark, sf):
    return metrics.sentiment_extremes(viz(spark, sf))


@register("e10_top_category_trend", sql=f"""
WITH {VIZ_CTE},
top AS (SELECT category FROM viz WHERE category IS NOT NULL GROUP BY category
        ORDER BY count(*) DESC, category ASC LIMIT 5)
SELECT date, category, count(*) AS count FROM viz
WHERE category IN (SELECT category FROM top) AND date IS NOT NULL GROUP BY date, category
""")
def e10_top_category_trend(spark, sf):
    return metrics.top_category_trend(viz(spark, sf), 5)


@register("e11_top_sources", sql=f"""
WITH {VIZ_CTE}, c AS (SELECT source, count(*) AS count FROM viz WHERE source IS NOT NULL GROUP BY source)
SELECT source, count, row_number() OVER (ORDER BY count DESC, source ASC) AS rank
FROM c ORDER BY count DESC, source ASC LIMIT 10
""")
def e11_top_sources(spark, sf):
    return metrics.top_values(viz(spark, sf), "source", 10)


@register("e12_top_categories", sql=f"""
WITH {VIZ_CTE}, c AS (SELECT category, count(*) AS count FROM viz WHERE category IS NOT NULL GROUP BY category)
SELECT category, count, row_number() OVER (ORDER BY count DESC, category ASC) AS rank
FROM c ORDER BY count DESC, category ASC LIMIT 10
""")
def e12_top_categories(spark, sf):
    return metrics.top_values(viz(spark, sf), "category", 10)


@register("e13_weekday_counts", sql=f"""
WITH {VIZ_CTE},
dim AS (SELECT * FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'),
                              (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) t(day_no, weekday)),
c AS (SELECT weekday, count(*) AS count FROM viz GROUP BY weekday)
SELECT dim.day_no, dim.weekday, coalesce(c.count, 0) AS count FROM dim LEFT JOIN c ON dim.weekday = c.weekday
""")
def e13_weekday_counts(spark, sf):
    return metrics.weekday_counts(viz(spark, sf))


@register("e14_weekend_split", sql=f"""
WITH {VIZ_CTE}
SELECT CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS kind, count(*) AS count
FROM viz WHERE weekday IS NOT NULL GROUP BY 1
""")
def e14_weekend_split(spark, sf):
    return metrics.weekend_split(viz(spark, sf))


@register("e15_dimension_values", sql=f"""
WITH {VIZ_CTE}
SELECT DISTINCT 'source' AS dimension, source AS value FROM viz WHERE source IS NOT NULL
UNION ALL SELECT DISTINCT 'category', category FROM viz WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT 'language', language FROM viz WHERE language IS NOT NULL
""")
def e15_dimension_values(spark, sf):
    return metrics.dimension_values(viz(spark, sf))


def flagship(spark, sf):
    """Daily volume and sentiment score on the news view (E3+E4)."""
    return e4_daily_sentiment_score(spark, sf).orderBy(F.col("date"))


def dashboard_panels(news_df, query, highlight_vectors=None) -> dict:
    """SURVEY 3.3: one dashboard request -> every panel as a DataFrame.

    The fetched frame is bounded by ``query.limit`` (a top-k after all
    filters); it is persisted once because a dozen panels read it.
    """
    from newsloom.operators import filters as FL
    from newsloom.operators import ngrams

    fetched = query.fetch(news_df).persist()
    viz_df = FL.enrich_for_analysis(fetched)
    panels = {
        "kpis": metrics.sentiment_kpis(viz_df),
        "distinct": metrics.distinct_counts(viz_df),
        "timeline": metrics.daily_timeline(viz_df),
        "share": metrics.sentiment_share(viz_df),
        "top_sources": metrics.top_values(viz_df, "source", 10),
        "top_categories": metrics.top_values(viz_df, "category", 10),
        "heatmap": metrics.category_sentiment_crosstab(viz_df),
        "hourly": metrics.hourly_score(viz_df),
        "category_trend": metrics.top_category_trend(viz_df, 5),
        "weekdays": metrics.weekday_counts(viz_df),
        "weekend": metrics.weekend_split(viz_df),
        "source_score": metrics.mean_source_score(viz_df),
        "extremes": metrics.sentiment_extremes(viz_df),
        "keywords": ngrams.top_keywords(fetched, "title", 15),
        "bigrams": ngrams.top_bigrams(fetched, "title", 15),
        "feed": fetched,
    }
    if highlight_vectors is not None:
        from newsloom.operators import vectors
        with_vec = viz_df.join(highlight_vectors, "id", "left")
        panels["highlights"] = vectors.semantic_highlights(with_vec, 5, 0.85, "sentiment_lower", "id", "vec",
                                                           "published_ts")
    return panels


@register("s33_dashboard_request_kpis", sql=f"""
WITH {VIZ_CTE},
f AS (SELECT * FROM viz WHERE published_ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY
        AND source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6')
      ORDER BY published_ts DESC NULLS LAST, id LIMIT 200)
SELECT count(*) AS total,
       count(*) FILTER (WHERE sentiment_lower = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment_lower = 'negative') AS negative,
       count(*) - count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative') AS neutral,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_lower = 'positive') / nullif(count(*), 0), 0), 6) AS pos_rate,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_lower = 'negative') / nullif(count(*), 0), 0), 6) AS neg_rate,
       round(coalesce(100.0 * (count(*) - count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative')) / nullif(count(*), 0), 0), 6) AS neu_rate,
       round(coalesce(100.0 * (count(*) FILTER (WHERE sentiment_lower = 'positive')
                - count(*) FILTER (WHERE sentiment_lower = 'negative')) / nullif(count(*), 0), 0), 6) AS sentiment_score
FROM f
""")
def s33_dashboard_request_kpis(spark, sf):
    """The KPIs of one request as the reference computes them: over the fetched rows, so after the limit."""
    from newsloom.plans.common import news
    from newsloom.plans.headlines import HeadlineQuery
    q = HeadlineQuery(now="2024-01-20 00:00:00", days=14, limit=200,
                      filters={"sources": ["src1", "src2", "src3", "src4", "src5", "src6"]})
    return dashboard_panels(news(spark, sf), q)["kpis"]


@register("s33_unlimited_request_kpis", sql=f"""
WITH {VIZ_CTE},
f AS (SELECT * FROM viz WHERE published_ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY
        AND source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6')),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE sentiment_lower = 'positive') AS positive,
             count(*) FILTER (WHERE sentiment_lower = 'negative') AS negative FROM f)
SELECT total, positive, negative, total - positive - negative AS neutral,
       round(coalesce(100.0 * positive / nullif(total, 0), 0), 6) AS pos_rate,
       round(coalesce(100.0 * negative / nullif(total, 0), 0), 6) AS neg_rate,
       round(coalesce(100.0 * (total - positive - negative) / nullif(total, 0), 0), 6) AS neu_rate,
       round(coalesce(100.0 * (positive - negative) / nullif(total, 0), 0), 6) AS sentiment_score
FROM n
""")
def s33_unlimited_request_kpis(spark, sf):
    """The same request without a fetch limit: KPIs over every row that passes the filters."""
    from newsloom.plans.common import news
    from newsloom.plans.headlines import HeadlineQuery
    q = HeadlineQuery(now="2024-01-20 00:00:00", days=14, limit=None,
                      filters={"sources": ["src1", "src2", "src3", "src4", "src5", "src6"]})
    return dashboard_panels(news(spark, sf), q)["kpis"]
