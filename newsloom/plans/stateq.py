"""Registered queries over stored state: text index, seen set, document frequencies, paging, sketches, panes."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import paging, seen_filter, sketches, text_index, tfidf_state
from newsloom.plans.common import news
from newsloom.plans.feed import SEARCH
from newsloom.plans.registry import EVENTS_CTE, NEWS_CTE, register
from newsloom.plans.textdedup import TFIDF_CTE
from newsloom.sources import files
from newsloom.sources.tables import table

NOW = "2024-01-26 00:00:00"
PRESETS = (1, 7, 30)


@register("b2_search_by_trigrams", sql=f"""
WITH {NEWS_CTE}
SELECT id, title FROM news
WHERE coalesce(title ILIKE '%{SEARCH}%', false) OR coalesce(summary ILIKE '%{SEARCH}%', false)
""")
def b2_search_by_trigrams(spark, sf):
    """B2 by the stored index: built over all titles and summaries, then searched."""
    n = news(spark, sf).select("id", "title", "summary")
    path = files.scratch_dir(spark, "trigrams")
    text_index.build(n, path, ["title", "summary"])
    return text_index.search(n, path, SEARCH, ["title", "summary"]).select("id", "title")


@register("c1_unseen_by_filter", sql=f"""
WITH {NEWS_CTE},
seen AS (SELECT 'https://n.example/' || CAST(doc_id AS VARCHAR) AS url FROM labels)
SELECT id, url FROM news WHERE url NOT IN (SELECT url FROM seen)
""")
def c1_unseen_by_filter(spark, sf):
    """C1 against a seen set of three runs, compacted after the second; most new rows are told by the filter alone."""
    keys = table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("key"))
    seen = seen_filter.SeenSet(spark, files.scratch_dir(spark, "seen"), keys.count())
    for run in range(3):
        seen.add(keys.filter(F.col("doc_id") % 3 == run), run=str(run))
        if run == 1:
            seen.compact()
    return seen.unseen(news(spark, sf).select("id", "url"), "url")


@register("d6_incremental_tfidf", sql=f"""
WITH {TFIDF_CTE}
SELECT id AS doc_id, term, df, round(w, 6) AS w FROM vec WHERE id % 3 = 2
""")
def d6_incremental_tfidf(spark, sf):
    """D6 of the third run, weighed by the stored counts of three runs: as a recompute over all documents gives."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = files.scratch_dir(spark, "tfidf-state")
    for run in range(3):
        tfidf_state.add_run(docs.filter(F.col("doc_id") % 3 == run), path, str(run), "doc_id")
    vec = tfidf_state.vectors(docs.filter(F.col("doc_id") % 3 == 2), path, "doc_id")
    return vec.select(F.col("id").alias("doc_id"), "term", "df", F.round("w", 6).alias("w"))


@register("f7_seek_page", sql=f"""
WITH {NEWS_CTE}
SELECT id, source, row_number() OVER (ORDER BY published_ts DESC NULLS LAST, id) - 1 AS pos FROM news
QUALIFY pos BETWEEN 120 AND 159
""")
def f7_seek_page(spark, sf):
    """F7 from a stored order: page 4 of 40 rows opens the blocks that it lies in."""
    path = files.scratch_dir(spark, "pages")
    n = news(spark, sf).select("id", "source", "published_ts")
    paging.store(n, [F.col("published_ts").desc_nulls_last(), F.col("id")], path, block_rows=64)
    return paging.page(spark, path, 4, 40).select("id", "source", "pos")


@register("e2_sketch_presets", sql=f"""
WITH {NEWS_CTE},
p AS (SELECT unnest([1, 7, 30]) AS days),
x AS (SELECT days, source, category, url FROM news, p
      WHERE datediff('day', CAST(published_ts AS DATE), DATE '2024-01-26') BETWEEN 0 AND days - 1)
SELECT days, count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories, true AS urls_within_bound
FROM x GROUP BY days
""")
def e2_sketch_presets(spark, sf):
    """E2 for the three presets from daily sketches.  Sources and categories are few, so their estimates are the exact
    counts; the urls' estimate is compared with the exact count and has to lie within three standard errors."""
    n = news(spark, sf).select("source", "category", "url", "published_ts")
    path = files.scratch_dir(spark, "sketches")
    sketches.daily(n, ["source", "category", "url"]).write.parquet(path)
    now = F.to_timestamp(F.lit(NOW))
    est = sketches.merged(spark.read.parquet(path), ["source", "category", "url"], now, PRESETS)
    age = F.datediff(F.to_date(now), F.to_date("published_ts"))
    exact = (n.withColumn("days", F.explode(F.array(*map(F.lit, PRESETS)))).filter((age >= 0) & (age < F.col("days")))
             .groupBy("days").agg(F.count_distinct("url").alias("exact")))
    near = F.abs(F.col("url") - F.col("exact")) <= 3 * sketches.relative_error() * F.col("exact") + 1
    return est.join(exact, "days").select("days", "rows", F.col("source").alias("sources"), F.col("category").alias("categories"),
                                          near.alias("urls_within_bound"))


@register("e16_sketch_keywords", sql=f"""
WITH {NEWS_CTE},
w AS (SELECT unnest(regexp_extract_all(lower(full_text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS item FROM news
      WHERE datediff('day', CAST(published_ts AS DATE), DATE '2024-01-26') BETWEEN 0 AND 6)
SELECT count FROM (SELECT item, count(*) AS count FROM w GROUP BY item) ORDER BY count DESC, item LIMIT 5
""")
def e16_sketch_keywords(spark, sf):
    """The counts of the five most frequent words of the last week: found by daily frequent-items sketches, counted exactly."""
    from newsloom.operators import tfidf
    words = news(spark, sf).select("published_ts", F.explode(tfidf.tokens(F.col("full_text"))).alias("item"))
    path = files.scratch_dir(spark, "items")
    sketches.daily_items(words, "item").write.parquet(path)
    days = spark.read.parquet(path)
    return sketches.exact_top_items(words, days, "item", F.to_timestamp(F.lit(NOW)), 7, 5).select("count")


@register("j6_weekly_from_panes", sql=f"""
WITH {EVENTS_CTE},
d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS p,
             count(*) FILTER (WHERE sentiment = 'negative') AS m FROM ev GROUP BY 1)
SELECT strftime(day - k * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_start, sum(n)::BIGINT AS count,
       round((sum(p) - sum(m)) * 100.0 / sum(n), 6) AS score
FROM d, (SELECT unnest(range(7)) AS k) GROUP BY 1
""")
def j6_weekly_from_panes(spark, sf):
    """J6 by panes: the stream keeps one aggregate per day, and the weekly windows are sums of stored panes."""
    from newsloom.plans.streamq import weekly_from_panes
    return weekly_from_panes(spark, sf)
