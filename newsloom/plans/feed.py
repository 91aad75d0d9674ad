"""Registered projection/filter (B) and ordering/paging (F) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import filters, ranking
from newsloom.plans.common import news, viz
from newsloom.plans.headlines import HeadlineQuery, sort_order
from newsloom.plans.registry import NEWS_CTE, VIZ_CTE, register
from newsloom.sources.tables import table

# Fixed request parameters used by the registered queries.
NOW = "2024-01-20 00:00:00"
SEARCH = "the"
FACETS = {"sources": ["src1", "src3", "src5"], "sentiments": ["Positive", "NEGATIVE"]}

HEADLINE_SQL = f"""
WITH {NEWS_CTE}
SELECT id, title, summary, source, category, sentiment, url, language,
       CAST(NULL AS VARCHAR) AS published_date, CAST(NULL AS VARCHAR) AS scraped_at,
       CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS FLOAT[]) AS embedding,
       strftime(published_ts, '%Y-%m-%d %H:%M:%S') AS published
FROM news"""


def _published_str(df):
    return df.withColumn("published", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss")).drop("published_ts")


@register("b1_headline_projection", sql=HEADLINE_SQL)
def b1_headline_projection(spark, sf):
    return _published_str(filters.headline_projection(news(spark, sf), keep=["published_ts"]))


@register("b2_search_title_summary", sql=f"""
WITH {NEWS_CTE}
SELECT id, title FROM news
WHERE coalesce(title ILIKE '%{SEARCH}%', false) OR coalesce(summary ILIKE '%{SEARCH}%', false)
""")
def b2_search_title_summary(spark, sf):
    return filters.search_filter(news(spark, sf), SEARCH).select("id", "title")


@register("b3_contains_ci", sql=f"""
WITH {NEWS_CTE}
SELECT id, coalesce(full_text ILIKE '%ion%', false) AS hit FROM news
""")
def b3_contains_ci(spark, sf):
    return news(spark, sf).select("id", filters.contains_ci(F.col("full_text"), "ion").alias("hit"))


@register("b4_recency_filter", sql=f"""
WITH {NEWS_CTE}
SELECT id, strftime(published_ts, '%Y-%m-%d %H:%M:%S') AS published FROM news
WHERE published_ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
""")
def b4_recency_filter(spark, sf):
    df = filters.recency_filter(news(spark, sf), NOW, 7)
    return df.select("id", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss").alias("published"))


@register("b5_facet_filter", sql=f"""
WITH {NEWS_CTE}
SELECT id, source, sentiment FROM news
WHERE source IN ('src1', 'src3', 'src5') AND lower(sentiment) IN ('positive', 'negative')
""")
def b5_facet_filter(spark, sf):
    return filters.facet_filter(news(spark, sf), FACETS).select("id", "source", "sentiment")


@register("b6_normalise_defaults", sql=f"""
WITH {NEWS_CTE}
SELECT id, coalesce(title, '') AS title, coalesce(source, 'Unknown') AS source,
       coalesce(category, 'General') AS category, coalesce(sentiment, 'neutral') AS sentiment,
       coalesce(CAST(NULL AS VARCHAR), '') AS image_url
FROM news
""")
def b6_normalise_defaults(spark, sf):
    df = filters.normalise(filters.headline_projection(news(spark, sf)))
    return df.select("id", "title", "source", "category", "sentiment", "image_url")


@register("b8_enrich_for_analysis", sql=f"""
WITH {VIZ_CTE}
SELECT id, date, hour, weekday, is_weekend, sentiment_lower FROM viz
""")
def b8_enrich_for_analysis(spark, sf):
    return viz(spark, sf).select("id", "date", "hour", "weekday", "is_weekend", "sentiment_lower")


@register("b9_sentiment_bucket", sql="""
SELECT event_id, CASE WHEN lower(s) LIKE '%pos%' THEN 'positive' WHEN lower(s) LIKE '%neg%' THEN 'negative'
                      ELSE 'neutral' END AS bucket
FROM (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Positive.'
                            WHEN event_type = 'error' THEN 'NEGATIVE' ELSE 'Mixed' END AS s FROM events)
""")
def b9_sentiment_bucket(spark, sf):
    ev = table(spark, sf, "events")
    raw = (F.when(F.col("event_type").isin("purchase", "signup"), F.lit("Positive."))
            .when(F.col("event_type") == "error", F.lit("NEGATIVE")).otherwise(F.lit("Mixed")))
    return ev.select("event_id", filters.sentiment_bucket(raw).alias("bucket"))


@register("b10_exclude_url_paths", sql="""
SELECT page_id, url FROM pages WHERE NOT coalesce(regexp_matches(url, '/(live|av|videos)/'), false)
""")
def b10_exclude_url_paths(spark, sf):
    return table(spark, sf, "pages").filter(filters.exclude_url_paths(F.col("url"))).select("page_id", "url")


@register("b11_min_length_words", sql="""
SELECT doc_id, length(text) >= 50 AS long_enough,
       len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 6 AS enough_words
FROM documents
""")
def b11_min_length_words(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", filters.min_length(F.col("text"), 50).alias("long_enough"),
                    filters.min_words(F.col("text"), 6).alias("enough_words"))


@register("b12_drop_short_text", sql="""
SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND length(text) > 30
""")
def b12_drop_short_text(spark, sf):
    return filters.drop_short_text(table(spark, sf, "conversations"), "text", 30).select("conv_id", "turn")


@register("b13_fill_category", sql="""
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, 'Uncategorized') AS category
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def b13_fill_category(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, F.lit("toxic")).alias("category"))
    return filters.fill_category(j)


@register("b14_update_where", sql="""
SELECT doc_id, md5(CASE WHEN lang = 'de' THEN translate(text, 'äöüÄÖÜ', 'aouAOU') ELSE text END) AS text_md5
FROM documents
""")
def b14_update_where(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    out = filters.update_where(d, F.col("lang") == "de", "text", F.translate("text", "äöüÄÖÜ", "aouAOU"))
    return out.select("doc_id", F.md5("text").alias("text_md5"))


@register("b16_merged_text", sql=f"""
WITH {NEWS_CTE}
SELECT id, 'news' AS kind, md5(coalesce(summary, '') || ' ' || coalesce(full_text, '')) AS text_md5,
       length(coalesce(summary, '') || ' ' || coalesce(full_text, '')) AS text_len
FROM news
""")
def b16_merged_text(spark, sf):
    t = filters.merged_text(F.col("summary"), F.col("full_text"))
    return news(spark, sf).select("id", F.lit("news").alias("kind"), F.md5(t).alias("text_md5"),
                                  F.length(t).alias("text_len"))


@register("b18_article_text", sql="""
SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'system' THEN '' ELSE text END, ''),
                               nullif('In short: ' || text, '')) AS body
FROM conversations
""")
def b18_article_text(spark, sf):
    c = table(spark, sf, "conversations")
    full = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", filters.article_text(full, F.concat(F.lit("In short: "), "text")).alias("body"))


# ---------------------------------------------------------------- F section

@register("f1_first_n_per_section", sql="""
SELECT doc_id, source, pos_in_group FROM (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos_in_group
  FROM documents) WHERE pos_in_group <= 10 AND lang = 'en'
""")
def f1_first_n_per_section(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    first = ranking.first_n_per_group(d, "source", [F.col("doc_id")], 10)
    return first.filter(F.col("lang") == "en").select("doc_id", "source", "pos_in_group")


@register("f2_first_n_after_filter", sql="""
SELECT doc_id, source, pos_in_group FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos_in_group
  FROM documents WHERE lang = 'en') WHERE pos_in_group <= 20
""")
def f2_first_n_after_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").filter(F.col("lang") == "en")
    return ranking.first_n_per_group(d, "source", [F.col("doc_id")], 20).select("doc_id", "source", "pos_in_group")


@register("f3_global_cap", sql="""
SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 300
""")
def f3_global_cap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return ranking.global_cap(d, [F.col("source"), F.col("doc_id")], 300)


@register("f4_sequential_ids", sql="""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events
""")
def f4_sequential_ids(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return ranking.sequential_ids(ev, [F.col("ts"), F.col("event_id")]).select("event_id", "seq")


@register("f5_fetch_newest", sql=f"""
WITH {NEWS_CTE}
SELECT id, source, title, strftime(published_ts, '%Y-%m-%d %H:%M:%S') AS published FROM news
WHERE (coalesce(title ILIKE '%{SEARCH}%', false) OR coalesce(summary ILIKE '%{SEARCH}%', false))
  AND published_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
  AND source IN ('src1', 'src3', 'src5') AND lower(sentiment) IN ('positive', 'negative')
ORDER BY published_ts DESC NULLS LAST, id LIMIT 50
""")
def f5_fetch_newest(spark, sf):
    q = HeadlineQuery(now=NOW, days=30, limit=50, search=SEARCH, filters=FACETS)
    out = q.fetch(news(spark, sf))
    return out.select("id", "source", "title", F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss").alias("published"))


@register("f6_feed_sort_rank", sql="""
SELECT doc_id, source, row_number() OVER (ORDER BY source ASC NULLS LAST, doc_id) AS rank FROM documents
""")
def f6_feed_sort_rank(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    ranked = ranking.sequential_ids(d, sort_order("source"), col="rank")
    return ranked.select(F.col("id").alias("doc_id"), "source", "rank")


@register("f7_feed_page", sql=f"""
WITH {NEWS_CTE}
SELECT id, source FROM news WHERE published_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
ORDER BY published_ts DESC NULLS LAST, id LIMIT 200 OFFSET 200
""")
def f7_feed_page(spark, sf):
    q = HeadlineQuery(now=NOW, days=30, limit=5000, sort="newest")
    return q.feed_page(news(spark, sf), page_no=2, per_page=500).select("id", "source")


@register("f7_page_count", sql=f"""
WITH {NEWS_CTE}
SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT AS pages, count(*) AS rows FROM news
WHERE published_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY
""")
def f7_page_count(spark, sf):
    q = HeadlineQuery(now=NOW, days=30)
    return ranking.page_count(q.frame(news(spark, sf)), 200)


@register("f8_balanced_sample", sql="""
SELECT doc_id, lang, sample_rank FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id)
         AS sample_rank FROM documents) WHERE sample_rank <= 25
""")
def f8_balanced_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return ranking.balanced_sample(d, "lang", 25, id_col="doc_id", seed=42).select("doc_id", "lang", "sample_rank")


@register("f9_train_test_split", sql="""
SELECT doc_id, CASE WHEN (('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 100) < 80
                    THEN 'train' ELSE 'test' END AS split
FROM documents
""")
def f9_train_test_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return ranking.split_train_test(d, "doc_id", 42).select("doc_id", "split")
