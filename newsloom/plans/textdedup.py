"""Registered dedup queries: key dedup, seen-set joins, TF-IDF, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import dedup, ranking, tfidf
from newsloom.plans.common import news
from newsloom.plans.registry import NEWS_CTE, register
from newsloom.sources.tables import table

THRESHOLD = 0.85

# DuckDB statement of the TF-IDF rule over ``documents`` (all copies counted).
TFIDF_CTE = r"""
toks AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
nd AS (SELECT count(*) AS n FROM documents),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT tf.id, tf.term, dfq.df, tf.tf * (ln((1.0 + nd.n) / (1.0 + dfq.df)) + 1.0) AS w
        FROM tf JOIN dfq USING (term) CROSS JOIN nd),
vec AS (SELECT id, term, df, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""

REPS_CTE = """
reps AS (SELECT doc_id AS id FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1)"""

PAIRS_SQL = f"""
WITH {TFIDF_CTE}, {REPS_CTE},
rv AS (SELECT vec.* FROM vec SEMI JOIN reps USING (id)),
p AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(a.w * b.w) AS cosine
      FROM rv a JOIN rv b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)
SELECT doc_a, doc_b, round(cosine, 6) AS cosine FROM p WHERE cosine >= {THRESHOLD}
"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@register("d1_dedupe_url_first_wins", sql="""
SELECT url, page_id FROM (
  SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id,
         row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS rn
  FROM pages) WHERE rn = 1 AND url IS NOT NULL AND url <> ''
""")
def d1_dedupe_url_first_wins(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), "page_id")
    return dedup.dedupe_by_key(p, "url", "page_id").select("url", "page_id")


@register("d2_dedupe_url_last_wins", sql="""
SELECT url, page_id FROM (
  SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id,
         row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id DESC) AS rn
  FROM pages) WHERE rn = 1 AND url IS NOT NULL AND url <> ''
""")
def d2_dedupe_url_last_wins(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), "page_id")
    return dedup.dedupe_by_key(p, "url", "page_id", last=True).select("url", "page_id")


@register("d3_drop_duplicate_text", sql="""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def d3_drop_duplicate_text(spark, sf):
    d = _docs(spark, sf)
    return dedup.dedupe_by_expr(d, F.col("text"), "doc_id").select("doc_id")


@register("d3_exact_copy_groups", sql="""
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS n_copies,
       doc_id = min(doc_id) OVER (PARTITION BY text) AS is_rep
FROM documents
""")
def d3_exact_copy_groups(spark, sf):
    return dedup.exact_copies(_docs(spark, sf), "doc_id", "text", "doc_id")


@register("d4_dedupe_text_prefix", sql="""
SELECT doc_id FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 250) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def d4_dedupe_text_prefix(spark, sf):
    d = _docs(spark, sf)
    return dedup.dedupe_by_expr(d, F.substring("text", 1, 250), "doc_id").select("doc_id")


@register("c1_unseen_anti_join", sql=f"""
WITH {NEWS_CTE},
seen AS (SELECT 'https://n.example/' || CAST(doc_id AS VARCHAR) AS url FROM labels)
SELECT id, url FROM news WHERE url NOT IN (SELECT url FROM seen)
""")
def c1_unseen_anti_join(spark, sf):
    seen = table(spark, sf, "labels").select(F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("url"))
    return dedup.unseen(news(spark, sf), seen, "url").select("id", "url")


@register("c2_new_vs_table", sql=f"""
WITH {NEWS_CTE},
existing AS (SELECT n.url FROM news n JOIN labels l ON n.id = l.doc_id WHERE l.quality = 1),
batch AS (SELECT regexp_replace(url, '[0-9]$', '') AS url, id FROM news)
SELECT url, id FROM (
  SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY id) AS rn
  FROM batch WHERE url NOT IN (SELECT url FROM existing)) WHERE rn = 1
""")
def c2_new_vs_table(spark, sf):
    n = news(spark, sf)
    existing = (n.join(table(spark, sf, "labels").filter(F.col("quality") == 1), n.id == F.col("doc_id"), "left_semi")
                .select("url"))
    batch = n.select(F.regexp_replace("url", "[0-9]$", "").alias("url"), "id")
    return dedup.new_vs_table(batch, existing, "url", "id").select("url", "id")


@register("a3_latest_row_per_key", sql="""
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def a3_latest_row_per_key(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    latest = ranking.first_wins(ev.withColumn("_o", F.struct("ts", "event_id")), "user_id", "_o", last=True)
    return latest.select("user_id", "event_id", "event_type")


@register("d6_tfidf_vectors", sql=f"""
WITH {TFIDF_CTE}
SELECT id AS doc_id, term, df, round(w, 6) AS w FROM vec
""")
def d6_tfidf_vectors(spark, sf):
    vec = tfidf.tfidf(_docs(spark, sf), "doc_id", "text")
    return vec.select(F.col("id").alias("doc_id"), "term", "df", F.round("w", 6).alias("w"))


@register("c4_tfidf_similar_pairs", sql=PAIRS_SQL)
def c4_tfidf_similar_pairs(spark, sf):
    pairs = dedup.near_duplicate_pairs(_docs(spark, sf), "doc_id", "text", threshold=THRESHOLD)
    return pairs.select("doc_a", "doc_b", F.round("cosine", 6).alias("cosine"))


SIGNATURE_SQL = r"""
sig AS (SELECT id AS doc_id, coalesce(title, '') || ' ' || coalesce(summary, '') AS text FROM news)"""


@register("d8_title_summary_pairs", sql=f"""
WITH {NEWS_CTE}, {SIGNATURE_SQL},
{TFIDF_CTE.replace("FROM documents", "FROM sig")},
{REPS_CTE.replace("FROM documents", "FROM sig")},
rv AS (SELECT vec.* FROM vec SEMI JOIN reps USING (id)),
p AS (SELECT a.id AS doc_a, b.id AS doc_b, sum(a.w * b.w) AS cosine
      FROM rv a JOIN rv b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)
SELECT doc_a, doc_b, round(cosine, 6) AS cosine FROM p WHERE cosine >= {THRESHOLD}
""")
def d8_title_summary_pairs(spark, sf):
    n = news(spark, sf)
    sig = n.select(F.col("id").alias("doc_id"),
                   F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))).alias("text"))
    pairs = dedup.near_duplicate_pairs(sig, "doc_id", "text", threshold=THRESHOLD)
    return pairs.select("doc_a", "doc_b", F.round("cosine", 6).alias("cosine"))


# The reference's ordered walk, replayed literally: one recursion step per document in
# order, carrying the list of kept ids (pairs materialised once).
GREEDY_WALK_SQL = f"""
WITH RECURSIVE {TFIDF_CTE},
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id
                       GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= {THRESHOLD}),
ord AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
walk(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = o.doc_id AND list_contains(w.kept, p.a))
              THEN w.kept ELSE list_append(w.kept, o.doc_id) END
  FROM walk w JOIN ord o ON o.rn = w.rn + 1),
final AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep,
                  len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) > 0 AS has_tok FROM documents)
SELECT c.doc_id, list_contains(f.kept, c.doc_id) AS kept,
       CASE WHEN list_contains(f.kept, c.doc_id) THEN 'kept'
            WHEN c.doc_id <> c.rep AND c.has_tok THEN 'exact_copy' ELSE 'near_duplicate' END AS reason
FROM copies c, final f
"""


@register("d7_greedy_near_dedup", sql=GREEDY_WALK_SQL)
def d7_greedy_near_dedup(spark, sf):
    """The oracle replays the ordered walk in SQL (recursive CTE); Spark runs it as greedy rounds."""
    return dedup.greedy_dedup(_docs(spark, sf), "doc_id", "text", "doc_id", THRESHOLD)


@register("e19_accounting_by_reason", sql="""
WITH exact AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents),
pre AS (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 250) ORDER BY doc_id) AS rn FROM exact WHERE rn = 1),
r AS (SELECT CASE WHEN e.rn > 1 THEN 'exact_text' WHEN p.rn > 1 THEN 'prefix' ELSE 'kept' END AS reason
      FROM exact e LEFT JOIN pre p USING (doc_id))
SELECT reason, count(*) AS rows, reason = 'kept' AS stays FROM r GROUP BY reason
""")
def e19_accounting_by_reason(spark, sf):
    return dedup.accounting_by_reason(dedup.text_drop_reasons(_docs(spark, sf), "doc_id", "text"))


@register("e19_batch_accounting", sql="""
WITH exact AS (SELECT doc_id, text FROM (
                 SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1),
pre AS (SELECT doc_id FROM (
          SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 250) ORDER BY doc_id) AS rn FROM exact) WHERE rn = 1)
SELECT 0 AS step, 'input' AS stage, count(*) AS rows FROM documents
UNION ALL SELECT 1, 'after_exact_text', count(*) FROM exact
UNION ALL SELECT 2, 'after_prefix_250', count(*) FROM pre
""")
def e19_batch_accounting(spark, sf):
    d = _docs(spark, sf)
    exact = dedup.dedupe_by_expr(d, F.col("text"), "doc_id")
    prefix250 = dedup.dedupe_by_expr(exact, F.substring("text", 1, 250), "doc_id")
    return dedup.batch_accounting([("input", d), ("after_exact_text", exact), ("after_prefix_250", prefix250)])
