"""Registered ingest, sink, catalog and API-flattening queries.

Ingest queries first land the news rows (derived from ``documents``) in the
reference's layouts — JSON runs per language/outlet folder, RSS XML, CSV —
under the session's shared checkpoint folder, then read them back through
the readers under test, so their work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.operators import api, dedup
from newsloom.plans.common import news
from newsloom.plans.registry import NEWS_CTE, register
from newsloom.plans.textq import _strip_sql
from newsloom.sources import catalog, files, landing
from newsloom.sources.tables import table

RUN_SPLIT = "2024-01-13 00:00:00"
RSS_CLEAN = r"[^\p{L}\p{N}\s.,;:!?'-]"
RSS_CLEAN_SQL = "regexp_replace({x}, '" + RSS_CLEAN.replace("'", "''") + "', '', 'g')"


def raw_articles(spark, sf):
    """News view as raw-article records (string fields) + landing partition columns."""
    n = news(spark, sf)
    return n.select(
        "id", "source", "language", "category", "title", "url", "summary", "full_text",
        F.lit(None).cast("string").alias("image_url"),
        D.iso_utc(F.col("published_ts")).alias("published_date"),
        D.iso_utc(F.col("published_ts")).alias("scraped_at"),
        F.col("language").alias("lang_dir"), F.col("source").alias("outlet_dir"),
        F.when(F.col("published_ts") < F.to_timestamp(F.lit(RUN_SPLIT)), F.lit("20240101_060000"))
         .otherwise(F.lit("20240113_060000")).alias("run_ts"),
    )


@register("a3_landing_latest_run_ingest", sql=f"""
WITH {NEWS_CTE},
r AS (SELECT id, language, source, url, CASE WHEN published_ts < TIMESTAMP '{RUN_SPLIT}' THEN '20240101_060000'
                                             ELSE '20240113_060000' END AS run_ts FROM news),
m AS (SELECT language, source, max(run_ts) AS run_ts FROM r GROUP BY language, source)
SELECT r.url, r.language, r.source FROM r JOIN m USING (language, source, run_ts)
""")
def a3_landing_latest_run_ingest(spark, sf):
    root = files.scratch_dir(spark, "landing")
    raw_articles(spark, sf).write.partitionBy("lang_dir", "outlet_dir", "run_ts").json(root)
    found = files.latest_per_folder(files.list_files(spark, root, "*.json"))
    recs = files.read_json_records(spark, found, require_any=("full_text", "summary"), lines=True)
    return recs.select("url", "language", "source")


@register("a3_landing_source", sql=f"""
WITH {NEWS_CTE},
r AS (SELECT language, source, url, full_text, CASE WHEN published_ts < TIMESTAMP '{RUN_SPLIT}' THEN '20240101_060000'
                                             ELSE '20240113_060000' END AS run_ts FROM news),
m AS (SELECT language, source, max(run_ts) AS run_ts FROM r GROUP BY language, source)
SELECT r.url, 'lang_dir=' || r.language || '/outlet_dir=' || r.source AS folder, md5(r.full_text) AS body FROM r JOIN m USING (language, source, run_ts)
""")
def a3_landing_source(spark, sf):
    """A1-A5 by the landing data source: the newest run of every outlet folder, records with their folder."""
    root = files.scratch_dir(spark, "landing")
    raw_articles(spark, sf).write.partitionBy("lang_dir", "outlet_dir", "run_ts").json(root)
    rows = landing.admitted(landing.read_landed(spark, root, latest=True, require=("full_text", "summary")))
    return rows.select("url", F.col("source_folder").alias("folder"), F.md5("full_text").alias("body"))


@register("a8_seen_state_roundtrip", sql=f"""
WITH {NEWS_CTE}
SELECT id, url FROM news WHERE url NOT IN (SELECT 'https://n.example/' || CAST(doc_id AS VARCHAR) FROM labels)
""")
def a8_seen_state_roundtrip(spark, sf):
    state = files.scratch_dir(spark, "seen")
    seen_now = files.load_seen(spark, state)                       # A7: missing -> empty
    labelled = table(spark, sf, "labels").select(
        F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("url"))
    files.save_seen(spark, labelled.join(seen_now.select("url"), "url", "left_anti"), state,
                    now="2024-01-20 00:00:00")                       # A8: append only new keys
    return dedup.unseen(news(spark, sf), files.load_seen(spark, state), "url").select("id", "url")


@register("a10_csv_roundtrip", sql="""
SELECT doc_id, md5(text) AS h, length(text) AS n FROM documents
""")
def a10_csv_roundtrip(spark, sf):
    path = files.scratch_dir(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    files.write_csv(docs, path)
    back = files.read_csv(spark, path, docs.schema)
    return back.select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n"))


@register("a11_export_json_records", sql=f"""
WITH {NEWS_CTE}
SELECT id, source, sentiment, title FROM news WHERE lower(sentiment) = 'negative'
""")
def a11_export_json_records(spark, sf):
    path = files.scratch_dir(spark, "export")
    sel = news(spark, sf).filter(F.lower("sentiment") == "negative").select("id", "source", "sentiment", "title")
    files.write_json_run(sel, path, "20240120_000000")
    return spark.read.schema(sel.schema).json(f"{path}/run_ts=20240120_000000")


@register("a12_parameterised_sql", sql="""
SELECT doc_id, source FROM documents WHERE source = 'src3' AND lang = 'en'
""")
def a12_parameterised_sql(spark, sf):
    docs = table(spark, sf, "documents")
    return spark.sql("SELECT doc_id, source FROM {docs} WHERE source = :src AND lang = :lang",
                     args={"src": "src3", "lang": "en"}, docs=docs)


@register("a13_find_news_table", sql=f"""
WITH {NEWS_CTE}
SELECT id, source FROM news
""")
def a13_find_news_table(spark, sf):
    import uuid
    view = f"aaa_{uuid.uuid4().hex[:8]}_news_adapter"   # a name of this call's own, first among the views
    news(spark, sf).select("id", "source").createOrReplaceTempView(view)
    try:
        found = catalog.find_table(spark, candidates=["no_such_table_a", "no_such_table_b"])
        if found is None or found[0] != view:
            raise RuntimeError(f"expected {view}, found {found}")
        return spark.table(view)
    finally:
        spark.catalog.dropTempView(view)   # the returned frame no longer needs its name


@register("a15_append_with_generated_ids", sql=f"""
WITH {NEWS_CTE},
h AS (SELECT url, row_number() OVER (ORDER BY published_ts, id) AS id FROM news WHERE published_ts < TIMESTAMP '{RUN_SPLIT}'),
b AS (SELECT url, (SELECT count(*) FROM h) + row_number() OVER (ORDER BY published_ts, id) AS id
      FROM news WHERE published_ts >= TIMESTAMP '{RUN_SPLIT}')
SELECT url, id FROM h UNION ALL SELECT url, id FROM b
""")
def a15_append_with_generated_ids(spark, sf):
    import uuid
    name = f"news_tbl_{uuid.uuid4().hex[:10]}"
    loc = files.scratch_dir(spark, "table")
    catalog.ensure_table(spark, name, loc)
    rows = news(spark, sf).select("id", "source", "language", "category", "title", "url", "summary",
                                  "full_text", "sentiment", "published_ts")
    order = [F.col("published_ts"), F.col("id")]
    split = F.to_timestamp(F.lit(RUN_SPLIT))
    catalog.append_rows(spark, name, rows.filter(F.col("published_ts") < split), order, now="2024-01-13 00:00:00")
    catalog.append_rows(spark, name, rows.filter(F.col("published_ts") >= split), order, now="2024-01-27 00:00:00")
    return spark.table(name).select("url", "id")


# ----------------------------------------------------------- API flattening

GUARDIAN_ITEMS_SQL = """
g AS (SELECT d.doc_id,
  {'webTitle': d.text, 'webUrl': 'https://g.example/' || CAST(d.doc_id AS VARCHAR),
   'sectionName': CASE WHEN d.lang = 'en' THEN 'World' END, 'section': d.source,
   'webPublicationDate': strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id * 37 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ'),
   'fields': {'trailText': CASE WHEN d.lang IN ('fr', 'de') THEN NULL ELSE 'Trail: ' || d.text END,
              'standfirst': CASE WHEN d.lang = 'de' THEN 'First: ' || d.text END,
              'bodyText': CASE WHEN d.lang = 'es' THEN NULL ELSE d.text END,
              'body': '<p>' || d.text || '</p>',
              'thumbnail': CASE WHEN d.lang = 'en' THEN 'https://img.example/' || CAST(d.doc_id AS VARCHAR) || '.jpg' END,
              'byline': d.source},
   'tags': [{'type': 'keyword', 'webTitle': 'k'}, {'type': 'contributor', 'webTitle': 'Author ' || d.source}]} AS item
  FROM documents d)"""


def guardian_items(spark, sf):
    d = table(spark, sf, "documents")
    ts = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 37).cast("int"))
    fields = F.struct(
        F.when(F.col("lang").isin("fr", "de"), F.lit(None).cast("string")).otherwise(F.concat(F.lit("Trail: "), "text")).alias("trailText"),
        F.when(F.col("lang") == "de", F.concat(F.lit("First: "), "text")).alias("standfirst"),
        F.when(F.col("lang") == "es", F.lit(None).cast("string")).otherwise(F.col("text")).alias("bodyText"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("body"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://img.example/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("thumbnail"),
        F.col("source").alias("byline"))
    tags = F.array(F.struct(F.lit("keyword").alias("type"), F.lit("k").alias("webTitle")),
                   F.struct(F.lit("contributor").alias("type"), F.concat(F.lit("Author "), F.col("source")).alias("webTitle")))
    item = F.struct(F.col("text").alias("webTitle"),
                    F.concat(F.lit("https://g.example/"), F.col("doc_id").cast("string")).alias("webUrl"),
                    F.when(F.col("lang") == "en", F.lit("World")).alias("sectionName"), F.col("source").alias("section"),
                    F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("webPublicationDate"), fields.alias("fields"),
                    tags.alias("tags"))
    return d.select("doc_id", F.struct(F.array(item).alias("results")).alias("response"))


@register("a16_a18_flatten_guardian", sql=f"""
WITH {GUARDIAN_ITEMS_SQL},
i AS (SELECT unnest([item]) AS it FROM g)
SELECT it.webUrl AS url, coalesce(nullif(it.sectionName, ''), nullif(it.section, '')) AS category, md5(it.webTitle) AS title_md5,
       md5(CASE WHEN nullif(it.fields.bodyText, '') IS NOT NULL
            THEN coalesce(nullif(it.fields.trailText, ''), nullif(it.fields.standfirst, ''),
                          substr(it.fields.bodyText, 1, 180) || '...') END) AS summary_md5,
       md5(coalesce(nullif(it.fields.bodyText, ''), nullif(it.fields.body, ''))) AS body_md5,
       nullif(it.fields.thumbnail, '') AS image_url,
       strftime(CAST(it.webPublicationDate AS TIMESTAMP), '%A, %d %B %Y %H:%M:%S') AS published_date,
       list_filter(it.tags, lambda t: t.type = 'contributor')[1].webTitle AS author
FROM i
""")
def a16_a18_flatten_guardian(spark, sf):
    items = api.explode_results(guardian_items(spark, sf))
    flat = api.normalize_guardian(items, F.lit("2024-01-20T00:00:00+00:00"))
    return flat.select("url", "category", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"),
                       F.md5("full_text").alias("body_md5"), "image_url",
                       "published_date", "author")


@register("a17_flatten_nyt", sql="""
WITH n AS (SELECT doc_id, text AS title, 'https://y.example/' || CAST(doc_id AS VARCHAR) AS url,
                  CASE WHEN lang IN ('en', 'fr') THEN [{'url': 'https://m.example/' || CAST(doc_id AS VARCHAR)}] ELSE [] END AS multimedia,
                  CASE WHEN lang = 'de' THEN [{'media-metadata': [{'url': 'small'}, {'url': 'large-' || CAST(doc_id AS VARCHAR)}]}]
                       ELSE [] END AS media
           FROM documents)
SELECT url, md5(title) AS title_md5, md5('About ' || title) AS summary_md5, CASE WHEN len(multimedia) > 0 THEN multimedia[1].url
                 WHEN len(media) > 0 THEN media[1]['media-metadata'][-1].url END AS image_url
FROM n
""")
def a17_flatten_nyt(spark, sf):
    d = table(spark, sf, "documents")
    mm = F.when(F.col("lang").isin("en", "fr"),
                F.array(F.struct(F.concat(F.lit("https://m.example/"), F.col("doc_id").cast("string")).alias("url"))))
    mm = mm.otherwise(F.array().cast("array<struct<url:string>>"))
    meta = F.array(F.struct(F.lit("small").alias("url")),
                   F.struct(F.concat(F.lit("large-"), F.col("doc_id").cast("string")).alias("url")))
    media = F.when(F.col("lang") == "de", F.array(F.struct(meta.alias("media-metadata"))))
    media = media.otherwise(F.array().cast("array<struct<`media-metadata`:array<struct<url:string>>>>"))
    items = d.select(F.col("text").alias("title"),
                     F.concat(F.lit("https://y.example/"), F.col("doc_id").cast("string")).alias("url"),
                     F.concat(F.lit("About "), "text").alias("abstract"), F.lit(None).cast("string").alias("published_date"),
                     mm.alias("multimedia"), media.alias("media"))
    flat = api.normalize_nyt(items, F.lit("world"), F.lit("x"))
    return flat.select("url", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), "image_url")


@register("a19_rss_items", sql=f"""
WITH {NEWS_CTE}
SELECT url, {_strip_sql(RSS_CLEAN_SQL.replace("{x}", "title"))} AS title,
       {_strip_sql(RSS_CLEAN_SQL.replace("{x}", "summary"))} AS summary,
       strftime(date_trunc('second', published_ts), '%Y-%m-%d %H:%M:%S') AS published
FROM news WHERE NOT regexp_matches(url, '/(live|av|videos)/')
""")
def a19_rss_items(spark, sf):
    path = files.scratch_dir(spark, "rss")
    n = news(spark, sf)
    clean = lambda c: F.regexp_replace(c, RSS_CLEAN, "")
    feed = n.select(clean(F.col("title")).alias("title"), F.col("url").alias("link"),
                    F.concat(F.lit("<p>"), clean(F.col("summary")), F.lit("</p>")).alias("description"),
                    F.concat(F.date_format("published_ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"))
    files.write_rss(feed, path)
    rows = api.rss_items(files.read_rss(spark, path))
    return rows.select("url", "title", "summary",
                       F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss").alias("published"))


# ------------------------------------------------------------------ set ops, C7-C9

@register("g1_union_by_name_missing", sql="""
SELECT doc_id, text_len, source, NULL::VARCHAR AS lang FROM
  (SELECT doc_id, length(text) AS text_len, source FROM documents WHERE lang = 'en')
UNION ALL
SELECT doc_id, length(text) AS text_len, NULL::VARCHAR AS source, lang FROM documents WHERE lang <> 'en'
""")
def g1_union_by_name_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("text_len"), "source", "lang")
    en = d.filter(F.col("lang") == "en").select("doc_id", "text_len", "source")
    other = d.filter(F.col("lang") != "en").select("doc_id", "text_len", "lang")
    return en.unionByName(other, allowMissingColumns=True)


@register("g4_seen_union_distinct", sql=f"""
WITH {NEWS_CTE}
SELECT DISTINCT url FROM (SELECT 'https://n.example/' || CAST(doc_id AS VARCHAR) AS url FROM labels
                          UNION ALL SELECT url FROM news WHERE lower(sentiment) = 'positive')
""")
def g4_seen_union_distinct(spark, sf):
    seen = table(spark, sf, "labels").select(F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("url"))
    new = news(spark, sf).filter(F.lower("sentiment") == "positive").select("url")
    return seen.union(new).distinct()


@register("g5_except_all", sql="""
SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels
""")
def g5_except_all(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


LABEL_IDS = {"positive": 0, "negative": 1, "neutral": 2}


@register("c7_label_to_id", sql=f"""
WITH {NEWS_CTE}
SELECT id, CASE lower(sentiment) WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 WHEN 'neutral' THEN 2 END AS label_id
FROM news WHERE lower(sentiment) IN ('positive', 'negative', 'neutral')
""")
def c7_label_to_id(spark, sf):
    from newsloom.operators import labels
    return labels.label_ids(news(spark, sf), "sentiment").select("id", "label_id")


@register("c9_card_page_fallback", sql="""
WITH cards AS (SELECT 'https://n.example/' || CAST(doc_id AS VARCHAR) AS url,
                      CASE WHEN lang = 'en' THEN '' ELSE 'card-' || CAST(doc_id AS VARCHAR) END AS image FROM documents),
pagesv AS (SELECT 'https://n.example/' || CAST(page_id AS VARCHAR) AS url, 'page-' || CAST(page_id AS VARCHAR) AS image FROM pages)
SELECT c.url, coalesce(nullif(c.image, ''), p.image) AS image FROM cards c LEFT JOIN pagesv p ON c.url = p.url
""")
def c9_card_page_fallback(spark, sf):
    d = table(spark, sf, "documents")
    cards = d.select(F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string")).alias("url"),
                     F.when(F.col("lang") == "en", F.lit("")).otherwise(F.concat(F.lit("card-"), F.col("doc_id").cast("string"))).alias("image"))
    pg = table(spark, sf, "pages").select(F.concat(F.lit("https://n.example/"), F.col("page_id").cast("string")).alias("url"),
                                          F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("page_image"))
    return cards.join(pg, "url", "left").select("url", F.coalesce(F.nullif("image", F.lit("")), F.col("page_image")).alias("image"))


def _processor_walk_sql():
    """Newest run per outlet, greedy walk over title + summary in path order, then the offline model's label."""
    from newsloom.plans.modelq import NEG_SQL, POS_SQL
    from newsloom.plans.textdedup import GREEDY_WALK_SQL
    sig = f"""{NEWS_CTE},
runs AS (SELECT *, published_ts >= TIMESTAMP '{RUN_SPLIT}' AS late FROM news),
latest AS (SELECT language, source, bool_or(late) AS late FROM runs GROUP BY language, source),
picked AS (SELECT r.*, row_number() OVER (ORDER BY r.language || '/outlet_dir=' || r.source || '/', r.id) AS seq
           FROM runs r JOIN latest USING (language, source, late)),
sig AS (SELECT seq AS doc_id, coalesce(title, '') || ' ' || coalesce(summary, '') AS text FROM picked),"""
    walk = GREEDY_WALK_SQL.replace("FROM documents", "FROM sig").replace("WITH RECURSIVE", f"WITH RECURSIVE {sig}", 1)
    head, tail = walk.rsplit("SELECT c.doc_id", 1)
    return head.rstrip() + f""",
decided AS (SELECT c.doc_id{tail}),
body AS (SELECT p.url, p.source, coalesce(nullif(full_text, ''), nullif(summary, '')) AS src FROM picked p
         JOIN decided d ON d.doc_id = p.seq WHERE d.kept),
lex AS (SELECT url, source, regexp_extract_all(lower(CASE WHEN length(src) > 1500
           THEN substr(src, 1, 1000) || chr(10) || '... [middle removed] ...' || chr(10) || substr(src, length(src) - 499)
           ELSE coalesce(src, '') END), '[\\p{{L}}\\p{{N}}_]+') AS t FROM body),
score AS (SELECT url, source, len(list_filter(t, lambda w: w IN ({POS_SQL}))) - len(list_filter(t, lambda w: w IN ({NEG_SQL}))) AS s FROM lex)
SELECT url, source, CASE WHEN s > 0 THEN 'Positive' WHEN s < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM score
"""


@register("s31_processor_run", sql=_processor_walk_sql())
def s31_processor_run(spark, sf):
    """The raw -> processed lifecycle over the landed news rows (English signature)."""
    from newsloom.plans import jobs
    root = files.scratch_dir(spark, "proc")
    # Each outlet's file holds its rows by id, which is their order of arrival.
    landing = raw_articles(spark, sf).sortWithinPartitions("lang_dir", "outlet_dir", "run_ts", "id")
    landing.write.partitionBy("lang_dir", "outlet_dir", "run_ts").json(f"{root}/landing", compression="gzip")
    return jobs.processor_run(spark, f"{root}/landing", f"{root}/seen", f"{root}/processed", "en",
                              "20240113_070000", compression="gzip").select("url", "source", "sentiment")


LOAD_NOW = "2024-01-27 00:00:00"


def _loader_walk_sql():
    """The loader's row-by-row walk over the news rows: French rows first, then the others, by url."""
    from newsloom.plans.modelq import EMBED_CTE
    return f"""
WITH RECURSIVE {NEWS_CTE}, {EMBED_CTE},
hist AS (SELECT id, url, id % 20 = 0 AS recent FROM news WHERE id % 10 = 0),
b1 AS (SELECT id, url, row_number() OVER (ORDER BY language <> 'fr', url) AS seq FROM news WHERE id % 10 <> 0),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.cell = b.cell AND a.id <> b.id
                       GROUP BY a.id, b.id HAVING sum(a.v * b.v) >= 0.85),
hh AS (SELECT DISTINCT b1.id FROM b1 JOIN pairs p ON p.b = b1.id JOIN hist h ON h.id = p.a AND h.recent),
b2 AS (SELECT id, row_number() OVER (ORDER BY seq) AS rn FROM b1 WHERE id NOT IN (SELECT id FROM hh)),
walk(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = o.id AND list_contains(w.kept, p.a))
                        THEN w.kept ELSE list_append(w.kept, o.id) END
  FROM walk w JOIN b2 o ON o.rn = w.rn + 1),
final AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
mx AS (SELECT coalesce(max(id), 0) AS m FROM hist)
SELECT news.url, CASE WHEN list_contains(f.kept, news.id) THEN 'inserted' WHEN news.id IN (SELECT id FROM hh) THEN 'semantic_history'
                      WHEN news.id IN (SELECT id FROM b1) THEN 'semantic_batch' ELSE 'url_duplicate' END AS decision,
       CASE WHEN list_contains(f.kept, news.id) THEN mx.m + list_position(f.kept, news.id) END AS new_id
FROM news, final f, mx
"""


@register("s32_loader_run", sql=_loader_walk_sql())
def s32_loader_run(spark, sf):
    """Processed rows -> embedding -> incremental semantic load against a table that holds every tenth row.

    Half of the history is inside the 48 h window, half is older, so all four decisions occur.
    """
    from newsloom.operators import enrich
    from newsloom.plans import jobs
    n = news(spark, sf)
    processed = n.select("source", "language", "category", "title", "url", "summary", "full_text")
    now = F.to_timestamp(F.lit(LOAD_NOW))
    held = enrich.embed_articles(n.filter(F.col("id") % 10 == 0), out="vec")
    history = held.select("id", "url", "vec", F.when(F.col("id") % 20 == 0, now - F.expr("INTERVAL 10 HOURS"))
                          .otherwise(now - F.expr("INTERVAL 100 HOURS")).alias("inserted_at")).checkpoint(eager=True)
    out = jobs.loader_run(spark, processed.filter(F.col("language") == "fr"), processed.filter(F.col("language") != "fr"),
                          history, LOAD_NOW, threshold=0.85)
    return out.select("url", "decision", "new_id")
