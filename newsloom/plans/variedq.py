"""Queries whose inputs are spliced from the given tables so that every branch of a rule runs.

The plain tables hold unique urls, pages of one shape and texts without Arabic, so some rules never act on
them.  Each query here builds the missing variety from table columns in both engines and states the
expected result from that construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import html as H
from newsloom.functions import html_tree as HT
from newsloom.functions import text as T
from newsloom.operators import dedup, enrich, filters, labels, ranking
from newsloom.plans.common import news
from newsloom.plans.modelq import LEXICON_CTE
from newsloom.plans.pagesq import get_text_sql, paragraphs_sql, sq
from newsloom.plans.registry import NEWS_CTE, register
from newsloom.plans.textq import _collapse_sql, _strip_sql
from newsloom.sources.tables import table

# ------------------------------------------------------------------ D1, D2: pages of one site section share a key
SECTION = r"/[0-9].*$"


def _sections(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_replace("url", SECTION, "").alias("url"), "page_id")


@register("d1_first_page_per_section", sql=f"""
SELECT regexp_replace(url, '{SECTION}', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1
""")
def d1_first_page_per_section(spark, sf):
    return dedup.dedupe_by_key(_sections(spark, sf), "url", "page_id").select("url", "page_id")


@register("d2_last_page_per_section", sql=f"""
SELECT regexp_replace(url, '{SECTION}', '') AS url, max(page_id) AS page_id FROM pages GROUP BY 1
""")
def d2_last_page_per_section(spark, sf):
    return dedup.dedupe_by_key(_sections(spark, sf), "url", "page_id", last=True).select("url", "page_id")


# ------------------------------------------------------------------ B10: every fifth page is a live, av or video page
@register("b10_exclude_spliced_paths", sql="""
SELECT page_id FROM pages WHERE page_id % 5 <> 0
""")
def b10_exclude_spliced_paths(spark, sf):
    kind = F.element_at(F.array(F.lit("live"), F.lit("av"), F.lit("videos")), (F.col("page_id") % 3 + 1).cast("int"))
    spliced = F.concat(F.lit("https://n.example/"), kind, F.lit("/"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 5 == 0, spliced).otherwise(F.col("url"))
    return table(spark, sf, "pages").filter(filters.exclude_url_paths(url)).select("page_id")


# ------------------------------------------------------------------ H7, H8, I22: images and dates in every place
def _with_head(spark, sf, *variants):
    """Pages with one of the given snippets before the page's own markup (by page_id, the last case: none)."""
    pid = F.col("page_id").cast("string")
    snippet = F.lit("")
    for k, (before, after) in enumerate(variants):
        snippet = F.when(F.col("page_id") % (len(variants) + 1) == k, F.concat(F.lit(before), pid, F.lit(after))).otherwise(snippet)
    return table(spark, sf, "pages").select("page_id", F.concat(snippet, F.col("html")).alias("html"))


@register("h7_image_variants", sql="""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://i.example/og' || page_id WHEN 1 THEN 'https://i.example/rev' || page_id
                                 WHEN 2 THEN '/img/' || page_id || '.png' ELSE '' END AS image FROM pages
""")
def h7_image_variants(spark, sf):
    p = _with_head(spark, sf, ('<meta property="og:image" content="https://i.example/og', '"><img src="/other.png">'),
                   ("<meta content='https://i.example/rev", "' property='og:image'>"), ('<img alt="x" src="/img/', '.png">'))
    return p.select("page_id", H.image(F.col("html")).alias("image"))


@register("h8_published_variants", sql="""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-01-0' || page_id WHEN 1 THEN '2023-05-' || page_id WHEN 2 THEN '1 May 2022 ' || page_id
                                 WHEN 3 THEN 'on 2021 ' || page_id ELSE '' END AS published FROM pages
""")
def h8_published_variants(spark, sf):
    p = _with_head(spark, sf, ('<meta property="article:published_time" content="2024-01-0', '"><time>2029</time>'),
                   ('<meta name="pubdate" content="2023-05-', '">'), ("<time>no year</time><time>1 May 2022 ", "</time>"),
                   ("<span>no year</span><span>on 2021 ", "</span>"))
    return p.select("page_id", H.published(F.col("html")).alias("published"))


@register("i22_display_image_variants", sql=f"""
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'https://i.example/' || page_id WHEN 3 THEN '/i/' || page_id || '.jpeg'
                                 ELSE '{T.PLACEHOLDER_IMAGE}' END AS image, md5(html) AS page FROM pages
""")
def i22_display_image_variants(spark, sf):
    """The image that a page names, from its whole markup, or the placeholder: not a number, a url, too short, a path, none."""
    p = _with_head(spark, sf, ('<img alt="', '" src="NaN">'), ('<img src="https://i.example/', '">'), ('<img alt="', '" src="a.pn">'),
                   ('<meta property="og:image" content="/i/', '.jpeg">'))
    own = F.regexp_replace("html", "(?s)^.*?(?=<!DOCTYPE)", "")   # the page behind the snippet
    return p.select("page_id", T.display_image(H.image(F.col("html"))).alias("image"), F.md5(own).alias("page"))


# ------------------------------------------------------------------ H1, H2, H5: nested and class-marked containers
OWN = "(?s)<article>(.*)</article>"   # the given pages hold one article each


def _nested(spark, sf, opening: str, closing: str):
    """A page's own article, split by nested elements and surrounded by paragraphs that do not belong to it."""
    pid = F.col("page_id").cast("string")
    junk = ('<div class="related"><div><p>see also this other story</p></div><p>and one more story here</p></div>'
            '<nav><nav><p>menu in a menu here</p></nav><p>menu after the menu</p></nav>')
    page = F.concat(F.lit('<html><body><p>outside words before it</p>' + opening + '<div><p>lead of page '), pid,
                    F.lit('</p><div class="quote"><p>someone said a few words</p></div></div><div class="own">'),
                    F.regexp_extract("html", OWN, 1), F.lit('</div>' + junk + '<p>tail of page '), pid,
                    F.lit('</p>' + closing + '<p>outside words after it</p>'), F.regexp_extract("html", "(?s)<footer>.*$", 0))
    return table(spark, sf, "pages").select("page_id", page.alias("html"))


def _story_sql(before: str = "", after: str = "") -> str:
    own = f"array_to_string({paragraphs_sql('own')}, ' ')"
    return f"""
WITH o AS (SELECT page_id, regexp_extract(html, {sq(OWN)}, 1) AS own FROM pages)
SELECT page_id, {_strip_sql(f"'{before}lead of page ' || page_id || ' someone said a few words ' || {own} || ' tail of page ' || page_id || '{after}'")} AS text
FROM o
"""


NESTED_SQL = _story_sql()


@register("h2_container_by_class", sql=NESTED_SQL)
def h2_container_by_class(spark, sf):
    p = _nested(spark, sf, '<div class="wide newsStory">', "</div>")
    return p.select("page_id", HT.article_text(F.col("html")).alias("text"))


@register("h2_container_by_id", sql=NESTED_SQL)
def h2_container_by_id(spark, sf):
    p = _nested(spark, sf, '<section id="articleBody"><section>', "</section></section>")
    return p.select("page_id", HT.article_text(F.col("html")).alias("text"))


@register("h2_container_nested_article", sql=NESTED_SQL)
def h2_container_nested_article(spark, sf):
    p = _nested(spark, sf, "<article><article></article>", "</article>")
    return p.select("page_id", HT.article_text(F.col("html")).alias("text"))


@register("h1_nested_junk_removed", sql=_story_sql("outside words before it ", " outside words after it"))
def h1_nested_junk_removed(spark, sf):
    p = _nested(spark, sf, "<section>", "</section>")
    return p.select("page_id", F.array_join(H.paragraphs(HT.remove_junk_nested(F.col("html"))), " ").alias("text"))


@register("h5_merge_class_blocks", sql=f"""
WITH o AS (SELECT page_id, {_collapse_sql(get_text_sql(f"regexp_extract(html, {sq(OWN)}, 1)"))} AS own FROM pages)
SELECT page_id, {_collapse_sql("'block one of ' || page_id || ' inner words ' || own || ' block two of ' || page_id")} AS text FROM o
""")
def h5_merge_class_blocks(spark, sf):
    pid = F.col("page_id").cast("string")
    page = F.concat(F.lit('<body><p>before</p><div class="DetialsNews"><p>block one of '), pid,
                    F.lit('</p><div>inner <b>words</b></div></div><p>between</p><div class="DetialsNews big">'),
                    F.regexp_extract("html", OWN, 1), F.lit('</div><p>again</p><div class="DetialsNews"> block  two of '), pid,
                    F.lit("</div><p>after</p>"))
    return table(spark, sf, "pages").select("page_id", HT.merged_blocks(page).alias("text"))


# ------------------------------------------------------------------ I9, I16, I17: Arabic, dates and consent phrases
ARABIC = "إِنَّ الأخبارَ في المدينةِ على "   # with hamza forms, marks, ta marbuta and alef maqsura
ARABIC_PLAIN = "ان الاخبار في المدينه علي "


@register("i16_normalize_arabic", sql=f"""
SELECT doc_id, md5({_strip_sql(f"'{ARABIC_PLAIN}' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}_{T.WS[1:-1]}]', ' ', 'g')")}) AS h
FROM documents
""")
def i16_normalize_arabic(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.normalize_arabic(F.concat(F.lit(ARABIC), F.col("text")))).alias("h"))


@register("i17_is_rtl_mixed", sql="""
SELECT doc_id, doc_id % 3 = 0 AS rtl FROM documents
""")
def i17_is_rtl_mixed(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(ARABIC))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.is_rtl(text).alias("rtl"))


@register("i9_consent_and_dates", sql=f"""
WITH c AS (SELECT doc_id, 'On 12/05/2024 doc ' || coalesce(text, '') || ' ends' AS t FROM documents)
SELECT doc_id, md5({_collapse_sql("'On 12/05/2024 doc ' || doc_id || ' ends'")}) AS raw,
       md5({_collapse_sql(f"regexp_replace(t, {sq('(?i)' + T.DATE_PATTERN)}, ' ', 'g')")}) AS cleaned FROM c
""")
def i9_consent_and_dates(spark, sf):
    """A date before the whole text goes, and so does everything from a consent phrase behind it on."""
    raw = F.concat(F.lit("On 12/05/2024 doc "), F.col("doc_id").cast("string"), F.lit(" ends"))
    whole = F.concat(F.lit("On 12/05/2024 doc "), F.coalesce("text", F.lit("")), F.lit(" ends"))
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" TCF vendor "), F.col("text"))).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(raw).alias("raw"), F.md5(
        T.clean_text_remove_dates(F.concat(whole, F.coalesce(tail, F.lit(""))))).alias("cleaned"))


# ------------------------------------------------------------------ K4, E18, C8: every label occurs, two models
def _toned(spark, sf):
    """News whose text begins with words of a tone that follows from the id."""
    tone = F.when(F.col("id") % 3 == 0, F.lit("great success and growth ")).when(F.col("id") % 3 == 1, F.lit("crisis war loss "))
    n = news(spark, sf).select("id", "sentiment", "language", F.concat(F.coalesce(tone, F.lit("")), "full_text").alias("full_text"))
    return n


TONED_CTE = """
toned AS (SELECT id, sentiment, language, CASE id % 3 WHEN 0 THEN 'great success and growth ' WHEN 1 THEN 'crisis war loss '
                                                      ELSE '' END || full_text AS full_text FROM news)"""
TONED_LEXICON = LEXICON_CTE.replace("FROM news)", "FROM toned)")


@register("k4_classify_toned", sql=f"""
WITH {NEWS_CTE}, {TONED_CTE}, {TONED_LEXICON}
SELECT id, label FROM k
""")
def k4_classify_toned(spark, sf):
    return enrich.classify(_toned(spark, sf), "full_text", "language").select("id", "label")


class AlwaysPositive:
    """A second model for the routing query."""

    def __call__(self, texts: list[str]) -> list[str]:
        return ["Positive"] * len(texts)


@register("c8_language_routing", sql=f"""
WITH {NEWS_CTE}, {TONED_CTE}, {TONED_LEXICON}
SELECT k.id, CASE WHEN k.language = 'de' AND length({_strip_sql("coalesce(toned.full_text, '')")}) >= 30 THEN 'positive' ELSE label END AS label
FROM k JOIN toned USING (id)
""")
def c8_language_routing(spark, sf):
    models = {"en": enrich.LexiconClassifier, "de": AlwaysPositive}
    return enrich.classify(_toned(spark, sf), "full_text", "language", models=models).select("id", "label")


@register("e18_metrics_toned", sql=f"""
WITH {NEWS_CTE}, {TONED_CTE}, {TONED_LEXICON},
y AS (SELECT lower(sentiment) AS y, label AS p FROM k),
c AS (SELECT l, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER (y = l) AS sup, count(*) FILTER (p = l) AS pp
      FROM y, (VALUES ('positive'), ('negative'), ('neutral')) t(l) GROUP BY l),
f AS (SELECT CASE WHEN sup + pp > 0 THEN 2.0 * tp / (sup + pp) ELSE 0 END AS f1 FROM c)
SELECT (SELECT count(*) FROM y) AS n, round((SELECT count(*) FILTER (y = p) * 1.0 / count(*) FROM y), 6) AS accuracy,
       round((SELECT sum(f1) / 3 FROM f), 6) AS macro_f1
""")
def e18_metrics_toned(spark, sf):
    c = enrich.classify(_toned(spark, sf), "full_text", "language")
    ids = labels.label_ids(labels.label_ids(c, "sentiment", "y"), "label", "p")
    return labels.classification_metrics(ids, "y", "p")


# ------------------------------------------------------------------ G2, G3: unions of outlets and of labelled samples
@register("g2_union_outlets", sql="""
SELECT doc_id AS id, source, text AS body, CASE WHEN lang = 'de' THEN n_chars END AS n_chars
FROM documents WHERE lang IN ('en', 'de', 'fr')
""")
def g2_union_outlets(spark, sf):
    """Outlet feeds of different shape are united by column name; columns an outlet lacks are null."""
    d = table(spark, sf, "documents")
    feeds = [d.filter("lang = 'en'").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("body")),
             d.filter("lang = 'de'").select(F.col("text").alias("body"), "n_chars", F.col("doc_id").alias("id"), "source"),
             d.filter("lang = 'fr'").select("source", F.col("text").alias("body"), F.col("doc_id").alias("id"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds).select("id", "source", "body", "n_chars")


@register("g3_union_samples", sql="""
SELECT doc_id, lang, 'hand' AS origin FROM documents JOIN labels USING (doc_id)
UNION ALL
SELECT doc_id, lang, 'model' FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r
  FROM documents) WHERE r <= 25
""")
def g3_union_samples(spark, sf):
    """Hand-labelled rows and a balanced sample are concatenated, rows of both kept."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    hand = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id").withColumn("origin", F.lit("hand"))
    sample = ranking.balanced_sample(d, "lang", 25, id_col="doc_id", seed=42).select("doc_id", "lang")
    return hand.unionByName(sample.withColumn("origin", F.lit("model")))


# ------------------------------------------------------------------ I3: the output string of the Arabic date normaliser
@register("i3_arabic_date_string", sql="""
SELECT event_id, strftime(timezone('Africa/Cairo', ts AT TIME ZONE 'UTC'), '%A, %d %B %Y – %H:%M') AS s FROM events
""")
def i3_arabic_date_string(spark, sf):
    from newsloom.plans.datesq import _events, arabic_rendering
    e = _events(spark, sf).withColumn("a", arabic_rendering(F.col("ts")))
    return D.with_arabic_date(e, "a", "s").select("event_id", "s")
