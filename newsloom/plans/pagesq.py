"""Registered page-extraction queries over ``pages``.

The DuckDB oracles are generated from the same regular-expression constants
as the Spark expressions (RE2 accepts every pattern used here).  Numeric
entities are decoded only on the Spark side; the driver pages contain none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as T
from newsloom.plans.registry import register
from newsloom.plans.textq import _collapse_sql, _split_marked, _strip_sql
from newsloom.sources.tables import table


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {sq(pattern)}, {sq(repl)}, 'g')"


def remove_junk_sql(x: str) -> str:
    h = rx_replace(f"coalesce({x}, '')", H.COMMENT_RE)
    for t in H.JUNK_TAGS:
        h = rx_replace(h, H.element_re(t), " ")
    for t in H.JUNK_CLASS_TAGS:
        h = rx_replace(h, H.class_element_re(t), " ")
    return h


def inner_sql(x: str, tag: str) -> str:
    return f"regexp_extract({x}, {sq(H.inner_re(tag))}, 1)"


def container_sql(x: str) -> str:
    parts = ", ".join(f"nullif({inner_sql(x, t)}, '')" for t in ("article", "main", "body"))
    return f"coalesce({parts}, {x})"


def decode_sql(x: str) -> str:
    out = x
    for ent, ch in H.NAMED_ENTITIES:
        out = f"replace({out}, {sq(ent)}, {sq(ch)})"
    return out


def get_text_sql(x: str, sep: str = " ") -> str:
    nodes = f"string_split_regex({rx_replace(x, H.COMMENT_RE)}, {sq(H.TAG_RE)})"
    return (f"array_to_string(list_filter(list_transform({nodes}, lambda n: {_strip_sql(decode_sql('n'))}), "
            f"lambda n: n <> ''), {sq(sep)})")


def paragraphs_sql(x: str, sep: str = " ") -> str:
    pieces = f"string_split_regex({x}, {sq(H.P_OPEN_RE)})"
    after = f"list_slice({pieces}, 2, len({pieces}))"
    cut = f"regexp_replace(p, {sq(H.P_END_RE)}, '')"
    texts = f"list_transform({after}, lambda p: {get_text_sql(cut, sep)})"
    return f"list_filter({texts}, lambda t: t <> '')"


def pages(spark, sf):
    return table(spark, sf, "pages")


@register("h1_remove_junk_elements", sql=f"""
SELECT page_id, md5({remove_junk_sql('html')}) AS h FROM pages
""")
def h1_remove_junk_elements(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(H.remove_junk(F.col("html"))).alias("h"))


@register("h2_content_container", sql=f"""
WITH c AS (SELECT page_id, {remove_junk_sql('html')} AS h FROM pages)
SELECT page_id, md5({container_sql('h')}) AS h FROM c
""")
def h2_content_container(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(H.container(H.remove_junk(F.col("html")))).alias("h"))


PARA_SQL = f"""
WITH c AS (SELECT page_id, {container_sql(remove_junk_sql('html'))} AS c FROM pages)
SELECT page_id, {_strip_sql(f"array_to_string({paragraphs_sql('c')}, ' ')")} AS text FROM c
"""


@register("h3_page_paragraph_text", sql=PARA_SQL)
def h3_page_paragraph_text(spark, sf):
    return pages(spark, sf).select("page_id", H.paragraph_text(F.col("html")).alias("text"))


@register("h3_paragraph_text_nosep", sql=PARA_SQL.replace(paragraphs_sql("c"), paragraphs_sql("c", "")))
def h3_paragraph_text_nosep(spark, sf):
    return pages(spark, sf).select("page_id", H.paragraph_text(F.col("html"), sep="").alias("text"))


def keep_sql(t: str) -> str:
    words = f"len(list_filter(string_split_regex({t}, {sq('[' + T.WS[1:-1] + ']+')}), lambda w: w <> ''))"
    cond = [f"{words} >= 4"] + [f"NOT contains({t}, {sq(p)})" for p in T.COOKIE_JUNK_STARTERS]
    cond += [f"NOT contains(lower({t}), {sq(k)})" for k in H.JUNK_PARAGRAPH_KEYWORDS]
    return " AND ".join(cond)


@register("h4_paragraph_filter", sql=f"""
WITH c AS (SELECT page_id, {container_sql(remove_junk_sql('html'))} AS c FROM pages)
SELECT page_id, {_strip_sql(f"array_to_string(list_filter({paragraphs_sql('c')}, lambda p: {keep_sql('p')}), ' ')")} AS text
FROM c
""")
def h4_paragraph_filter(spark, sf):
    return pages(spark, sf).select(
        "page_id", H.paragraph_text(F.col("html"), filtered=True, junk_phrases=T.COOKIE_JUNK_STARTERS).alias("text"))


@register("h5_merge_blocks", sql=f"""
WITH b AS (SELECT page_id, regexp_extract_all({remove_junk_sql('html')}, {sq(H.inner_re('article'))}, 1) AS blocks FROM pages)
SELECT page_id, {_collapse_sql(f"array_to_string(list_filter(list_transform(blocks, lambda x: {_collapse_sql(get_text_sql('x'))}), lambda t: t <> ''), ' ')")} AS text
FROM b
""")
def h5_merge_blocks(spark, sf):
    return pages(spark, sf).select("page_id", H.merged_blocks(F.col("html")).alias("text"))


@register("h6_title_fallback", sql=f"""
SELECT page_id, coalesce({", ".join(f"nullif({get_text_sql(inner_sql('html', t))}, '')" for t in ("h1", "title", "h3"))}, '') AS title
FROM pages
""")
def h6_title_fallback(spark, sf):
    return pages(spark, sf).select("page_id", H.title(F.col("html")).alias("title"))


def meta_sql(x: str, attr: str, value: str) -> str:
    a = (rf"(?is)<meta\b[^>]*\b{attr}\s*=\s*[\"']{value}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"']")
    b = (rf"(?is)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\b{attr}\s*=\s*[\"']{value}[\"']")
    return f"coalesce(nullif(regexp_extract({x}, {sq(a)}, 1), ''), regexp_extract({x}, {sq(b)}, 1))"


@register("h7_image", sql=f"""
SELECT page_id, coalesce(nullif({meta_sql('html', 'property', 'og:image')}, ''),
                         regexp_extract(html, {sq(r"(?is)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']*)[\"']")}, 1)) AS image
FROM pages
""")
def h7_image(spark, sf):
    return pages(spark, sf).select("page_id", H.image(F.col("html")).alias("image"))


@register("h9_links_in_order", sql=f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, {sq(r'(?i)<a\s[^>]*href="([^"]*)"')}, 1)) AS href,
                  unnest(range(1, len(regexp_extract_all(html, {sq(r'(?i)<a\s[^>]*href="([^"]*)"')}, 1)) + 1)) AS i
           FROM pages),
n AS (SELECT page_id, i,
             CASE WHEN {_strip_sql('href')} = '' THEN ''
                  WHEN starts_with({_strip_sql('href')}, '//') THEN 'https:' || {_strip_sql('href')}
                  WHEN starts_with({_strip_sql('href')}, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || {_strip_sql('href')}
                  WHEN NOT starts_with({_strip_sql('href')}, 'http') THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || {_strip_sql('href')}
                  ELSE {_strip_sql('href')} END AS link
      FROM a),
v AS (SELECT page_id, link, min(i) AS first_i FROM n
      WHERE link <> '' AND NOT starts_with(link, 'javascript:') AND NOT starts_with(link, '#')
        AND (regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) = ''
             OR contains(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), 'example'))
      GROUP BY page_id, link)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS pos, link FROM v
""")
def h9_links_in_order(spark, sf):
    p = pages(spark, sf)
    links = F.transform(H.hrefs(F.col("html")), lambda h: H.normalize_url(h, F.col("url")))
    valid = F.array_distinct(F.filter(links, lambda u: H.valid_article_url(u, site_token="example")))
    return p.select("page_id", F.posexplode(valid).alias("pos", "link")).select(
        "page_id", (F.col("pos") + 1).alias("pos"), "link")


@register("h10_strip_html", sql=f"""
SELECT page_id, {_collapse_sql(decode_sql(rx_replace(inner_sql('html', 'footer'), H.TAG_RE)))} AS text FROM pages
""")
def h10_strip_html(spark, sf):
    return pages(spark, sf).select("page_id", H.strip_html(H.inner(F.col("html"), "footer")).alias("text"))


@register("i11_amp_url", sql="""
SELECT page_id, CASE WHEN ends_with(url, '/') THEN url || 'amp' ELSE url || '/amp' END AS amp FROM pages
""")
def i11_amp_url(spark, sf):
    return pages(spark, sf).select("page_id", H.amp_url(F.col("url")).alias("amp"))


@register("b17_valid_article_url", sql="""
SELECT page_id,
       url <> '' AND NOT starts_with(url, 'javascript:') AND NOT starts_with(url, '#')
       AND (regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) = ''
            OR contains(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), '.example.com'))
       AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '/[a-z]{2}/\\d+$') AS valid
FROM pages
""")
def b17_valid_article_url(spark, sf):
    return pages(spark, sf).select(
        "page_id", H.valid_article_url(F.col("url"), ".example.com", r"/[a-z]{2}/\d+$").alias("valid"))


@register("b10_exclude_video_pages", sql="""
SELECT page_id FROM pages WHERE NOT coalesce(regexp_matches(url, '/(live|av|videos)/'), false)
  AND regexp_matches(url, '^https?://')
""")
def b10_exclude_video_pages(spark, sf):
    from newsloom.operators.filters import exclude_url_paths
    return pages(spark, sf).filter(exclude_url_paths(F.col("url")) & F.col("url").rlike("^https?://")).select("page_id")


def article_rows(p):
    """Landing page -> article row (title, text, image, date, summary), short pages rejected."""
    from newsloom.functions import html_tree as HT
    body = T.clean_text_remove_dates(HT.article_text(F.coalesce("html", F.lit("")), filtered=True,
                                                     junk_phrases=T.COOKIE_JUNK_STARTERS))
    rows = p.select("page_id", "url", H.title(F.col("html")).alias("title"), body.alias("full_text"),
                    H.image(F.col("html")).alias("image_url"), H.published(F.col("html")).alias("published_date"))
    rows = rows.withColumn("summary", T.lead_summary(F.col("full_text")))
    return rows.filter(F.length("full_text") >= 80)


@register("a21_pages_to_articles", sql=f"""
WITH c AS (SELECT page_id, url, html, {container_sql(remove_junk_sql('html'))} AS c FROM pages),
t AS (SELECT page_id, url, html,
             {_strip_sql(f"array_to_string(list_filter({paragraphs_sql('c')}, lambda p: {keep_sql('p')}), ' ')")} AS body
      FROM c),
d AS (SELECT page_id, url, html,
             {_collapse_sql(rx_replace("split_part(split_part(split_part(split_part(split_part(body, 'Some vendors may process your personal data', 1), 'Welcome Your personal data', 1), 'You can choose how your personal data is used', 1), 'TCF vendor', 1), 'Consent Manage options', 1)", "(?i)" + T.DATE_PATTERN, " "))} AS full_text
      FROM t),
s AS (SELECT *, {_split_marked('full_text', True)} AS parts FROM d),
j AS (SELECT *, substr(array_to_string(list_filter(list_transform(parts, lambda x: {_strip_sql('x')}), lambda x: x <> ''), ' '), 1, 800) AS joined FROM s)
SELECT page_id, url,
       coalesce({", ".join(f"nullif({get_text_sql(inner_sql('html', t))}, '')" for t in ("h1", "title", "h3"))}, '') AS title,
       full_text,
       {_strip_sql(f"array_to_string(list_slice({_split_marked('joined', False)}, 1, 3), ' ')")} AS summary
FROM j WHERE length(full_text) >= 80
""")
def a21_pages_to_articles(spark, sf):
    return article_rows(pages(spark, sf)).select("page_id", "url", "title", "full_text", "summary")


@register("h8_published_date", sql=f"""
WITH t AS (SELECT page_id, html,
                  list_filter(list_transform(regexp_extract_all(html, {sq(H.inner_re('time'))}, 1), lambda x: {get_text_sql('x', '')}),
                              lambda x: contains(x, '202')) AS tt,
                  list_filter(list_transform(regexp_extract_all(html, {sq(H.inner_re('span'))}, 1), lambda x: {get_text_sql('x', '')}),
                              lambda x: contains(x, '202')) AS ss
           FROM pages)
SELECT page_id, coalesce(nullif({meta_sql('html', 'property', 'article:published_time')}, ''),
                         nullif({meta_sql('html', 'name', 'pubdate')}, ''), nullif(tt[1], ''), nullif(ss[1], ''), '') AS published
FROM t
""")
def h8_published_date(spark, sf):
    return pages(spark, sf).select("page_id", H.published(F.col("html")).alias("published"))


@register("h3_paragraph_text_tree_junk", sql=PARA_SQL)
def h3_paragraph_text_tree_junk(spark, sf):
    """Paragraph text after the tree-aware junk pass (agrees with the regex rule on un-nested pages)."""
    from newsloom.functions import html_tree as HT
    cleaned = HT.remove_junk_nested(F.col("html"))
    paras = H.paragraphs(H.container(cleaned))
    return pages(spark, sf).select("page_id", T.py_strip(F.array_join(paras, " ")).alias("text"))
