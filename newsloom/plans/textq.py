"""Registered text-function and n-gram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ngrams
from newsloom.plans.registry import register
from newsloom.sources.tables import table

WS = T.WS
SW_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse_sql(x: str) -> str:
    return _strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@register("e16_top_keywords", sql=f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM documents),
c AS (SELECT keyword, count(*) AS count FROM w
      WHERE length(keyword) >= 4 AND keyword NOT IN ({SW_SQL}) AND NOT regexp_full_match(keyword, '\\p{{Nd}}+')
      GROUP BY keyword)
SELECT keyword, count, row_number() OVER (ORDER BY count DESC, keyword) AS rank
FROM c ORDER BY count DESC, keyword LIMIT 15
""")
def e16_top_keywords(spark, sf):
    return ngrams.top_keywords(_docs(spark, sf), "text", 15)


@register("e17_top_bigrams", sql=f"""
WITH t AS (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents),
p AS (SELECT unnest(list_zip(list_slice(t, 1, greatest(len(t) - 1, 0)), list_slice(t, 2, len(t)))) AS p
      FROM t WHERE len(t) > 1),
k AS (SELECT p[1] AS w1, p[2] AS w2 FROM p),
c AS (SELECT w1 || ' ' || w2 AS phrase, count(*) AS count FROM k
      WHERE length(w1) >= 3 AND length(w2) >= 3 AND w1 NOT IN ({SW_SQL}) AND w2 NOT IN ({SW_SQL})
      GROUP BY 1)
SELECT phrase, count, row_number() OVER (ORDER BY count DESC, phrase) AS rank
FROM c ORDER BY count DESC, phrase LIMIT 15
""")
def e17_top_bigrams(spark, sf):
    return ngrams.top_bigrams(_docs(spark, sf), "text", 15)


@register("f11_cross_document_bigrams", sql="""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id) AS seq, t FROM t WHERE len(t) > 0)
SELECT a.t[-1] AS w1, b.t[1] AS w2 FROM s a JOIN s b ON b.seq = a.seq + 1
""")
def f11_cross_document_bigrams(spark, sf):
    return ngrams.bigrams_across_documents(_docs(spark, sf), "text", [F.col("doc_id")])


@register("i7_collapse_whitespace", sql=f"""
SELECT doc_id, md5({_collapse_sql('text')}) AS h, length({_collapse_sql('text')}) AS n FROM documents
""")
def i7_collapse_whitespace(spark, sf):
    c = T.collapse_ws(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(c).alias("h"), F.length(c).alias("n"))


PHRASES = ["the ", "le ", "der ", "el "]


@register("i8_remove_phrases_in_order", sql="""
SELECT doc_id, md5(replace(replace(replace(replace(text, 'the ', ''), 'le ', ''), 'der ', ''), 'el ', '')) AS h
FROM documents
""")
def i8_remove_phrases_in_order(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.remove_phrases(F.col("text"), PHRASES)).alias("h"))


@register("i9_hard_stop_and_dates", sql=f"""
WITH c AS (SELECT doc_id, split_part(split_part(text, '. ', 1), chr(10), 1) AS t FROM documents)
SELECT doc_id, {_collapse_sql("regexp_replace(t, '(\\d{1,2}/\\d{1,2}/\\d{2,4})', ' ', 'g')")} AS t FROM c
""")
def i9_hard_stop_and_dates(spark, sf):
    t = T.cut_at_first(F.col("text"), [". ", "\n"])
    t = T.collapse_ws(F.regexp_replace(t, r"(\d{1,2}/\d{1,2}/\d{2,4})", " "))
    return _docs(spark, sf).select("doc_id", t.alias("t"))


def _split_marked(x: str, with_newlines: bool) -> str:
    s = f"regexp_replace({x}, '([.?!؟]){WS}+', '\\1' || chr(1), 'g')"
    if with_newlines:
        s = f"regexp_replace({s}, '\\n+', chr(1), 'g')"
    return f"string_split({s}, chr(1))"


LEAD_SQL = f"""
WITH a AS (SELECT doc_id, {_split_marked('text', True)} AS parts FROM documents),
b AS (SELECT doc_id, substr(array_to_string(list_filter(list_transform(parts, lambda x: {_strip_sql('x')}),
                                                         lambda x: x <> ''), ' '), 1, 800) AS joined FROM a)
SELECT doc_id, {_strip_sql(f"array_to_string(list_slice({_split_marked('joined', False)}, 1, 3), ' ')")} AS summary
FROM b
"""


@register("i12_lead_summary", sql=LEAD_SQL)
def i12_lead_summary(spark, sf):
    return _docs(spark, sf).select("doc_id", T.lead_summary(F.col("text")).alias("summary"))


@register("i13_lead_summary_variant", sql=f"""
WITH a AS (SELECT doc_id, text, {_split_marked('text', True)} AS parts FROM documents),
b AS (SELECT doc_id, parts,
             substr(array_to_string(list_filter(list_transform(parts, lambda x: {_strip_sql('x')}),
                                                lambda x: x <> ''), ' '), 1, 1600) AS chosen FROM a)
SELECT doc_id,
       CASE WHEN len(parts) <= 3 THEN substr({_strip_sql(_collapse_sql("array_to_string(parts, ' ')"))}, 1, 800)
            ELSE {_collapse_sql(f"array_to_string(list_slice({_split_marked('chosen', False)}, 1, 3), ' ')")} END AS summary
FROM b
""")
def i13_lead_summary_variant(spark, sf):
    return _docs(spark, sf).select("doc_id", T.lead_summary_variant(F.col("text")).alias("summary"))


@register("i14_head_tail_truncation", sql="""
SELECT doc_id,
       md5(CASE WHEN length(text) > 1500
                THEN substr(text, 1, 1000) || chr(10) || '... [middle removed] ...' || chr(10) || substr(text, length(text) - 499)
                ELSE text END) AS h
FROM documents
""")
def i14_head_tail_truncation(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.head_tail(F.col("text"))).alias("h"))


@register("i15_prefix_truncation", sql="""
SELECT doc_id, substr(text, 1, 100) AS p100, substr(text, 1, 300) || '...' AS p300, md5(substr(text, 1, 3000)) AS h3000
FROM documents
""")
def i15_prefix_truncation(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", T.prefix(t, 100).alias("p100"), T.prefix(t, 300, "...").alias("p300"),
                                   F.md5(T.prefix(t, 3000)).alias("h3000"))


@register("i16_normalize_text", sql=f"""
SELECT doc_id, md5({_strip_sql(
    "regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '[\\x{0617}-\\x{061A}\\x{064B}-\\x{0652}]', '', 'g'), "
    "'[إأآا]', 'ا', 'g'), 'ى', 'ي'), 'ة', 'ه'), "
    f"'[^\\p{{L}}\\p{{N}}_{WS[1:-1]}]', ' ', 'g')")}) AS h
FROM documents
""")
def i16_normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.normalize_arabic(F.col("text"))).alias("h"))


@register("i17_is_rtl", sql="""
SELECT conv_id, turn, coalesce(regexp_matches(text, '[\\x{0600}-\\x{06FF}]'), false) AS rtl FROM conversations
""")
def i17_is_rtl(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_rtl(F.col("text")).alias("rtl"))


@register("i18_highlight", sql="""
SELECT doc_id, md5(
  replace(replace(
    replace(replace(replace(replace(replace(
      regexp_replace(text, '(?i)(\\Qthe\\E)', chr(1) || '\\1' || chr(2), 'g'),
      '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
    chr(1), '<mark>'), chr(2), '</mark>')) AS marked_md5
FROM documents
""")
def i18_highlight(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.highlight(F.col("text"), "the")).alias("marked_md5"))


MODEL_OUT_SQL = """CASE role WHEN 'assistant' THEN 'SUMMARY: ' || text || ' SENTIMENT: Positive'
                  WHEN 'system' THEN 'SENTIMENT: Negative' ELSE text END"""


def _model_out():
    return (F.when(F.col("role") == "assistant",
                   F.concat(F.lit("SUMMARY: "), F.col("text"), F.lit(" SENTIMENT: Positive")))
             .when(F.col("role") == "system", F.lit("SENTIMENT: Negative")).otherwise(F.col("text")))


@register("i20_parse_model_output", sql=f"""
WITH m AS (SELECT conv_id, turn, text, {_strip_sql(MODEL_OUT_SQL)} AS o FROM conversations),
p AS (SELECT conv_id, turn, text, o,
             CASE WHEN contains(o, 'SUMMARY:') THEN {_strip_sql("split_part(split_part(o, 'SUMMARY:', 2), 'SENTIMENT:', 1)")}
                  ELSE '' END AS s,
             CASE WHEN contains(o, 'SUMMARY:') AND contains(split_part(o, 'SUMMARY:', 2), 'SENTIMENT:')
                    THEN {_strip_sql("split_part(split_part(o, 'SUMMARY:', 2), 'SENTIMENT:', 2)")}
                  WHEN NOT contains(o, 'SUMMARY:') AND contains(o, 'SENTIMENT:')
                    THEN {_strip_sql("split_part(o, 'SENTIMENT:', 2)")}
                  ELSE 'Neutral' END AS sentiment
      FROM m)
SELECT conv_id, turn, CASE WHEN length(s) < 10 THEN substr(text, 1, 300) || '...' ELSE s END AS summary, sentiment
FROM p
""")
def i20_parse_model_output(spark, sf):
    c = table(spark, sf, "conversations")
    r = T.parse_model_output(_model_out(), F.col("text"))
    return c.select("conv_id", "turn", r.summary.alias("summary"), r.sentiment.alias("sentiment"))


JSON_IN_SQL = """CASE role
  WHEN 'assistant' THEN '```json{"summary": "' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || '", "sentiment": "Positive"}```'
  WHEN 'system' THEN '{"summary": "' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || '", "senti'
  ELSE text END"""


def _json_in():
    clean = F.regexp_replace(F.col("text"), "[^A-Za-z ]", "")
    return (F.when(F.col("role") == "assistant",
                   F.concat(F.lit('```json{"summary": "'), clean, F.lit('", "sentiment": "Positive"}```')))
             .when(F.col("role") == "system", F.concat(F.lit('{"summary": "'), clean, F.lit('", "senti')))
             .otherwise(F.col("text")))


@register("i21_repair_model_json", sql=f"""
WITH a AS (SELECT conv_id, turn, {_strip_sql(JSON_IN_SQL)} AS t0 FROM conversations),
b AS (SELECT conv_id, turn,
             CASE WHEN contains(t0, '```') THEN {_strip_sql("replace(replace(t0, '```json', ''), '```', '')")} ELSE t0 END AS t
      FROM a),
c AS (SELECT conv_id, turn, t, CASE WHEN coalesce(json_valid(t), false) THEN json_type(t) = 'OBJECT' ELSE false END AS ok FROM b)
SELECT conv_id, turn,
  CASE WHEN t = '' THEN ''
       WHEN ok THEN coalesce(json_extract_string(t, '$.summary'), '')
       ELSE replace(regexp_extract(t, '(?s)"summary"\\s*:\\s*"(.*?)"', 1), '"', '''') END AS summary,
  CASE WHEN t = '' THEN 'Neutral'
       WHEN ok THEN coalesce(json_extract_string(t, '$.sentiment'), 'Neutral')
       WHEN regexp_matches(t, '(?s)"sentiment"\\s*:\\s*"(.*?)"') THEN regexp_extract(t, '(?s)"sentiment"\\s*:\\s*"(.*?)"', 1)
       ELSE 'Neutral' END AS sentiment
FROM c
""")
def i21_repair_model_json(spark, sf):
    c = table(spark, sf, "conversations")
    r = T.repair_json(_json_in())
    return c.select("conv_id", "turn", r.summary.alias("summary"), r.sentiment.alias("sentiment"))


@register("i22_display_image", sql=f"""
WITH i AS (SELECT page_id, regexp_extract(html, '<img[^>]+src="([^"]*)"', 1) AS img FROM pages)
SELECT page_id, CASE WHEN img IS NULL OR lower(img) IN ('nan', 'none', '', 'null') OR length(img) <= 5
                     THEN '{T.PLACEHOLDER_IMAGE}' ELSE img END AS image
FROM i
""")
def i22_display_image(spark, sf):
    p = table(spark, sf, "pages")
    img = F.regexp_extract("html", r'<img[^>]+src="([^"]*)"', 1)
    return p.select("page_id", T.display_image(img).alias("image"))


@register("i23_softmax_argmax", sql="""
WITH l AS (SELECT vec_id, list_slice(embedding, 1, 3) AS z FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM l),
p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e)
SELECT vec_id, list_position(pr, list_max(pr)) - 1 AS label, round(list_max(pr), 6) AS prob FROM p
""")
def i23_softmax_argmax(spark, sf):
    e = table(spark, sf, "embeddings")
    pr = T.softmax(F.slice("embedding", 1, 3))
    return e.select("vec_id", T.argmax(pr).alias("label"), F.round(F.array_max(pr), 6).alias("prob"))


@register("i24_short_text_default_label", sql=f"""
SELECT conv_id, turn, CASE WHEN length({_strip_sql("coalesce(text, '')")}) < 30 THEN 'neutral' ELSE role END AS label
FROM conversations
""")
def i24_short_text_default_label(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.short_text_label(F.col("text"), F.col("role")).alias("label"))
