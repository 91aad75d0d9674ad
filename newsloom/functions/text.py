"""Scalar text functions as Column expressions.

Everything here is built from ``pyspark.sql.functions`` so it runs inside
whole-stage codegen; no Python UDF.  Whitespace follows Python's Unicode
``str.split``/``strip`` rule (ASCII whitespace, U+001C..U+001F, U+0085 and
the Unicode separators) through one explicit character class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Whitespace class equal to Python's str.isspace() set (valid in Java and RE2).
WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"

# Phrases that start a cookie-consent banner (hard stop), in the reference's order.
COOKIE_JUNK_STARTERS = [
    "Some vendors may process your personal data",
    "Welcome Your personal data",
    "You can choose how your personal data is used",
    "TCF vendor",
    "Consent Manage options",
]

# Date-like fragments removed after the hard stop (case-insensitive).
DATE_PATTERN = (r"(\d{1,2}/\d{1,2}/\d{2,4}.*?\d{1,2}:\d{2}:\d{2})|"
                r"(\d{1,2}/\d{1,2}/\d{2,4})|"
                r"(آخر تحديث.*?)|"
                r"(قبل\s+\d+\s+(ساعة|دقائق?|دقيقة|ثانية))")

# Junk phrases removed anywhere in a page's text, in order ("تابع" sits inside "تابعونا").
JUNK_PHRASES = [
    "تابع بوابة الجمهورية", "اترك تعليق", "التصنيفات", "يمكنك مشاركة الخبر", "ShareFacebook",
    "ShareFacebookTwitterWhatsApp", "تابعونا", "تابع", "جوجل نيوز", "Google News", "Subscribe",
    "تابع بوابة", "تابع بوابة الجمهورية اون لاين", "تابع بوابة الجمهورية", "تابع بوابة",
    "مشاركة", "ترك تعليق",
]

# Boilerplate removed from article text by the Arabic processor.
PROCESSOR_NOISE = ["تم التصميم والتطوير بواسطة", "الموضوعات المتعلقة", "اقرأ أيضا"]

# Stopwords (English, Arabic, common news terms).
STOPWORDS = [
    "the", "and", "in", "of", "to", "a", "is", "for", "on", "with",
    "at", "by", "from", "it", "as", "an", "that",
    "في", "من", "على", "إلى", "عن", "مع", "هذا", "هذه",
    "أن", "كان", "ما", "لا", "لم", "التي", "الذي", "بين",
    "news", "report", "daily", "update", "latest", "breaking",
    "today", "year", "after", "before", "when", "where",
]

MIDDLE_MARKER = "\n... [middle removed] ...\n"
PLACEHOLDER_IMAGE = "https://placehold.co/150x100/2D3748/A0AEC0?text=No+Image"
INVALID_IMAGE_VALUES = ["nan", "none", "", "null"]
# Sentence boundary: after . ? ! or the Arabic question mark, or a run of newlines.
SENTENCE_SPLIT = r"(?<=[.?!؟])" + WS + r"+|\n+"
SENTENCE_SPLIT_PUNCT = r"(?<=[.?!؟])" + WS + r"+"
# ------------------------------------------------------------------------------


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def collapse_ws(col: Column) -> Column:
    """``' '.join(text.split())``."""
    return py_strip(F.regexp_replace(col, f"{WS}+", " "))


def remove_phrases(col: Column, phrases: Sequence[str], replacement: str = "") -> Column:
    """I8: literal replacements applied in list order (order matters)."""
    out = col
    for p in phrases:
        out = F.replace(out, F.lit(p), F.lit(replacement))
    return out


def cut_at_first(col: Column, phrases: Sequence[str] = COOKIE_JUNK_STARTERS) -> Column:
    """I9 (hard stop): keep the text before the earliest occurrence of any phrase."""
    out = col
    for p in phrases:
        out = F.substring_index(out, p, 1)
    return out


def clean_text_remove_dates(col: Column) -> Column:
    """Hard stop at consent phrases, blank out date-like fragments, collapse whitespace."""
    t = cut_at_first(F.coalesce(col, F.lit("")))
    t = F.regexp_replace(t, "(?iu)" + DATE_PATTERN, " ")
    return collapse_ws(t)


def cleanup_junk(col: Column, phrases: Sequence[str] = JUNK_PHRASES) -> Column:
    """Collapse whitespace, replace each junk phrase by a space, collapse again."""
    t = collapse_ws(F.coalesce(col, F.lit("")))
    return collapse_ws(remove_phrases(t, phrases, " "))


def sentences(col: Column, pattern: str = SENTENCE_SPLIT) -> Column:
    return F.split(col, pattern, -1)


def _join_stripped(arr: Column) -> Column:
    return F.array_join(F.filter(F.transform(arr, py_strip), lambda s: s != ""), " ")


def lead_summary(col: Column, max_sentences: int = 3, max_chars: int = 800) -> Column:
    """First ``max_sentences`` sentences of the first ``max_chars`` of cleaned text."""
    t = F.coalesce(col, F.lit(""))
    joined = F.substring(_join_stripped(sentences(t)), 1, max_chars)
    pieces = F.slice(sentences(joined, SENTENCE_SPLIT_PUNCT), 1, max_sentences)
    return py_strip(F.array_join(pieces, " "))


def lead_summary_variant(col: Column, max_sentences: int = 3, phrases: Sequence[str] = ()) -> Column:
    """<= max_sentences pieces -> cleaned text[:800]; else first sentences of [:1600]."""
    t = F.coalesce(col, F.lit(""))
    parts = sentences(t)
    clean = (lambda c: cleanup_junk(c, phrases)) if phrases else collapse_ws
    short = F.substring(py_strip(clean(F.array_join(parts, " "))), 1, 800)
    chosen = F.substring(_join_stripped(parts), 1, 1600)
    long_ = clean(F.array_join(F.slice(sentences(chosen, SENTENCE_SPLIT_PUNCT), 1, max_sentences), " "))
    return F.when(F.size(parts) <= max_sentences, short).otherwise(long_)


def head_tail(col: Column, limit: int = 1500, head: int = 1000, tail: int = 500,
              marker: str = MIDDLE_MARKER) -> Column:
    """Text longer than ``limit`` -> first ``head`` + marker + last ``tail`` chars."""
    return F.when(F.length(col) > limit,
                  F.concat(F.substring(col, 1, head), F.lit(marker), F.substring(col, -tail, tail))
                  ).otherwise(col)


def prefix(col: Column, n: int, ellipsis: str = "") -> Column:
    """First ``n`` characters (+ optional suffix)."""
    out = F.substring(col, 1, n)
    return F.concat(out, F.lit(ellipsis)) if ellipsis else out


def normalize_arabic(col: Column) -> Column:
    """I16: drop diacritics, unify alef/ya/ta-marbuta, punctuation -> space, strip; null -> ''."""
    t = F.regexp_replace(col, r"[\x{0617}-\x{061A}\x{064B}-\x{0652}]", "")
    t = F.regexp_replace(t, "[إأآا]", "ا")
    t = F.replace(t, F.lit("ى"), F.lit("ي"))
    t = F.replace(t, F.lit("ة"), F.lit("ه"))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_" + WS[1:-1] + "]", " ")
    return F.coalesce(py_strip(t), F.lit(""))


def is_rtl(col: Column) -> Column:
    """Any character in U+0600..U+06FF; non-strings false."""
    return F.coalesce(col.rlike(r"[\x{0600}-\x{06FF}]"), F.lit(False))


def html_escape(col: Column) -> Column:
    """``html.escape(s, quote=True)``."""
    t = F.replace(col, F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    t = F.replace(t, F.lit(">"), F.lit("&gt;"))
    t = F.replace(t, F.lit('"'), F.lit("&quot;"))
    return F.replace(t, F.lit("'"), F.lit("&#x27;"))


def highlight(col: Column, term: str | None) -> Column:
    """Case-insensitive literal matches wrapped in <mark>, the rest HTML-escaped (Q20).

    Matches are found in the raw text, marked with two control characters,
    the text is escaped, then the marks become tags.
    """
    if not term:
        return col
    quoted = term.replace("\\E", "\\E\\\\E\\Q")
    marked = F.regexp_replace(col, f"(?iu)(\\Q{quoted}\\E)", "\u0001$1\u0002")
    esc = html_escape(marked)
    return F.replace(F.replace(esc, F.lit("\u0001"), F.lit("<mark>")), F.lit("\u0002"), F.lit("</mark>"))


def stopwords() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def parse_model_output(output: Column, source_text: Column) -> Column:
    """struct(summary, sentiment) from 'SUMMARY: ... SENTIMENT: ...' text.

    Default sentiment Neutral; a summary shorter than 10 characters becomes
    the first 300 characters of the source text + '...'.
    """
    txt = py_strip(F.coalesce(output, F.lit("")))
    has_sum = F.contains(txt, F.lit("SUMMARY:"))
    has_sent = F.contains(txt, F.lit("SENTIMENT:"))
    after_sum = F.split_part(txt, F.lit("SUMMARY:"), F.lit(2))
    summary = F.when(has_sum, py_strip(F.split_part(after_sum, F.lit("SENTIMENT:"), F.lit(1)))).otherwise(F.lit(""))
    sent_in_sum = F.contains(after_sum, F.lit("SENTIMENT:"))
    sentiment = (F.when(has_sum & sent_in_sum, py_strip(F.split_part(after_sum, F.lit("SENTIMENT:"), F.lit(2))))
                  .when(~has_sum & has_sent, py_strip(F.split_part(txt, F.lit("SENTIMENT:"), F.lit(2))))
                  .otherwise(F.lit("Neutral")))
    fallback = F.concat(F.substring(F.coalesce(source_text, F.lit("")), 1, 300), F.lit("..."))
    summary = F.when(F.length(summary) < 10, fallback).otherwise(summary)
    return F.struct(summary.alias("summary"), sentiment.alias("sentiment"))


def repair_json(output: Column) -> Column:
    """struct(summary, sentiment) from model JSON: strip fences, parse, else regex.

    Null/blank input -> ('', 'Neutral').
    """
    t = py_strip(F.coalesce(output, F.lit("")))
    t = F.when(F.contains(t, F.lit("```")),
               py_strip(F.replace(F.replace(t, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))).otherwise(t)
    v = F.try_parse_json(t)
    parsed_ok = v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT"))
    j_sum = F.try_variant_get(v, "$.summary", "string")
    j_sent = F.try_variant_get(v, "$.sentiment", "string")
    r_sum = F.regexp_extract(t, r'(?s)"summary"\s*:\s*"(.*?)"', 1)
    r_sent_found = t.rlike(r'(?s)"sentiment"\s*:\s*"(.*?)"')
    r_sent = F.when(r_sent_found, F.regexp_extract(t, r'(?s)"sentiment"\s*:\s*"(.*?)"', 1)).otherwise(F.lit("Neutral"))
    summary = F.when(parsed_ok, F.coalesce(j_sum, F.lit(""))).otherwise(F.replace(r_sum, F.lit('"'), F.lit("'")))
    sentiment = F.when(parsed_ok, F.coalesce(j_sent, F.lit("Neutral"))).otherwise(r_sent)
    blank = t == ""
    return F.struct(F.when(blank, F.lit("")).otherwise(summary).alias("summary"),
                    F.when(blank, F.lit("Neutral")).otherwise(sentiment).alias("sentiment"))


def display_image(col: Column, placeholder: str = PLACEHOLDER_IMAGE) -> Column:
    """Invalid or too-short image url -> placeholder."""
    bad = col.isNull() | F.lower(col).isin(*INVALID_IMAGE_VALUES) | (F.length(col) <= 5)
    return F.when(bad, F.lit(placeholder)).otherwise(col)


def softmax(logits: Column) -> Column:
    """Softmax of an array of logits (max-shifted for stability)."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def short_text_label(text: Column, label: Column, min_chars: int = 30, default: str = "neutral") -> Column:
    """Stripped text shorter than ``min_chars`` -> default label."""
    return F.when(F.length(py_strip(F.coalesce(text, F.lit("")))) < min_chars, F.lit(default)).otherwise(label)
