"""Projections, filters and predicates.

All of these are column expressions or ``filter``/``select`` calls, so they
stay inside whole-stage codegen and are pushed into the parquet scan where
the predicate allows it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 12 headline fields, in output order, with their types.
HEADLINE_FIELDS: list[tuple[str, T.DataType]] = [
    ("id", T.LongType()),
    ("title", T.StringType()),
    ("summary", T.StringType()),
    ("source", T.StringType()),
    ("category", T.StringType()),
    ("sentiment", T.StringType()),
    ("url", T.StringType()),
    ("language", T.StringType()),
    ("published_date", T.StringType()),
    ("scraped_at", T.StringType()),
    ("image_url", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
]

# Display defaults for missing values.
NORMALISE_DEFAULTS = {
    "title": "",
    "summary": "",
    "source": "Unknown",
    "category": "General",
    "sentiment": "neutral",
    "image_url": "",
}

WEEKEND_DAYS = ("Friday", "Saturday")
LOCAL_TZ = "Africa/Cairo"


def headline_projection(df: DataFrame, fields=HEADLINE_FIELDS, keep: Iterable[str] = ()) -> DataFrame:
    """B1: project to the fixed headline fields, matching names case-insensitively.

    Missing fields become typed NULL columns (never invalid SQL).  ``keep``
    names extra columns (e.g. an already-parsed ``published_ts``) to carry.
    """
    lookup = {c.lower(): c for c in df.columns}
    cols = []
    for name, dtype in fields:
        src = lookup.get(name.lower())
        cols.append(F.col(src).cast(dtype).alias(name) if src else F.lit(None).cast(dtype).alias(name))
    for k in keep:
        if k not in {n for n, _ in fields}:
            cols.append(F.col(lookup.get(k.lower(), k)))
    return df.select(*cols)


def escape_like(term: str) -> str:
    """Escape LIKE wildcards so a search term is a literal substring (Q6)."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(col: Column, term: str) -> Column:
    """Case-insensitive literal contains; NULL counts as no match."""
    return F.coalesce(col.ilike(f"%{escape_like(term)}%"), F.lit(False))


def search_filter(df: DataFrame, term: str | None) -> DataFrame:
    """B2: keep rows whose title or summary contains ``term`` (whichever exist)."""
    if not term:
        return df
    cols = [c for c in df.columns if c.lower() in ("title", "summary")]
    if not cols:
        return df
    pred = contains_ci(F.col(cols[0]), term)
    for c in cols[1:]:
        pred = pred | contains_ci(F.col(c), term)
    return df.filter(pred)


def recency_filter(df: DataFrame, now: str, days: int, ts_col: str = "published_ts") -> DataFrame:
    """``ts >= now - days``; ``now`` is an argument, never the clock."""
    cutoff = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(int(days)))
    return df.filter(F.col(ts_col) >= cutoff)


def facet_filter(df: DataFrame, filters: Mapping[str, Iterable[str]] | None) -> DataFrame:
    """Exact facets for sources/categories/languages, lowercase for sentiments.

    Absent or empty lists mean no filter.  ``isin`` on a literal list becomes
    an ``In``/``InSet`` predicate that the parquet reader can use.
    """
    if not filters:
        return df
    out = df
    for key, column in (("sources", "source"), ("categories", "category"), ("languages", "language")):
        values = list(filters.get(key) or [])
        if values and column in out.columns:
            out = out.filter(F.col(column).isin(values))
    sentiments = [s.lower() for s in (filters.get("sentiments") or [])]
    if sentiments:
        out = out.filter(F.lower(F.col("sentiment")).isin(sentiments))
    return out


def normalise(df: DataFrame, defaults: Mapping[str, str] = NORMALISE_DEFAULTS) -> DataFrame:
    """Real null -> default replacement (Q4), only for present columns."""
    present = {k: v for k, v in defaults.items() if k in df.columns}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in present.items()})


def local_time(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def enrich_for_analysis(df: DataFrame, ts_col: str = "published_ts", tz: str = LOCAL_TZ) -> DataFrame:
    """Date, hour, weekday name, weekend flag (Fri/Sat), sentiment_lower; drop embedding."""
    out = df.drop("embedding") if "embedding" in df.columns else df
    local = local_time(F.col(ts_col), tz)
    weekday = F.date_format(local, "EEEE")
    return out.withColumns({
        "date": F.to_date(local),
        "hour": F.hour(local),
        "weekday": weekday,
        "is_weekend": weekday.isin(*WEEKEND_DAYS),
        "sentiment_lower": F.lower(F.col("sentiment")),
    })


def sentiment_bucket(col: Column) -> Column:
    """Substring bucket used by badges and pie colours (Q7)."""
    low = F.lower(col)
    return (F.when(low.contains("pos"), F.lit("positive"))
             .when(low.contains("neg"), F.lit("negative"))
             .otherwise(F.lit("neutral")))


def exclude_url_paths(col: Column) -> Column:
    """Predicate true for urls outside /live/, /av/, /videos/."""
    return ~F.coalesce(col.rlike("/(live|av|videos)/"), F.lit(False))


def min_length(col: Column, n: int) -> Column:
    """``length(col) >= n`` (null -> false)."""
    return F.coalesce(F.length(col) >= n, F.lit(False))


def min_words(col: Column, n: int) -> Column:
    """At least ``n`` whitespace-separated words."""
    words = F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")
    return F.coalesce(F.size(words) >= n, F.lit(False))


def drop_short_text(df: DataFrame, text_col: str = "text", min_chars: int = 30) -> DataFrame:
    """Drop null text and text of ``min_chars`` characters or fewer."""
    return df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > min_chars))


def fill_category(df: DataFrame, value: str = "Uncategorized") -> DataFrame:
    """B13."""
    return df.withColumn("category", F.coalesce(F.col("category"), F.lit(value)))


def update_where(df: DataFrame, cond: Column, column: str, value: Column) -> DataFrame:
    """Conditional column update."""
    return df.withColumn(column, F.when(cond, value).otherwise(F.col(column)))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Raise before any action when columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def merged_text(summary: Column, full_text: Column) -> Column:
    """``summary + ' ' + full_text`` with null -> '' (Q23)."""
    return F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.coalesce(full_text, F.lit("")))


def article_text(full_text: Column, summary: Column) -> Column:
    """full_text if non-empty, else summary if non-empty, else NULL."""
    return F.coalesce(F.nullif(full_text, F.lit("")), F.nullif(summary, F.lit("")))
