"""Flatten nested API items into article rows.

Struct and array access only: ``coalesce``/``nullif`` reproduce Python's
``a or b`` (empty string is falsy), higher-order ``filter`` finds the first
contributor tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import html as H
from newsloom.functions.text import py_strip


def _truthy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def explode_results(df: DataFrame, path: str = "response.results") -> DataFrame:
    """One row per element of an API response's results array."""
    return df.select(F.explode(F.col(path)).alias("item")).select("item.*")


def normalize_guardian(items: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Guardian item -> raw article.

    summary = (trailText or standfirst or bodyText[:180] + '...') if bodyText else None (Q8).
    """
    f = F.col("fields")
    body = _truthy(f.getField("bodyText"))
    summary = F.when(body.isNotNull(), F.coalesce(_truthy(f.getField("trailText")), _truthy(f.getField("standfirst")),
                                                  F.concat(F.substring(body, 1, 180), F.lit("..."))))
    author = F.coalesce(
        F.try_element_at(F.filter(F.col("tags"), lambda t: t.getField("type") == "contributor"), F.lit(1)).getField("webTitle"),
        f.getField("byline"))
    return items.select(
        F.lit("theguardian").alias("source"), F.lit("en").alias("language"),
        F.coalesce(_truthy(F.col("sectionName")), _truthy(F.col("section"))).alias("category"),
        F.col("webTitle").alias("title"), F.col("webUrl").alias("url"), summary.alias("summary"),
        F.coalesce(body, _truthy(f.getField("body"))).alias("full_text"),
        _truthy(f.getField("thumbnail")).alias("image_url"),
        D.long_form(F.col("webPublicationDate")).alias("published_date"),
        (scraped_at if scraped_at is not None else D.iso_utc(F.current_timestamp())).alias("scraped_at"),
        author.alias("author"),
    )


def normalize_nyt(items: DataFrame, category: Column, scraped_at: Column | None = None) -> DataFrame:
    """NYT item -> raw article; image from multimedia[0] else media[0]['media-metadata'][-1]."""
    mm = F.col("multimedia")
    media = F.col("media")
    first_meta = F.try_element_at(media, F.lit(1)).getField("media-metadata")
    image = (F.when(F.coalesce(F.size(mm), F.lit(0)) > 0, F.try_element_at(mm, F.lit(1)).getField("url"))
              .when(F.coalesce(F.size(media), F.lit(0)) > 0, F.try_element_at(first_meta, F.lit(-1)).getField("url")))
    return items.select(
        F.lit("nytimes").alias("source"), F.lit("en").alias("language"), category.alias("category"),
        "title", "url", F.col("abstract").alias("summary"), F.lit(None).cast("string").alias("full_text"),
        image.alias("image_url"), F.col("published_date"),
        (scraped_at if scraped_at is not None else D.iso_utc(F.current_timestamp())).alias("scraped_at"),
    )


def rss_items(items: DataFrame, exclude_paths: bool = True) -> DataFrame:
    """RSS rows -> (title, url, summary, published_date, published_ts); summary is the
    description's text (tags dropped, entities decoded, stripped)."""
    out = items.select(
        py_strip(F.coalesce("title", F.lit(""))).alias("title"),
        py_strip(F.coalesce("link", F.lit(""))).alias("url"),
        py_strip(H.decode_entities(F.regexp_replace(F.coalesce("description", F.lit("")), H.TAG_RE, ""))).alias("summary"),
        py_strip(F.coalesce("pubDate", F.lit(""))).alias("published_date"),
    )
    out = out.filter(F.col("url") != "")
    if exclude_paths:
        out = out.filter(~F.col("url").rlike("/(live|av|videos)/"))
    return D.with_parsed_date(out, "published_date", "published_ts", "UTC")
