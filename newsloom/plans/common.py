"""Shared plan pieces: the news adapter and its analysis frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators import adapt, filters
from newsloom.sources.tables import table


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.news_view(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def viz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's analysis frame over the news adapter."""
    return filters.enrich_for_analysis(news(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt.event_news(table(spark, sf_dir, "events"))
