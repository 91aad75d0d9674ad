"""Headline query: the dashboard's fetch, filter and feed as one DataFrame plan.

Filters are written before the sort/limit so Catalyst pushes them below the
top-k (and into the scan when they touch stored columns) — unlike the
reference, which filters dates after the limit (Q15).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import filters, ranking

SORTS = {
    "newest": lambda: [F.col("published_ts").desc_nulls_last(), F.col("id").asc()],
    "oldest": lambda: [F.col("published_ts").asc_nulls_last(), F.col("id").asc()],
    "source": lambda: [F.col("source").asc_nulls_last(), F.col("id").asc()],
}


def sort_order(sort: str) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}")
    return SORTS[sort]()


@dataclass
class HeadlineQuery:
    """Parameters of one dashboard request (the sidebar state)."""

    now: str
    days: int = 30
    limit: int | None = 5000   # None: every row that passes the filters
    search: str | None = None
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    sort: str = "newest"

    def frame(self, news: DataFrame) -> DataFrame:
        """Projected, searched, normalised, recency- and facet-filtered rows (no limit)."""
        df = filters.headline_projection(news, keep=["published_ts"])
        df = filters.search_filter(df, self.search)
        df = filters.normalise(df)
        df = filters.recency_filter(df, self.now, self.days)
        return filters.facet_filter(df, self.filters)

    def fetch(self, news: DataFrame) -> DataFrame:
        """newest ``limit`` rows after all filters."""
        if self.limit is None:
            return self.frame(news)
        return ranking.global_cap(self.frame(news), sort_order("newest"), self.limit)

    def feed_page(self, news: DataFrame, page_no: int, per_page: int) -> DataFrame:
        """F6 + F7: one page of the chosen sort (per_page capped at 200)."""
        per_page = min(int(per_page), 200)
        return ranking.page(self.fetch(news), sort_order(self.sort), page_no, per_page)
