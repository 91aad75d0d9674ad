from pyspark.sql import functions as F

from newsloom.operators import filters
from newsloom.plans.headlines import HeadlineQuery


def frame(spark):
    rows = [(1, "50% off sale", None, "src1", None, "Positive", "2024-01-10 10:00:00"),
            (2, "a_b test", "summary two", None, "c", "NEGATIVE", "2024-01-19 10:00:00"),
            (3, "axb", "has 50 percent", "src1", "c", "neutral", "2023-11-01 00:00:00"),
            (4, "newest", "x", "src2", "c", "positive", "2024-01-19 23:00:00")]
    df = spark.createDataFrame(rows, "ID long, Title string, summary string, source string, category string, "
                                     "sentiment string, ts string")
    return df.withColumn("published_ts", F.to_timestamp("ts")).drop("ts")


def test_projection_is_case_insensitive_with_typed_nulls(spark):
    out = filters.headline_projection(frame(spark))
    assert out.columns[:3] == ["id", "title", "summary"]
    assert dict(out.dtypes)["embedding"] == "array<float>" and dict(out.dtypes)["url"] == "string"
    assert out.filter(F.col("url").isNotNull()).count() == 0


def test_search_is_literal_and_case_insensitive(spark):
    df = filters.headline_projection(frame(spark))
    assert [r.id for r in filters.search_filter(df, "50%").collect()] == [1]
    assert [r.id for r in filters.search_filter(df, "A_B").collect()] == [2]


def test_headline_query_filters_before_limit(spark):
    q = HeadlineQuery(now="2024-01-20 00:00:00", days=30, limit=2,
                      filters={"sentiments": ["positive", "negative"]})
    got = [r.id for r in q.fetch(frame(spark)).collect()]
    assert got == [4, 2]                        # newest first, old row 3 dropped by the date filter
    norm = q.frame(frame(spark)).orderBy("id").collect()
    assert norm[0].summary == "" and norm[1].source == "Unknown"   # real null defaults (Q4)
    page = q.feed_page(frame(spark), page_no=2, per_page=1).collect()
    assert [r.id for r in page] == [2]


def test_dashboard_panels_all_build(spark):
    from newsloom.plans.common import news
    from newsloom.plans.dashboard import dashboard_panels
    from tests.conftest import SF001
    q = HeadlineQuery(now="2024-01-20 00:00:00", days=30, limit=100)
    panels = dashboard_panels(news(spark, SF001), q)
    assert panels["kpis"].first().total == panels["feed"].count() <= 100
    for name, df in panels.items():
        df.limit(1).collect()
