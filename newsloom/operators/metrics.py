"""Dashboard aggregates over an analysis frame.

Inputs carry ``sentiment_lower``, ``date``, ``hour``, ``weekday``,
``source`` and ``category`` (see ``filters.enrich_for_analysis``).  Every
aggregate is a hash aggregate with a map-side partial step, so a hot key is
combined before the shuffle.  Top-k reports use ``orderBy().limit()``, which
Spark plans as a per-partition top-k (TakeOrderedAndProject); ties are broken
by key ascending (Q12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
SENTIMENT_ORDER = ("positive", "neutral", "negative")
WEEKDAY_ORDER = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _is(label: str) -> Column:
    return F.col("sentiment_lower") == label


def _pct(num: Column, den: Column, scale: float = 100.0) -> Column:
    return F.coalesce(F.try_divide(num * F.lit(scale), den), F.lit(0.0)).cast("double")


def sentiment_kpis(viz: DataFrame) -> DataFrame:
    """Total, pos, neg, neu, three rates (%), score; zeros on empty input."""
    agg = viz.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is("positive")).alias("positive"),
        F.count_if(_is("negative")).alias("negative"),
    )
    total = F.col("total")
    return agg.select(
        "total", "positive", "negative",
        (total - F.col("positive") - F.col("negative")).alias("neutral"),
        F.round(_pct(F.col("positive"), total), 6).alias("pos_rate"),
        F.round(_pct(F.col("negative"), total), 6).alias("neg_rate"),
        F.round(_pct(total - F.col("positive") - F.col("negative"), total), 6).alias("neu_rate"),
        F.round(_pct(F.col("positive") - F.col("negative"), total), 6).alias("sentiment_score"),
    )


def distinct_counts(viz: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct sources and categories (exact, or HyperLogLog++ at scale)."""
    fn = F.count_distinct if exact else F.approx_count_distinct
    return viz.agg(fn("source").alias("n_sources"), fn("category").alias("n_categories"))


def daily_volume(viz: DataFrame) -> DataFrame:
    """Per-day count, null dates dropped."""
    return viz.filter(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def daily_timeline(viz: DataFrame) -> DataFrame:
    """E3 + E4: per-day count and sentiment score x100 in one aggregate."""
    return (viz.filter(F.col("date").isNotNull()).groupBy("date")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.count_if(_is("positive")).alias("_p"),
                 F.count_if(_is("negative")).alias("_n"))
            .select("date", "count",
                    F.round((F.col("_p") - F.col("_n")) * 100.0 / F.col("count"), 6).alias("sentiment_score")))


def sentiment_share(viz: DataFrame) -> DataFrame:
    """E5: value counts of sentiment_lower and their share of all rows.

    The share's denominator is a window over the grouped rows (one row per
    distinct label, a handful), never over the input rows.
    """
    counts = viz.groupBy("sentiment_lower").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("sentiment_lower", "count", F.round(F.col("count") / total, 6).alias("share"))


def category_sentiment_crosstab(viz: DataFrame, labels=SENTIMENT_ORDER) -> DataFrame:
    """Category x sentiment counts forced to three columns in fixed order."""
    return (viz.groupBy("category").pivot("sentiment_lower", list(labels))
            .agg(F.count(F.lit(1))).na.fill(0, subset=list(labels))
            .select("category", *[F.col(l).cast("long").alias(l) for l in labels]))


def hourly_score(viz: DataFrame) -> DataFrame:
    """Per-hour (local time) score as a fraction."""
    return (viz.filter(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.round((F.count_if(_is("positive")) - F.count_if(_is("negative"))) / F.count(F.lit(1)), 6)
                 .alias("score")))


def mean_source_score(viz: DataFrame) -> DataFrame:
    """Macro average of per-source scores (x100); null sources dropped."""
    per_source = (viz.filter(F.col("source").isNotNull()).groupBy("source")
                  .agg(((F.count_if(_is("positive")) - F.count_if(_is("negative"))) * 100.0
                        / F.count(F.lit(1))).alias("score")))
    return per_source.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_source_score"),
                          F.count(F.lit(1)).alias("n_sources"))


def sentiment_extremes(viz: DataFrame) -> DataFrame:
    """Most positive and most negative day with its count (earliest on ties).

    A label absent from the data yields (NULL, 0).
    """
    daily = (viz.filter(F.col("date").isNotNull()).groupBy("date")
             .agg(F.count_if(_is("positive")).alias("p"), F.count_if(_is("negative")).alias("n")))
    day_key = -F.unix_date("date")
    agg = daily.agg(
        F.max_by("date", F.struct(F.col("p"), day_key)).alias("pd"), F.max("p").alias("pmax"),
        F.max_by("date", F.struct(F.col("n"), day_key)).alias("nd"), F.max("n").alias("nmax"),
    )
    return agg.select(
        F.when(F.col("pmax") > 0, F.col("pd")).alias("most_positive_date"),
        F.coalesce(F.col("pmax"), F.lit(0)).cast("long").alias("most_positive_count"),
        F.when(F.col("nmax") > 0, F.col("nd")).alias("most_negative_date"),
        F.coalesce(F.col("nmax"), F.lit(0)).cast("long").alias("most_negative_count"),
    )


def top_values(viz: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Top-n values by count (count desc, value asc) with a rank column."""
    counts = (viz.filter(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.col("count").desc(), F.col(column).asc()).limit(n)
    w = Window.orderBy(F.col("count").desc(), F.col(column).asc())
    # The window runs over at most n rows (after the limit).
    return top.withColumn("rank", F.row_number().over(w))


def top_category_trend(viz: DataFrame, n: int = 5) -> DataFrame:
    """E10 (+C5): per-day counts for the top-n categories.

    The top-n list has at most ``n`` rows, a proven bound, so it is broadcast
    into a left-semi join.
    """
    top = top_values(viz, "category", n).select("category")
    kept = viz.join(F.broadcast(top), "category", "left_semi")
    return (kept.filter(F.col("date").isNotNull()).groupBy("date", "category")
            .agg(F.count(F.lit(1)).alias("count")))


def weekday_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(WEEKDAY_ORDER)], "day_no int, weekday string")


def weekday_counts(viz: DataFrame) -> DataFrame:
    """E13 (+C6): seven rows Monday..Sunday, zero-filled."""
    counts = viz.groupBy("weekday").agg(F.count(F.lit(1)).alias("count"))
    dim = weekday_dimension(viz.sparkSession)
    return (dim.join(counts, "weekday", "left")
            .select("day_no", "weekday", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def weekend_split(viz: DataFrame) -> DataFrame:
    """Counts of Weekend (Fri/Sat) vs Weekday rows."""
    kind = F.when(F.col("is_weekend"), F.lit("Weekend")).otherwise(F.lit("Weekday"))
    return viz.filter(F.col("weekday").isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("count"))


def dimension_values(df: DataFrame, columns=("source", "category", "language")) -> DataFrame:
    """Distinct non-null values per dimension, long form.

    Long form keeps each dimension's values spread over tasks instead of one
    array in one row; no scan cap.  Callers sort with
    ``orderBy("dimension", "value")`` when they need the sorted list.
    """
    parts = [df.select(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
             .filter(F.col("value").isNotNull()).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
