"""Daily sketches, merged for any stretch of days.

One row per day holds a HyperLogLog sketch of each dimension's values and a frequent-items sketch of the keywords;
a preset (24 h, 7 or 30 days) merges the rows of its days, without reading the articles again.  New days are new rows.
The distinct counts have a relative standard error of about 1.04 / sqrt(2^LG_K); the frequent-items counts
are exact while a day has no more than ``TRACKED`` different keywords, and estimates beyond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12          # 4096 registers: about 1.6 % standard error
TRACKED = 10_000   # items that a frequent-items sketch follows


def relative_error(lg_k: int = LG_K) -> float:
    return 1.04 / (2 ** lg_k) ** 0.5


def daily(df: DataFrame, dims: Sequence[str], ts_col: str = "published_ts", lg_k: int = LG_K) -> DataFrame:
    """``(day, rows, <dim>_sketch ...)``: one row per UTC day (rows without a time left out)."""
    day = F.to_date(ts_col)
    return df.filter(F.col(ts_col).isNotNull()).groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(F.col(d).cast("string"), F.lit(lg_k)).alias(f"{d}_sketch") for d in dims])


def merged(days: DataFrame, dims: Sequence[str], now: Column, presets: Sequence[int]) -> DataFrame:
    """``(days, rows, <dim> ...)``: estimated distinct values in the last n days (today included), for every preset."""
    last = days.withColumn("age", F.datediff(F.to_date(now), F.col("day"))).filter(F.col("age") >= 0)
    each = last.withColumn("days", F.explode(F.array(*[F.lit(int(p)) for p in presets]))).filter(F.col("age") < F.col("days"))
    return each.groupBy("days").agg(F.sum("rows").alias("rows"), *[
        F.hll_sketch_estimate(F.hll_union_agg(f"{d}_sketch")).alias(d) for d in dims])


def daily_items(df: DataFrame, item_col: str, ts_col: str = "published_ts", tracked: int = TRACKED) -> DataFrame:
    """``(day, items)``: a frequent-items sketch per UTC day of a column with one item per row."""
    rows = df.filter(F.col(ts_col).isNotNull() & F.col(item_col).isNotNull())
    return rows.groupBy(F.to_date(ts_col).alias("day")).agg(
        F.call_function("approx_top_k_accumulate", F.col(item_col), F.lit(tracked)).alias("items"))


def top_items(days: DataFrame, now: Column, last_days: int, k: int, tracked: int = TRACKED) -> DataFrame:
    """``(item, count)``: the k most frequent items of the last n days, from the days' sketches.

    The sketches meet under a (constant) group key: a partition without a day in range then sends nothing, where a
    global aggregate would send an empty sketch, which Spark cannot write.
    """
    age = F.datediff(F.to_date(now), F.col("day"))
    both = days.filter((age >= 0) & (age < last_days)).groupBy(F.lit(0).alias("all")).agg(
        F.call_function("approx_top_k_combine", F.col("items"), F.lit(tracked)).alias("items"))
    return both.select(F.explode(F.call_function("approx_top_k_estimate", F.col("items"), F.lit(k))).alias("x")).select("x.item", "x.count")


def exact_top_items(df: DataFrame, days: DataFrame, item_col: str, now: Column, last_days: int, k: int, ts_col: str = "published_ts",
                    tracked: int = TRACKED, candidates: int = 1000) -> DataFrame:
    """``(item, count)`` of :func:`top_items` with exact counts, equal ones by item.

    A sketch never estimates an item below its count, and no item that it does not follow reaches its lowest estimate.
    So the k best of the ``candidates`` are the k best of all where the k-th count is above the lowest
    candidate's estimate; other days are counted whole.
    """
    found = top_items(days, now, last_days, candidates, tracked).collect()   # at most ``candidates`` rows
    age = F.datediff(F.to_date(now), F.to_date(ts_col))
    rows = df.filter((age >= 0) & (age < last_days) & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"))
    order = [F.col("count").desc(), F.col("item").asc()]
    if not found:
        return rows.groupBy("item").agg(F.count(F.lit(1)).alias("count")).orderBy(*order).limit(k)
    few = df.sparkSession.createDataFrame([(r["item"],) for r in found], rows.schema)
    best = rows.join(F.broadcast(few), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("count")).orderBy(*order).limit(k)
    counts = [(r["item"], r["count"]) for r in best.collect()]
    if len(counts) == k and counts[-1][1] > min(r["count"] for r in found):
        return df.sparkSession.createDataFrame(counts, best.schema)
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("count")).orderBy(*order).limit(k)
