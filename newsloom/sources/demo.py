"""Demo rows for running the dashboard plans without a news table.

Generated by ``spark.range`` (distributed) with dimensions cycled by id and
one row every ``step_hours`` back from ``now``.  Not registered as a query:
it reads no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Invented dimension values, cycled by id.
SOURCES = ["Harbour Post", "Valley Courier", "The Lantern", "Delta Wire", "Quarry Times"]
CATEGORIES = ["Weather", "Science", "Travel", "Law"]
SENTIMENTS = ["neutral", "negative", "positive"]
LANGUAGES = ["en", "ar"]


def demo_rows(spark: SparkSession, now: str, n: int = 20, step_hours: int = 2) -> DataFrame:
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id0") % len(values) + 1).cast("int"))

    ts = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), (F.col("id0") * step_hours).cast("int"))
    return spark.range(n).withColumnRenamed("id", "id0").select(
        (F.col("id0") + 1).alias("id"),
        F.concat(F.lit("Sample row no. "), (F.col("id0") + 1).cast("string")).alias("title"),
        F.concat(F.lit("https://img.example/"), F.col("id0").cast("string"), F.lit(".png")).alias("image_url"),
        F.concat(F.lit("Sample row about "), F.lower(pick(CATEGORIES)), F.lit(".")).alias("summary"),
        pick(SOURCES).alias("source"), pick(CATEGORIES).alias("category"), pick(SENTIMENTS).alias("sentiment"),
        F.lit("#").alias("url"), pick(LANGUAGES).alias("language"), ts.alias("published_ts"),
    )
