"""Catalog helpers: table discovery, creation, additive migration, append.

``spark.catalog`` and DDL replace the reference's database plumbing; errors
surface instead of being swallowed into an empty frame (Q5).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import ranking

# Preferred table names, in lookup order.
CANDIDATE_TABLES = ["news", "articles", "news_articles", "processed_news"]

NEWS_DDL_COLUMNS = [
    ("id", "BIGINT"), ("source", "STRING"), ("language", "STRING"), ("category", "STRING"),
    ("title", "STRING"), ("url", "STRING"), ("summary", "STRING"), ("full_text", "STRING"),
    ("image_url", "STRING"), ("published_date", "STRING"), ("scraped_at", "STRING"),
    ("published_ts", "TIMESTAMP"), ("scraped_ts", "TIMESTAMP"), ("sentiment", "STRING"),
    ("embedding", "ARRAY<FLOAT>"), ("inserted_at", "TIMESTAMP"),
]


def find_table(spark: SparkSession, candidates: Sequence[str] = CANDIDATE_TABLES,
               include_temporary: bool = True) -> tuple[str, list[str]] | None:
    """First existing candidate, else the first table/view (by name) whose name contains 'news'."""
    for name in candidates:
        if spark.catalog.tableExists(name):
            return name, [c.name for c in spark.catalog.listColumns(name)]
    for t in sorted(spark.catalog.listTables(), key=lambda t: t.name):
        if "news" in t.name.lower() and (include_temporary or not t.isTemporary):
            return t.name, [c.name for c in spark.catalog.listColumns(t.name)]
    return None


def query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Parameterised SQL (named ``:param`` markers), no string interpolation."""
    return spark.sql(sql, args=dict(args or {}))


def ensure_table(spark: SparkSession, name: str, location: str,
                 columns: Sequence[tuple[str, str]] = NEWS_DDL_COLUMNS) -> list[str]:
    """Create the parquet table if missing, then add any missing columns (additive only)."""
    cols = ", ".join(f"{c} {t}" for c, t in columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{location}'")
    have = {c.name.lower() for c in spark.catalog.listColumns(name)}
    missing = [(c, t) for c, t in columns if c.lower() not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'{c} {t}' for c, t in missing)})")
    return [c.name for c in spark.catalog.listColumns(name)]


def with_generated_ids(rows: DataFrame, current_max: Column | int, order: Sequence[Column],
                       id_col: str = "id", now: str | None = None) -> DataFrame:
    """Ids continuing after ``current_max`` in ``order`` + load time."""
    numbered = ranking.sequential_ids(rows, list(order), col="_n")
    base = current_max if isinstance(current_max, Column) else F.lit(int(current_max))
    ts = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    return numbered.withColumn(id_col, (F.col("_n") + base).cast("long")).withColumn("inserted_at", ts).drop("_n")


def append_rows(spark: SparkSession, name: str, rows: DataFrame, order: Sequence[Column], now: str | None = None) -> DataFrame:
    """Append with generated ids after the table's max id; columns aligned by name."""
    current = spark.table(name).select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    out = with_generated_ids(rows.drop("id"), current, order, now=now)
    target = [c.name for c in spark.catalog.listColumns(name)]
    aligned = out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in target])
    aligned.write.insertInto(name)
    return aligned
