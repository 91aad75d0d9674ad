"""Driver tables (one parquet file each) as DataFrames.

Reads are lazy; Catalyst prunes columns and pushes filters into the parquet
scan, so callers select only what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every driver table as a temp view (for ``spark.sql`` users)."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
