"""Seek paging over a stored order.

``store`` sorts a selection once, writes it as folders of consecutive positions (``block``) and keeps the number of
rows; a page is then a filter on positions that opens the one or two blocks it lies in, in place of a sort and an
``offset`` over everything for every page.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.operators import ranking

BLOCK_ROWS = 100_000
SIZE = "n long, block_rows long, row_schema string"


def store(df: DataFrame, order: Sequence[Column], path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write ``df`` in ``order`` (which should be total) with its positions from 0."""
    numbered = ranking.sequential_ids(df, order, col="pos", start=0)
    blocks = numbered.withColumn("block", F.floor(F.col("pos") / block_rows).cast("long"))
    blocks.repartition("block").sortWithinPartitions("pos").write.partitionBy("block").parquet(f"{path}/rows")
    spark = df.sparkSession
    n = spark.read.schema(blocks.schema).parquet(f"{path}/rows").count()
    spark.createDataFrame([(n, block_rows, blocks.schema.json())], SIZE).coalesce(1).write.parquet(f"{path}/size")


def page(spark: SparkSession, path: str, page_no: int, per_page: int) -> DataFrame:
    """Page ``page_no`` (from 1) in the stored order; pages beyond the last one are empty."""
    size = spark.read.schema(SIZE).parquet(f"{path}/size").first()
    first = (max(1, int(page_no)) - 1) * max(1, int(per_page))
    last = min(first + max(1, int(per_page)), size.n) - 1
    rows = spark.read.schema(StructType.fromJson(json.loads(size.row_schema))).parquet(f"{path}/rows")
    here = F.col("block").between(first // size.block_rows, max(last, 0) // size.block_rows)
    return rows.filter(here & F.col("pos").between(first, last)).orderBy("pos").drop("block")


def pages(spark: SparkSession, path: str, per_page: int) -> int:
    n = spark.read.schema(SIZE).parquet(f"{path}/size").first().n
    return max(1, -(-n // max(1, int(per_page))))
