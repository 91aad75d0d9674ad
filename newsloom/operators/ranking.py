"""Window / ranking / sort / limit / sampling operators.

Skew notes:
* first/last-N per group use ``row_number() <= N``; Spark inserts a partial
  WindowGroupLimit before the shuffle, so a hot group ships at most N rows
  per input partition.
* ``sequential_ids`` numbers rows 1..N in a stated order without a global
  single-partition window: a range-partitioned sort, a per-partition count
  (one row per partition) and an offset join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import ensure_checkpoint_dir


def first_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int,
                      rank_col: str = "pos_in_group") -> DataFrame:
    """first ``n`` rows of each group in ``order`` (apply filters before or after)."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def global_cap(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """first ``n`` rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[Column], page_no: int, per_page: int) -> DataFrame:
    """one page (1-based) of ``per_page`` rows in ``order``."""
    per_page = max(1, int(per_page))
    return df.orderBy(*order).offset((max(1, int(page_no)) - 1) * per_page).limit(per_page)


def page_count(df: DataFrame, per_page: int) -> DataFrame:
    """``max(1, ceil(n / per_page))`` as a one-row frame."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(per_page))).cast("long").alias("pages"),
                  F.count(F.lit(1)).alias("rows"))


def sequential_ids(df: DataFrame, order: Sequence[Column], col: str = "seq", start: int = 1,
                   checkpoint: bool = True) -> DataFrame:
    """number rows ``start..start+N-1`` in ``order`` without one big task.

    The sorted frame is checkpointed (reliable, to ``spark.checkpoint.dir``)
    so the counts and the numbering see the same partitions even if an
    executor is lost and a stage recomputes.
    """
    spark = df.sparkSession
    sorted_df = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        sorted_df = sorted_df.checkpoint(eager=True)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # One row per partition: a bounded frame, safe to broadcast.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = sorted_df.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid")
    return out.withColumn(col, (F.col("_off") + F.col("_mid") - F.col("_m0") + F.lit(start)).cast("long")).drop(
        "_pid", "_mid", "_off", "_m0")


def first_wins(df: DataFrame, key: str | Sequence[str], order_col: str, last: bool = False) -> DataFrame:
    """D1/D2/D3 core: keep one row per key, the first (or last) in ``order_col``.

    A hash aggregate of ``min_by(struct(row), order)``: map-side partial
    aggregation collapses a hot key to one row per input partition before the
    shuffle, so no task ever holds a whole group.  A null order key counts as
    latest for first-wins and as earliest for last-wins; ties go to the row of
    smallest (largest) hash.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    has_order = F.col(order_col).isNotNull() if last else F.col(order_col).isNull()
    hashed = [f.name for f in df.schema.fields if f.name not in keys and "map" not in f.dataType.simpleString()]
    rank = F.struct(has_order.alias("n"), F.col(order_col).alias("o"), F.xxhash64(*hashed).alias("h"))
    agg = df.groupBy(*keys).agg(pick(F.struct(*others), rank).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def hash_order(id_col: Column, seed: int) -> Column:
    """Repeatable pseudo-random order key: md5 of ``id || ':' || seed``."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def balanced_sample(df: DataFrame, group: str, n: int, id_col: str = "id", seed: int = 42,
                    check: bool = True) -> DataFrame:
    """F8: exactly ``n`` rows per group in a seeded hash order; error if a group is short.

    The count check is one small aggregate (one row per group) read by the
    driver; the sample itself is a group-limited window.
    """
    if check:
        short = (df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < n)
                 .limit(5).collect())
        if short:
            raise ValueError(f"groups with fewer than {n} rows: {[(r[0], r[1]) for r in short]}")
    key = hash_order(F.col(id_col), seed)
    return first_n_per_group(df.withColumn("_h", key), group, [F.col("_h"), F.col(id_col)], n,
                             "sample_rank").drop("_h")


def hash_bucket(id_col: Column, seed: int, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the first 8 hex digits of the seeded md5."""
    return (F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split_train_test(df: DataFrame, id_col: str = "id", seed: int = 42, train_pct: int = 80) -> DataFrame:
    """repeatable split column ``split in ('train','test')`` by hash bucket."""
    b = hash_bucket(F.col(id_col), seed)
    return df.withColumn("split", F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))
