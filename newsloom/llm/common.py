"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import ensure_checkpoint_dir, ship_package
from newsloom.sources.tables import table

# Letters and digits of any script; the complement separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"


# Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by its Python worker.
ARROW_ROWS = 1000
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """The shared checkpoint folder is set, Arrow batches are small, and workers can import the package."""
    ensure_checkpoint_dir(spark)
    rows = int(spark.conf.get(_ARROW_ROWS_KEY, "0"))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS_KEY, str(ARROW_ROWS))
    ship_package(spark)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, name)


def words_of(text) -> F.Column:
    """Lower-cased words of a text column as an array (null text: no words)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), "")


def utf8_size(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


BROADCAST_IDS = 2_000_000   # rows of a drop list that is broadcast (about 100 MB as a hash table); more are shuffled


def text_key(text) -> F.Column:
    """Tells rows of one id apart by their texts (null and empty texts are alike)."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(29))


def drop_rows(docs: DataFrame, gone: DataFrame, key: F.Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose (id, ``key``) is not in the two-column frame ``gone`` (null-safe on the id).

    The drop list is materialised and counted.  Up to ``BROADCAST_IDS`` rows it is broadcast, so no text is
    shuffled; a longer list is joined by shuffle.
    """
    gone = gone.select(F.col(gone.columns[0]).alias("__gone_id"), F.col(gone.columns[1]).alias("__gone_key")).distinct().checkpoint()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn("__key", key)
    same = keyed[id_col].eqNullSafe(gone["__gone_id"]) & (keyed["__key"] == gone["__gone_key"])
    return keyed.join(gone, same, "left_anti").drop("__key")


# What the running operator keeps in a worker process (vocabularies, memos): one entry, so that a worker which
# Spark reuses for the next operator does not hold the state of the one before.
_STATE: dict = {}


def worker_state(key: tuple, build: Callable):
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def release_memory() -> None:
    """Give the process's free memory back to the system."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library: nothing to trim
        pass


def trimmed(batches: Iterator) -> Iterator:
    """The batches; behind the last one the worker returns its free memory to the system."""
    yield from batches
    release_memory()


def positions_by_key(df: DataFrame, group: str, order: list, rows_per_bucket: int = 50_000,
                     key: str = "doc_id") -> DataFrame:
    """Add ``pos``: a gapless 0-based position inside each value of ``group``, without one task per group.

    ``order`` is a list of columns whose first entry is a small integer rank (rows of lower rank come
    first).  Inside a rank, rows are spread over hash buckets of ``key``; per-bucket counts are summed
    up (one row per bucket), and rows are numbered inside their bucket only.  ``df`` is read twice, so it
    should be materialised.
    """
    from pyspark.sql import Window

    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    b = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(buckets)).cast("int")
    tagged = df.withColumn("__b", F.struct(order[0].alias("r"), b.alias("b")))
    counts = tagged.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(group, "__b").orderBy(*order)
    numbered = tagged.withColumn("__rn", F.row_number().over(inner).cast("long"))
    # One offset row per (group, rank, bucket): total / rows_per_bucket rows for each group and rank.
    return (numbered.join(offsets, [group, "__b"])
            .withColumn("pos", F.col("__off") + F.col("__rn") - 1).drop("__b", "__rn", "__off"))


def hot_lookup(left: DataFrame, right: DataFrame, key: str, uses: str, total: int, hot_keys: int = 1000) -> DataFrame:
    """``left`` joined (left outer) with ``right``, which has one row per ``key``.

    ``uses`` is the number of left rows of a key.  Keys with more than ``total / hot_keys`` rows number at
    most ``hot_keys``: they are broadcast, so a key that holds a third of all rows is never shuffled to one
    task.  All other keys are joined by a shuffle.  Left rows with a null key should be kept out.
    """
    bound = max(1, total // hot_keys)
    hot = right.filter(F.col(uses) > bound)
    cold = right.filter(F.col(uses) <= bound)
    found = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return found.unionByName(rest)
