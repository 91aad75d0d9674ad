"""The seen set with a stored Bloom filter.

Every run appends its new keys and a Bloom filter of them: ``HASHES`` bit places per key, kept as rows
``(word, bits)`` of 64 bits.  Filters of runs merge by or-ing the words, so the filter of all runs is one aggregate
over small rows.  A batch is tested against the merged filter first: a key with a bit missing is surely new and is
never shuffled; only the others meet the stored keys in an exact anti-join, so the result is exact.  ``compact``
rewrites the runs into one.

The merged filter is broadcast up to ``MAX_FILTER_BYTES``; a larger one is not used and the batch is joined exactly
as a whole.  All runs of a set have the same number of bits, chosen when it is made (10 bits per expected key: about
one key in a hundred is tested needlessly).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 7
BITS_PER_KEY = 10
MAX_FILTER_BYTES = 64 << 20


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:   # nothing was stored yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


class SeenSet:
    """A stored set of keys at ``path`` (a shared folder)."""

    def __init__(self, spark: SparkSession, path: str, expected_keys: int = 1_000_000) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        meta = [r.bits for r in _read(spark, f"{self.path}/meta", "bits long").collect()]
        if meta:
            self.bits = meta[0]
        else:
            self.bits = 1 << max(10, (expected_keys * BITS_PER_KEY - 1).bit_length())
            spark.createDataFrame([(self.bits,)], "bits long").coalesce(1).write.parquet(f"{self.path}/meta")

    # -- state

    def _generation(self) -> int:
        done = _read(self.spark, f"{self.path}/generations", "generation int")
        return done.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).first().g

    def keys(self, without: str | None = None) -> DataFrame:
        """The stored keys (without those of one run)."""
        stored = _read(self.spark, f"{self.path}/keys-{self._generation()}", "key string, run string")
        return (stored if without is None else stored.filter(F.col("run") != without)).select("key")

    def words(self) -> DataFrame:
        """The merged filter, one row per word with a bit set."""
        stored = _read(self.spark, f"{self.path}/filter-{self._generation()}", "word long, bits long, run string")
        return stored.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def places(self, key: Column) -> Column:
        """The bit places of a key (two hashes, combined)."""
        first, step = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(self.bits)) for seed in (1, 2))
        return F.array(*[F.pmod(first + step * F.lit(i), F.lit(self.bits)) for i in range(HASHES)])

    def add(self, new_keys: DataFrame, key: str = "key", run: str | None = None) -> DataFrame:
        """Append the keys that are not in the set (nulls left out) as one run; returns those appended.

        A run owns its folder: adding the same run again replaces it.
        """
        run, generation = run or uuid.uuid4().hex, self._generation()
        # A run that is added again must not meet its own keys: its folder is left out and replaced.
        fresh = self.unseen(new_keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct(), "key", run)
        folder = f"{self.path}/keys-{generation}/run={run}"
        fresh.write.mode("overwrite").parquet(folder)
        stored = self.spark.read.schema("key string").parquet(folder)
        self._words_of(stored).write.mode("overwrite").parquet(f"{self.path}/filter-{generation}/run={run}")
        return stored

    def _words_of(self, stored: DataFrame) -> DataFrame:
        place = stored.select(F.explode(self.places(F.col("key"))).alias("p"))
        return (place.select(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int")).alias("bit"))
                .groupBy("word").agg(F.bit_or("bit").alias("bits")))

    def compact(self) -> None:
        """Rewrite all runs as one: distinct keys and the merged filter.  Readers use the old files until it is done."""
        generation = self._generation()
        self.keys().distinct().write.mode("overwrite").parquet(f"{self.path}/keys-{generation + 1}/run=compacted")
        self.words().select("word", "bits").write.mode("overwrite").parquet(f"{self.path}/filter-{generation + 1}/run=compacted")
        self.spark.createDataFrame([(generation + 1,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    # -- tests

    def maybe_seen(self, key: Column) -> Column | None:
        """Whether the filter knows a key (surely not seen where false); ``None`` if the filter is too large."""
        if self.bits // 8 > MAX_FILTER_BYTES:
            return None
        import numpy as np

        filled = np.zeros(self.bits // 64, np.int64)
        stored = self.words().toArrow()   # at most bits / 64 rows
        filled[stored.column("word").to_numpy()] = stored.column("bits").to_numpy()
        shared = self.spark.sparkContext.broadcast(filled)

        def test(places: pa.Array) -> pa.Array:
            p = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)
            set_ = (shared.value[p >> 6].view(np.uint64) >> (p & 63).astype(np.uint64)) & np.uint64(1)
            return pa.array(set_.all(axis=1))

        # Marked as nondeterministic so that the filters on it are not pushed below it and test twice.
        return F.arrow_udf(test, "boolean").asNondeterministic()(self.places(F.coalesce(key.cast("string"), F.lit(""))))

    def unseen(self, df: DataFrame, key: str = "url", without: str | None = None) -> DataFrame:
        """Rows of ``df`` whose key is not in the set (``without`` one run); rows with a null key stay."""
        stored = self.keys(without).withColumnRenamed("key", "__seen")
        known = self.maybe_seen(F.col(key))
        if known is None:
            return df.join(stored, F.col(key).cast("string") == F.col("__seen"), "left_anti")
        tested = df.withColumn("__maybe", known & F.col(key).isNotNull())
        new = tested.filter(~F.col("__maybe")).drop("__maybe")
        asked = tested.filter(F.col("__maybe")).drop("__maybe")
        return new.unionByName(asked.join(stored, F.col(key).cast("string") == F.col("__seen"), "left_anti"))
