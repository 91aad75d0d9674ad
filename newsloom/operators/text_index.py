"""A stored trigram index for substring search.

``build`` inverts the rows stretch by stretch: a posting row holds a trigram (a run of three characters of the
lower-cased text) and the ids of the stretch's rows that hold it, so the shuffle and the sort see one row per trigram
and stretch, not one per trigram and document.  The rows are sorted by trigram inside hash buckets that are folders,
beside the number of documents per trigram.  A search reads the counts of its own trigrams, opens the buckets of the
``PROBES`` rarest only (the reader skips row groups of other trigrams by their statistics), keeps the documents that
hold all of them, and tests those with the exact ``ilike``.

A term of fewer than three characters has no trigram and is searched by a scan.  A term with a trigram that no
document holds needs no posting at all.  The exact test makes the result that of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.filters import contains_ci

GRAM = 3
BUCKETS = 64
PROBES = 4   # rarest trigrams whose postings are read
STRETCH = 2_000_000   # characters inverted at once (a longer text is a stretch of its own)


def _trigrams(term: Column) -> Column:
    """Distinct trigrams of a lower-cased search term, by code points as in the postings (a term is short)."""
    low = F.lower(term)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows (id, texts) with at most ``most`` characters, or one row with more."""
    held, size = [], 0
    for batch in batches:
        start = 0
        chars = sum(pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in batch.columns[1:])
        for i, n in enumerate(chars.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _inverted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of rows (id, lower-cased texts), each with the ids of the rows that hold it."""
    n = rows.num_rows
    texts = [t or "" for c in rows.columns[1:] for t in c.to_pylist()]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    known = np.zeros(0x110000, bool)
    known[chars] = True
    letters = np.flatnonzero(known)
    if n > 1 and len(letters) ** GRAM * n >= 2**63:   # a key would not fit; for one row it always does
        for half in (rows.slice(0, n // 2), rows.slice(n // 2)):
            yield from _inverted(half)
        return
    sizes = [len(t) for t in texts]
    text_of = np.repeat(np.arange(len(texts), dtype="int32"), sizes)
    row_of = np.repeat(np.tile(np.arange(n), rows.num_columns - 1), sizes)
    runs = max(len(chars) - (GRAM - 1), 0)
    rank, key = (np.cumsum(known) - 1)[chars], np.zeros(runs, "int64")
    for k in range(GRAM):
        key *= len(letters)
        key += rank[k:k + runs]
    key *= n
    key += row_of[:runs]
    key = key[text_of[:runs] == text_of[GRAM - 1:]]   # runs that lie within one text
    if not len(key):
        return
    key.sort()
    gram, row = np.divmod(key[np.flatnonzero(np.diff(key, prepend=-1))], n)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    code, points = gram[first], np.empty((len(first), GRAM), "<u4")
    for k in reversed(range(GRAM)):
        code, r = np.divmod(code, len(letters))
        points[:, k] = letters[r]
    joined = points.tobytes().decode("utf-32-le")
    ends = np.append(first, len(row))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column(0).combine_chunks().take(pa.array(row)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([joined[i:i + GRAM] for i in range(0, len(joined), GRAM)], pa.string()), pa.array(np.diff(ends), pa.int64()), ids],
        ["gram", "n", "ids"])


def build(df: DataFrame, path: str, text_cols: list[str], id_col: str = "id", stretch: int = STRETCH) -> None:
    """Write postings and trigram counts of the text columns (a null column holds no trigram)."""
    def invert(batches):
        for rows in _stretches(batches, stretch):
            yield from _inverted(rows)

    rows = df.select(F.col(id_col).alias("id"), *[F.lower(F.col(c)).alias(f"text_{i}") for i, c in enumerate(text_cols)])
    id_type = rows.schema["id"].dataType.simpleString()
    blocks = rows.mapInArrow(invert, f"gram string, n long, ids array<{id_type}>").withColumn("bucket", _bucket(F.col("gram")))
    (blocks.repartition("bucket", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(4))).sortWithinPartitions("bucket", "gram")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    spark = df.sparkSession
    spark.createDataFrame([(id_type,)], "id_type string").coalesce(1).write.parquet(f"{path}/meta")
    counts = _postings(spark, path).groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    id_type = spark.read.schema("id_type string").parquet(f"{path}/meta").first().id_type
    return spark.read.schema(f"gram string, n long, ids array<{id_type}>, bucket int").parquet(f"{path}/postings")


def term_grams(spark: SparkSession, term: str) -> list[tuple[str, int]]:
    """The trigrams of a term with their buckets."""
    found = spark.range(1).select(F.explode(_trigrams(F.lit(term))).alias("gram"))
    return [(r.gram, r.b) for r in found.select("gram", _bucket(F.col("gram")).alias("b")).collect()]


def candidates(spark: SparkSession, path: str, term: str, probes: int = PROBES) -> DataFrame | None:
    """Ids of the documents that hold the term's rarest trigrams; ``None`` if the term has none."""
    grams = term_grams(spark, term)
    if not grams:
        return None
    wanted, buckets = [g for g, _ in grams], sorted({b for _, b in grams})
    counts = spark.read.schema("gram string, n long, bucket int").parquet(f"{path}/counts").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    n = {r.gram: r.n for r in counts.collect()}   # one row per trigram of the term
    postings = _postings(spark, path)
    if len(n) < len(wanted):
        return postings.select(F.explode("ids").alias("id")).limit(0)
    rare = sorted(wanted, key=lambda g: (n[g], g))[:probes]
    open_buckets = sorted({b for g, b in grams if g in rare})
    hit = postings.filter(F.col("bucket").isin(open_buckets) & F.col("gram").isin(rare))
    return hit.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("id")


def search(df: DataFrame, path: str, term: str, text_cols: list[str], id_col: str = "id") -> DataFrame:
    """Rows of ``df`` (the indexed rows) with ``term`` in one of the text columns, as the scan finds them."""
    exact = F.lit(False)
    for c in text_cols:
        exact = exact | contains_ci(F.col(c), term)
    found = candidates(df.sparkSession, path, term) if term else None
    rows = df if found is None else df.join(found.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left_semi")
    return rows.filter(exact) if term else df
