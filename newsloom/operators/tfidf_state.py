"""Document frequencies carried from run to run.

Every run adds its own counts: the number of its documents and of its documents per term.  The tables of all runs add
up, so the vectors of a new batch have the weights that a recompute over everything would give, without reading an
old text again.  ``compact`` adds the runs up into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import tfidf
from newsloom.operators.seen_filter import _read

DF_SCHEMA, N_SCHEMA = "term string, df long, run string", "n long, run string"


def add_run(batch: DataFrame, path: str, run: str, id_col: str = "id", text_col: str = "text") -> None:
    """Store a run's counts; a run owns its folders, so adding it again replaces them."""
    terms = batch.select(F.explode(F.array_distinct(tfidf.tokens(F.col(text_col)))).alias("term"))
    terms.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/df/run={run}")
    batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/n/run={run}")


def frequencies(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(term, df)`` over all runs and the number of documents."""
    df = _read(spark, f"{path}/df", DF_SCHEMA).groupBy("term").agg(F.sum("df").alias("df"))
    n = _read(spark, f"{path}/n", N_SCHEMA).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return df, n


def vectors(batch: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, term, df, w)`` of a batch, weighed by the counts of all stored runs (the batch's own run among them)."""
    df, n = frequencies(batch.sparkSession, path)
    return tfidf.weighted(tfidf.term_frequencies(batch, id_col, text_col), df, F.lit(n))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the sums of all runs to a new state at ``into``."""
    df, n = frequencies(spark, path)
    df.write.parquet(f"{into}/df/run=compacted")
    spark.createDataFrame([(n,)], "n long").coalesce(1).write.parquet(f"{into}/n/run=compacted")
