"""Keyword and bigram counts.

Tokens are exploded per document and counted with a hash aggregate: the
map-side partial count collapses a hot word per partition before the shuffle,
and the top-k is a per-partition TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ranking

# Python's Unicode \w run (letters, digits, underscore), after lower-casing.
WORD = r"[\p{L}\p{N}_]+"


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), 0)


def top_keywords(df: DataFrame, text_col: str, n: int = 15, min_len: int = 4) -> DataFrame:
    """Words longer than 3 chars, not stopwords, not all digits; top n by count."""
    # Filtered inside the array, so dropped words never become rows; isin is a hash-set test.
    kept = F.filter(words(F.col(text_col)), lambda w: (F.length(w) >= min_len) & ~w.isin(T.STOPWORDS)
                    & ~w.rlike(r"^\p{Nd}+$"))
    counts = df.select(F.explode(kept).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("keyword").asc()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("keyword").asc())))


def adjacent_pairs(tokens: Column) -> Column:
    """array of (w1, w2) for consecutive tokens (empty for fewer than two)."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, 1, n).alias("w1"), F.slice(tokens, 2, n).alias("w2"))


def top_bigrams(df: DataFrame, text_col: str, n: int = 15, min_len: int = 3) -> DataFrame:
    """Adjacent word pairs, both longer than 2 chars and not stopwords, per document (Q13)."""
    # Dropped words become null in place: a pair stays only if neither side is null.
    good = F.transform(words(F.col(text_col)), lambda w: F.when((F.length(w) >= min_len) & ~w.isin(T.STOPWORDS), w))
    kept = F.filter(adjacent_pairs(good), lambda p: p["w1"].isNotNull() & p["w2"].isNotNull())
    counts = (df.select(F.explode(F.transform(kept, lambda p: F.concat_ws(" ", p["w1"], p["w2"]))).alias("phrase"))
              .groupBy("phrase").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.col("count").desc(), F.col("phrase").asc()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("phrase").asc())))


def bigrams_across_documents(df: DataFrame, text_col: str, order: list[Column]) -> DataFrame:
    """Q13 option: boundary pairs (last word of doc i, first word of doc i+1).

    Documents are numbered with the distributed ``sequential_ids`` and the
    boundary pair is an equi-join of seq with seq + 1, so no single task
    holds the whole order.
    """
    # Two words per document are numbered, not the text.
    t = (df.withColumn("_t", words(F.col(text_col))).filter(F.size("_t") > 0)
         .withColumn("_first", F.element_at("_t", 1)).withColumn("_last", F.element_at("_t", -1)).drop("_t", text_col))
    seq = ranking.sequential_ids(t, order, col="_seq")
    last = seq.select((F.col("_seq") + 1).alias("_seq"), F.col("_last").alias("w1"))
    first = seq.select("_seq", F.col("_first").alias("w2"))
    return last.join(first, "_seq").select("w1", "w2")
