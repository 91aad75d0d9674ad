"""Corpus pipeline: the stages of a training-data run, each one an operator of ``newsloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet in the shared
checkpoint folder and read again as the next stage's input, so a lost executor costs one stage at most.
All stages but the last return the columns of ``docs``.

Defined cases: every stage decides by row, so rows that share an id (or have none) are decided by their own texts;
of rows that repeat id and text one is left behind the second stage; empty tables give empty results; without a
labelled row the first stage knows no language and every document goes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id
from newsloom.llm.common import load, prepare
from newsloom.session import ensure_checkpoint_dir

ORACLE_SQL = None   # the first stage is a trained model and has no SQL form

MIN_LANGUAGE_SHARE = 0.3   # a document whose best language holds less of its words than this is rejected


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``), or without a language that holds enough of their words, go.

    The model is fitted on the labelled rows of the table ``documents`` that are not held out.
    """
    prepare(spark)
    return language_id.keep_known(docs, language_id.train(load(spark, sf_dir, "documents")), MIN_LANGUAGE_SHARE)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    prepare(spark)
    return exact_dedup.keep_rows(docs)


def stage_ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by similarity links the one with the smallest id stays."""
    prepare(spark)
    return jaccard_join.keep_first(docs)


def stage_benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the table ``benchmark`` go."""
    prepare(spark)
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    prepare(spark)
    return byte_bpe.round_trip(docs)


STAGES = [
    ("language_id", stage_language_id),
    ("exact_dedup", stage_exact_dedup),
    ("ngram_jaccard_join", stage_ngram_jaccard_join),
    ("benchmark_decontamination", stage_benchmark_decontamination),
    ("byte_bpe", stage_byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
