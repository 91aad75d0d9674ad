"""A stored inverted-file index with residual product codes.

``build`` fits everything on a bounded, hash-picked sample: the cells (k-means over normalised vectors) and, for each
of ``parts`` slices of the dimensions, 256 codewords of the residual (vector minus its cell's centre).  Every row is
written under its cell with its exact vector and its code of ``parts`` bytes.  ``append`` adds rows to the stored
cells without fitting again; ``search`` opens the index in any later session.

A search reads the cells that its queries probe (partitions of the table), ranks their rows by the codes alone
(column pruning leaves the vectors on disk), and fetches the exact vectors of the best ``refine x k`` per query for the
final ranking.  The number of probed cells is set by the recall wanted, measured at build time on a bounded query
sample.

Bounds: the sample has at most ``SAMPLE_ROWS`` rows; the centres have at most ``MAX_LISTS`` rows and travel with the
code books to every task (``MAX_LISTS x dim`` floats).  A (cell, query block, row block) is one task's work, so a cell
with a third of all rows is spread over many.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.vectors import DEFAULT_BLOCK_ROWS, TOPK_SCHEMA, _matrix, _top_of_rows, topk_of_queries
from newsloom.session import ensure_checkpoint_dir

SAMPLE_ROWS = 50_000
MAX_LISTS = 8_192
CODEWORDS = 256
PROBE_SAMPLE = 128      # queries of the build that set the number of probed cells
DEFAULT_RECALL = 0.95


@dataclass
class Model:
    centres: np.ndarray       # lists x dim
    books: np.ndarray         # parts x codewords x width (the last slice is filled up with zeros)
    nprobe: int

    @property
    def parts(self) -> int:
        return self.books.shape[0]

    def slices(self, m: np.ndarray) -> np.ndarray:
        """Rows cut into the slices of the code: rows x parts x width."""
        parts, _, width = self.books.shape
        out = np.zeros((len(m), parts * width))
        out[:, :m.shape[1]] = m
        return out.reshape(len(m), parts, width)

    def cells(self, m: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of normalised rows, nearest first."""
        far = (self.centres ** 2).sum(axis=1)[None, :] - 2 * (m @ self.centres.T)
        return np.argsort(far.round(12), axis=1, kind="stable")[:, :n]

    def encode(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Codes of normalised rows: rows x parts bytes."""
        rest = self.slices(m - self.centres[cell])
        out = np.zeros(rest.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            far = (book ** 2).sum(axis=1)[None, :] - 2 * (rest[:, p] @ book.T)
            out[:, p] = far.argmin(axis=1)
        return out


def _k_means(m: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds over a bounded sample; an empty centre is moved to the row farthest from its own."""
    centres = m[rng.choice(len(m), k, replace=False)].copy()
    for _ in range(rounds):
        far = (centres ** 2).sum(axis=1)[None, :] - 2 * (m @ centres.T)
        near = far.argmin(axis=1)
        uses = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        full = uses > 0
        centres[full] = sums[full] / uses[full][:, None]
        lost = np.flatnonzero(~full)
        if len(lost):
            worst = np.argsort(-far[np.arange(len(m)), near], kind="stable")[:len(lost)]
            centres[lost[:len(worst)]] = m[worst]
    return centres


def fit(m: np.ndarray, lists: int, parts: int, seed: int = 7) -> Model:
    """Cells and code books of normalised sample rows."""
    rng = np.random.default_rng(seed)
    centres = _k_means(m, min(lists, len(m)), rng)
    width = -(-m.shape[1] // parts)
    model = Model(centres, np.zeros((parts, 1, width)), 1)
    rest = model.slices(m - centres[model.cells(m, 1)[:, 0]])
    words = min(CODEWORDS, len(m))
    model.books = np.stack([_k_means(rest[:, p], words, rng) for p in range(parts)])
    return model


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def _assigned(rows: DataFrame, model: Model) -> DataFrame:
    """``(cell, id, vec, code)`` of the rows that have a usable vector."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            m, ok = _matrix(pdf["vec"])
            ok &= m.shape[1] == model.centres.shape[1]
            if ok.any():
                m, pdf = m[ok], pdf[ok]
                cell = model.cells(m, 1)[:, 0]
                yield pd.DataFrame({"cell": cell.astype("int32"), "id": pdf["id"].to_numpy(), "vec": list(m.astype("float32")),
                                    "code": [c.tobytes() for c in model.encode(m, cell)]})

    return rows.mapInPandas(run, "cell int, id long, vec array<float>, code binary")


def _write(assigned: DataFrame, path: str) -> None:
    # One task per cell and part of the hash, so that a cell is not scattered over all tasks' files.
    (assigned.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell")
     .mode("append").parquet(f"{path}/rows"))


def build(df: DataFrame, path: str, lists: int | None = None, parts: int = 8, id_col: str = "id", vec_col: str = "vec",
          k: int = 5, recall: float = DEFAULT_RECALL, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit on a bounded sample, write all rows, and measure how many cells ``recall`` needs.

    ``lists`` defaults to the square root of the row count (at most ``MAX_LISTS``).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = _rows(df, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    n = rows.count()
    if n == 0:
        raise ValueError("an index needs at least one vector")
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)   # a top-k, not a full sort
    m, ok = _matrix(sample.toPandas()["vec"])
    model = fit(m[ok], min(MAX_LISTS, lists or max(1, math.isqrt(n))), min(parts, m.shape[1]), seed)
    _write(_assigned(rows, model), path)
    model.nprobe = probes_for_recall(spark, path, model, k, recall)
    save_model(spark, path, model)
    return model


def save_model(spark: SparkSession, path: str, model: Model) -> None:
    """Centres and code books as a table, one row per centre or codeword."""
    centres = [("centre", 0, c, v.tolist()) for c, v in enumerate(model.centres)]
    words = [("word", p, c, v.tolist()) for p, book in enumerate(model.books) for c, v in enumerate(book)]
    meta = [("meta", model.nprobe, 0, [])]
    spark.createDataFrame(meta + centres + words, "kind string, part int, no int, vec array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "no").collect()   # bounded: lists + parts x 256 rows
    centres = np.array([r.vec for r in rows if r.kind == "centre"])
    parts = 1 + max(r.part for r in rows if r.kind == "word")
    books = np.stack([np.array([r.vec for r in rows if r.kind == "word" and r.part == p]) for p in range(parts)])
    return Model(centres, books, next(r.part for r in rows if r.kind == "meta"))


def append(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "vec") -> None:
    """Add rows to the stored cells; nothing is fitted again."""
    _write(_assigned(_rows(df, id_col, vec_col), load_model(df.sparkSession, path)), path)


def probes_for_recall(spark: SparkSession, path: str, model: Model, k: int, recall: float) -> int:
    """How many of their nearest cells a bounded sample of queries has to probe to meet ``recall`` of the exact top-k."""
    stored = spark.read.parquet(f"{path}/rows")
    queries = stored.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(PROBE_SAMPLE).select("id", "vec").checkpoint()
    exact = topk_of_queries(queries, stored, k).select("q", F.col("c").alias("id"))
    found = exact.join(stored.select("id", "cell"), "id").select("q", "cell").toPandas()   # at most sample x k rows
    picked = queries.toPandas()
    order = {q: list(row) for q, row in zip(picked["id"], model.cells(_matrix(picked["vec"])[0], len(model.centres)))}
    ranks = sorted(order[q].index(cell) + 1 for q, cell in zip(found["q"], found["cell"]))
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) if ranks else 1


def _scan(shared, keep: int):
    """Kernel of one (cell, query block, row block): the ``keep`` nearest rows of each query by their codes."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        model, cell = shared.value, int(key[0])
        asks, rows = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if not len(asks) or not len(rows):
            return pd.DataFrame({"q": [], "c": [], "sim": []})
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), model.parts)
        rest = model.slices(_matrix(asks["vec"])[0] - model.centres[cell])
        far = np.zeros((len(asks), len(rows)))
        for p, book in enumerate(model.books):   # one table per slice: distances of the queries to its codewords
            table = (book ** 2).sum(axis=1)[None, :] - 2 * (rest[:, p] @ book.T)
            far += table[:, codes[:, p]]
        # The query's own share of the distance is the same for all rows of a cell, but not across cells.
        near = -(far + (rest ** 2).sum(axis=(1, 2))[:, None])
        q, c = asks["id"].to_numpy(), rows["id"].to_numpy()
        near[q[:, None] == c[None, :]] = -np.inf
        row, column = _top_of_rows(near, c, keep)
        return pd.DataFrame({"q": q[row], "c": c[column], "sim": near[row, column]})

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, nprobe: int | None = None, refine: int = 8,
           id_col: str = "id", vec_col: str = "vec", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(q, c, sim, rank)``: approximate top-k rows of the index for every query (a row of its own id left out)."""
    ensure_checkpoint_dir(spark)
    model = load_model(spark, path)
    probes, keep = nprobe or model.nprobe, refine * k
    shared = spark.sparkContext.broadcast(model)
    stored = spark.read.parquet(f"{path}/rows")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, ok = _matrix(pdf["vec"])
            ok &= m.shape[1] == shared.value.centres.shape[1]
            if ok.any():
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "vec": list(m[ok].astype("float32")),
                                    "cells": [c.astype("int32") for c in shared.value.cells(m[ok], probes)]})

    asked = _rows(queries, id_col, vec_col).mapInPandas(probe, "id long, vec array<float>, cells array<int>").checkpoint()
    asks = asked.select("id", "vec", F.explode("cells").alias("cell"))
    # Blocks per cell: of the queries that probe it and of its rows.
    kq = asks.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_kq"))
    codes = stored.select("cell", "id", "code").join(F.broadcast(kq), "cell")   # at most MAX_LISTS rows: prunes the cells read
    kc = codes.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_kc"))
    blocks = kq.join(kc, "cell").checkpoint()
    left = asks.join(F.broadcast(blocks), "cell").select(
        "cell", F.pmod(F.xxhash64("id"), F.col("_kq")).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.col("_kc") - 1)).alias("_cb"),
        "id", "vec", F.lit(None).cast("binary").alias("code"), F.lit(0).alias("_side"))
    right = stored.select("cell", "id", "code").join(F.broadcast(blocks), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("_kq") - 1)).alias("_qb"), F.pmod(F.xxhash64("id"), F.col("_kc")).cast("int").alias("_cb"),
        "id", F.lit(None).cast("array<float>").alias("vec"), "code", F.lit(1).alias("_side"))
    rough = left.unionByName(right).groupBy("cell", "_qb", "_cb").applyInPandas(_scan(shared, keep), TOPK_SCHEMA)
    first = Window.partitionBy("q").orderBy(F.col("sim").desc(), "c")
    rough = rough.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= keep).select("q", "c")
    # The exact vectors of refine x k rows per query.
    pairs = rough.join(stored.select(F.col("id").alias("c"), F.col("vec").alias("cv")), "c").join(
        asked.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")
    dot = F.aggregate(F.zip_with("cv", "qv", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    ranked = pairs.select("q", "c", F.round(dot, 6).alias("sim"))   # normalised to floats: six digits hold
    last = Window.partitionBy("q").orderBy(F.col("sim").desc(), "c")
    return ranked.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def scratch_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/ann-{uuid.uuid4().hex}"
