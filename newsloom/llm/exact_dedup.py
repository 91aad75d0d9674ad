"""Exact dedup by a content sort.

Rows are range-partitioned on ``(first 64 characters, digest, id descending)`` of their text with sampled
splitters, each range is sorted externally, which places equal texts next to each other, and neighbouring
texts are compared in full.  Texts are in the order of their content as far as their first 64 characters tell them
apart; those that share them stand in the order of their digests, as a splitter of a whole text could be of any
size, and the sample that Spark takes to the driver has to stay small.  The id is part of the splitter key, so a text
that holds a third of all rows is spread over many ranges; runs that cross a range border are closed by
comparing the last text of a range with the first text of the next one (two rows per range).  No row is
dropped: the result has one row per input row.

Defined cases: a null text counts as empty; a null id sorts last inside its group and is only kept if
the whole group has no id; of rows repeated with the same text and id exactly one is kept; an empty
table gives an empty result; other columns are ignored (``keep_rows`` carries them through untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import drop_rows, load, prepare

HEAD_CHARS = 64   # characters of the text in a splitter; with digest and id it takes about a hundred bytes

_RUNS = "doc_id long, text_sha256 string, pid int, run long, is_first boolean, edge string, edge_last boolean"


def _tag_runs(batches: Iterator) -> Iterator:
    """Number the runs of equal neighbouring texts of one sorted range.

    The first and the last row also carry their text (``edge``) for the border comparison.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    previous, run, held = None, -1, None
    names = ["doc_id", "text_sha256", "pid", "run", "is_first", "edge", "edge_last"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]

    def out(ids, shas, runs, firsts, edges, last):
        n = len(ids)
        cols = [ids, shas, pa.array([pid] * n, pa.int32()), runs, firsts, edges, pa.array([last] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types)], names=names)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        if held is not None:   # the row held back is not the last one of the range
            yield out(*held[:5], False)
        ids, text, sha = (batch.column(i) for i in range(3))
        starts = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        import numpy as np
        first = np.concatenate([[previous is None or text[0].as_py() != previous], starts]).astype(bool)
        runs = run + np.cumsum(first)
        edges = pa.nulls(n, pa.string())
        if previous is None:
            edges = pa.concat_arrays([text.slice(0, 1).cast(pa.string()), pa.nulls(n - 1, pa.string())])
        previous, run = text[n - 1].as_py(), int(runs[-1])
        cols = [ids, sha, pa.array(runs), pa.array(first), edges]
        if n > 1:
            yield out(*[c.slice(0, n - 1) for c in cols], False)
        held = [c.slice(n - 1) for c in cols]
    if held is not None:
        held[4] = pa.array([previous], pa.string())
        yield out(*held[:5], True)


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row; the largest id of a group stays."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("text_sha256", F.sha2("text", 256))
    # An expression, not a column: the head of the text is not shuffled a second time.
    order = [F.substring("text", 1, HEAD_CHARS), F.unhex("text_sha256"), F.col("doc_id").desc_nulls_last()]
    ranges = base.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = (ranges.select("doc_id", "text", "text_sha256")
              .mapInArrow(_tag_runs, _RUNS).checkpoint())

    # Border rows: at most two per range.
    edges = tagged.filter(F.col("edge").isNotNull())
    by_range = Window.orderBy("pid")   # one narrow row per range
    spans = (edges.groupBy("pid").agg(F.max("run").alias("last_run"))
             .withColumn("idx", F.row_number().over(by_range)))
    first = edges.filter(F.col("run") == 0).groupBy("pid").agg(F.first("edge").alias("first_text"))
    last = edges.filter("edge_last").select("pid", F.col("edge").alias("last_text"))
    sides = spans.join(first, "pid").join(last, "pid")
    before = sides.select((F.col("idx") + 1).alias("idx"), F.col("last_text").alias("prev_text"))
    joined = (sides.join(before, "idx", "left")
              .select("idx", "pid", "last_run", F.coalesce(F.col("first_text") == F.col("prev_text"),
                                                           F.lit(False)).alias("cont")))
    # The group of a range's last run began in the latest range where a new group starts in that run.
    w = Window.orderBy("idx")
    head = F.last(F.when((F.col("last_run") > 0) | ~F.col("cont"), F.struct("pid", "last_run")), ignorenulls=True)
    chain = (joined.withColumn("tail_head", head.over(w))
             .withColumn("head", F.lag("tail_head").over(w))
             .filter("cont").select("pid", F.lit(0).cast("long").alias("run"), F.col("head.pid").alias("head_pid"),
                                    F.col("head.last_run").alias("head_run")))

    in_run = Window.partitionBy("pid", "run")
    local = tagged.select("doc_id", "text_sha256", "pid", "run", "is_first",
                          F.max("doc_id").over(in_run).alias("run_max"), F.count("*").over(in_run).alias("run_n"))
    heads = (chain.select("head_pid", "head_run").distinct()
             .select(F.col("head_pid").alias("pid"), F.col("head_run").alias("run"), "head_pid", "head_run"))
    crossing = chain.unionByName(heads)   # every run of a group that crosses a border -> its head
    sizes = tagged.groupBy("pid", "run").agg(F.count("*").alias("n"), F.max("doc_id").alias("m"))
    totals = (crossing.join(sizes, ["pid", "run"]).groupBy("head_pid", "head_run")
              .agg(F.sum("n").alias("total"), F.max("m").alias("top")))
    closed = (crossing.join(totals, ["head_pid", "head_run"])
              .select("pid", "run", "total", "top",
                      ((F.col("pid") != F.col("head_pid")) | (F.col("run") != F.col("head_run"))).alias("tail")))
    return (local.join(closed, ["pid", "run"], "left")
            .select("doc_id", F.coalesce("top", "run_max").alias("keep_id"),
                    F.coalesce("total", "run_n").cast("long").alias("group_size"),
                    (F.col("is_first") & ~F.coalesce("tail", F.lit(False))).alias("kept"), "text_sha256"))


def keep_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` (all columns) without the rows that an equal text with a larger id replaces.

    Rows are decided by id and text; of rows that repeat both, one stays.
    """
    groups = exact_groups(docs, text_col, id_col)
    by_row = (groups.groupBy("doc_id", F.xxhash64("text_sha256").alias("key"))
              .agg(F.count("*").alias("n"), F.max("kept").alias("k")).filter("n > 1 OR NOT k").checkpoint())
    key = F.xxhash64(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = drop_rows(docs, by_row.filter("NOT k").select("doc_id", "key"), key, id_col)
    repeated = by_row.filter("k").select("doc_id", "key")
    if repeated.isEmpty():
        return left
    once = drop_rows(left, repeated, key, id_col)
    again = left.withColumn("__key", key)
    again = again.join(repeated, again[id_col].eqNullSafe(repeated["doc_id"]) & (again["__key"] == repeated["key"]), "left_semi")
    one = again.withColumn("__rn", F.row_number().over(Window.partitionBy(id_col, "__key").orderBy("__key")))
    return once.unionByName(one.filter("__rn = 1").drop("__rn", "__key"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {"op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""}
