"""Ranked lexical search over a length-stratified index.

Documents whose lengths give the same normaliser ``m`` form a stratum.  The strata are laid out one after the
other, by their number of terms, over shards of about ``SHARD_TERMS`` terms; a stratum larger than a shard is
spread over several by a hash of the id.  A shard of the index holds one row per term with its postings in cells
of equal (stratum, tf), so an impact is computed once per cell, and one row with the ids of its documents.

A search reads the postings of the queries' terms only.  In a shard, the greatest tf of a term in a stratum gives
the most that the term can add there; the sums over a query's terms bound the strata.  Strata are visited by
falling bounds, and the visit ends where the bound falls below the query's k-th best score so far (equal bounds
are still visited, as ties go by id).  Every shard sends at most k rows per query to the final ranking.

Bounds: a shard's documents and postings stay below a few dozen MB (a single longer text is a shard's content of
its own).  Queries are broadcast in blocks of at most ``QUERY_ROWS`` (query, term) rows; more queries take more
passes over the index.  The strata table has one row per distinct length; it is broadcast up to ``STRATA_ROWS``
rows and joined by shuffle beyond.

Defined cases: null and empty texts have no terms and are no part of N; an item without a term, or without a
document that scores above 0, has no rows; rows of equal item id are one item with the terms of all of them;
every document row is a document of its own, also with an id that occurs twice or is null (null ids rank first
among equal scores); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare
from newsloom.session import ensure_checkpoint_dir

# Fixed by the task: what is no part of a term, and the weights of the score.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10

SHARD_TERMS = 500_000
STRATA_ROWS = 1_000_000
QUERY_ROWS = 500_000

INDEX_SCHEMA = ("shard long, term string, cell_m array<long>, cell_tf array<long>, cell_n array<long>, "
                "docs array<int>, ids array<long>")


class Index(NamedTuple):
    path: str
    n_docs: int     # documents with a term
    n_terms: int    # their terms, with repeats


def terms_of(text) -> F.Column:
    """Terms of a text column as an array, with repeats."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NO_TERM, -1), "")


def _lists(values, starts):
    """pyarrow list array of ``values`` cut at ``starts`` (numpy, with the end appended)."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _count_terms(texts: pa.Array) -> pa.Array:
    """Number of terms of each text."""
    import numpy as np

    from newsloom.llm import bytewords

    found = bytewords.cut(texts.cast(pa.string()), bytewords.class_table(BLANKS))
    return pa.array(np.bincount(found.row, minlength=len(texts)).astype(np.int64))


def _index_shard(key, table):
    """One shard of the index from the rows ``(doc_id, text, m)`` of its documents."""
    import numpy as np

    from newsloom.llm import bytewords

    table_of = bytewords.class_table(BLANKS)
    # Ordinals: by stratum, then id (nulls first).
    order = table.select(["m", "doc_id"]).to_pandas().reset_index().sort_values(
        ["m", "doc_id"], na_position="first", kind="stable")["index"].to_numpy()
    ordinal = np.empty(len(order), np.int64)
    ordinal[order] = np.arange(len(order))
    m = table.column("m").to_numpy()[order].astype(np.int64)
    words, rows, seen = [], [], 0
    for chunk in table.column("text").chunks:
        for at in range(0, len(chunk), 256):
            part = chunk.slice(at, 256).cast(pa.string())
            found = bytewords.cut(part, table_of)
            words.append(found.words.dictionary_encode())
            rows.append(ordinal[found.row + seen].astype(np.int32))
            seen += len(part)
    coded = pa.chunked_array(words).unify_dictionaries()
    vocabulary = coded.chunk(0).dictionary
    code = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    both = code * len(order) + np.concatenate(rows)
    del code, rows, words, coded
    both, tf = np.unique(both, return_counts=True)
    code, doc = both // len(order), both % len(order)
    by_cell = np.lexsort((doc, tf, m[doc], code))
    code, doc, tf = code[by_cell], doc[by_cell], tf[by_cell]
    cm = m[doc]
    new_term = np.append(True, code[1:] != code[:-1])
    new_cell = new_term | np.append(True, (cm[1:] != cm[:-1]) | (tf[1:] != tf[:-1]))
    term_at, cell_at = np.flatnonzero(new_term), np.flatnonzero(new_cell)
    sizes = np.diff(np.append(cell_at, len(doc)))
    cells_of_term = np.append(np.searchsorted(cell_at, term_at), len(cell_at))
    terms = vocabulary.take(pa.array(code[term_at]))
    strata, per_stratum = np.unique(m, return_counts=True)
    ids = table.column("doc_id").combine_chunks().take(pa.array(order))
    t = len(terms)
    own = pa.table({
        "shard": pa.array(np.full(t, key[0].as_py(), np.int64)), "term": terms.cast(pa.string()),
        "cell_m": _lists(pa.array(cm[cell_at]), cells_of_term), "cell_tf": _lists(pa.array(tf[cell_at]), cells_of_term),
        "cell_n": _lists(pa.array(sizes), cells_of_term),
        "docs": _lists(pa.array(doc.astype(np.int32)), np.append(term_at, len(doc))),
        "ids": pa.nulls(t, pa.list_(pa.int64()))})
    head = pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "term": pa.nulls(1, pa.string()),
        "cell_m": pa.array([strata], pa.list_(pa.int64())), "cell_tf": pa.nulls(1, pa.list_(pa.int64())),
        "cell_n": pa.array([per_stratum], pa.list_(pa.int64())), "docs": pa.nulls(1, pa.list_(pa.int32())),
        "ids": _lists(ids.cast(pa.int64()), np.array([0, len(order)]))})
    return pa.concat_tables([head, own.cast(head.schema)])


def build_index(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> Index:
    """Write the index of all rows of ``docs`` to ``path`` (a shared folder) as Parquet."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Marked as nondeterministic so that filters on it are not pushed below it, which would count twice.
    rows = rows.withColumn("n", F.arrow_udf(_count_terms, "long").asNondeterministic()("text")).filter("n > 0")
    rows.groupBy("n").agg(F.count("*").alias("docs")).write.parquet(f"{path}/lengths")
    lengths = spark.read.parquet(f"{path}/lengths")
    n_docs, n_terms, distinct = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)),
                                            F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)), F.count("*")).first()
    if n_docs == 0:
        spark.createDataFrame([], INDEX_SCHEMA).write.parquet(f"{path}/postings")
        return Index(f"{path}/postings", 0, 0)

    def with_m(df: DataFrame) -> DataFrame:
        return df.withColumn("m", F.expr(f"{100 - 75}L + ((75L * n * {n_docs}L) div {n_terms}L)"))

    # One row per stratum: where its terms begin when all strata stand in a row.
    strata = with_m(lengths).groupBy("m").agg(F.sum(F.col("n") * F.col("docs")).alias("terms"))
    ahead = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.withColumn("before", F.coalesce(F.sum("terms").over(ahead), F.lit(0)))
    if distinct <= STRATA_ROWS:
        strata = F.broadcast(strata)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    placed = with_m(rows).join(strata, "m").select(
        F.floor((F.col("before") + F.floor(share * F.col("terms"))) / F.lit(SHARD_TERMS)).alias("shard"),
        "doc_id", "text", "m")
    placed.groupBy("shard").applyInArrow(_index_shard, INDEX_SCHEMA).write.parquet(f"{path}/postings")
    return Index(f"{path}/postings", n_docs, n_terms)


def impact(tf, m):
    """What one unit of a term's weight adds to a document's score."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def visit_strata(bounds, sizes, k: int, score_of):
    """The ``k`` best of a shard for one query: ``(ordinals, scores)``.

    ``score_of(mask)`` scores the documents of the marked strata (ordinals and scores above 0).  Strata are
    marked by falling bounds, each time about twice as many documents as before.
    """
    import numpy as np

    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    covered = np.cumsum(sizes[order])
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, floor, want = 0, 1, k
    while at < len(order) and bounds[order[at]] >= floor:
        end = max(at + 1, int(np.searchsorted(covered, want, "left")) + 1)
        end = min(end, int(np.searchsorted(-bounds[order], -floor, "right")))
        mask = np.zeros(len(bounds), bool)
        mask[order[at:end]] = True
        found, found_scores = score_of(mask)
        docs, scores = np.concatenate([docs, found]), np.concatenate([scores, found_scores])
        if len(scores) > k:
            floor = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            kept = scores >= floor
            docs, scores = docs[kept], scores[kept]
        elif len(scores) == k:
            floor = int(scores.min())
        want = int(covered[end - 1]) * 2
        at = end
    return docs, scores


def _search_shard(queries, k: int):
    """The task of a shard; ``queries`` is a broadcast list of ``(item, [(term, times, weight)])``."""

    def run(table):
        import numpy as np

        names, strata, sizes, ids = table.column("term").to_pylist(), None, None, None
        cells = {}
        lists = {c: table.column(c).combine_chunks() for c in ("cell_m", "cell_tf", "cell_n", "docs", "ids")}

        def part(column: str, row: int):
            return lists[column].slice(row, 1).flatten()

        for row, term in enumerate(names):
            if term is None:
                strata, sizes = part("cell_m", row).to_numpy(), part("cell_n", row).to_numpy()
                ids = part("ids", row)
        for row, term in enumerate(names):
            if term is None:
                continue
            stratum = np.searchsorted(strata, part("cell_m", row).to_numpy())
            tf, n = part("cell_tf", row).to_numpy(), part("cell_n", row).to_numpy()
            gain = impact(tf, strata[stratum])   # once per cell
            last = np.append(stratum[1:] != stratum[:-1], True)   # the cell of greatest tf in its stratum
            cells[term] = stratum, gain, n, part("docs", row).to_numpy(), stratum[last], gain[last]
        total = np.zeros(int(sizes.sum()), np.int64)
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        id_of = np.where(no_id, np.iinfo(np.int64).min, ids.fill_null(0).to_numpy())
        items, out_ids, out_null, out_scores = [], [], [], []
        for number, (_, terms) in enumerate(queries.value):
            mine = [(cells[t], times * weight) for t, times, weight in terms if weight > 0 and t in cells]
            bounds = np.zeros(len(strata), np.int64)
            for (_, _, _, _, at, most), factor in mine:
                bounds[at] += most * factor

            def score_of(mask, mine=mine):
                touched = []
                for (stratum, gain, n, docs, _, _), factor in mine:
                    marked = mask[stratum]
                    if not marked.any():
                        continue
                    if not marked.all():
                        docs, gain, n = docs[np.repeat(marked, n)], gain[marked], n[marked]
                    total[docs] += np.repeat(gain * factor, n)
                    touched.append(docs)
                if not touched:
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
                first = np.repeat(mask, sizes)
                found = np.flatnonzero(first & (total > 0))
                scores = total[found]
                total[found] = 0
                return found, scores

            docs, scores = visit_strata(bounds, sizes, k, score_of)
            best = np.lexsort((id_of[docs], -scores))[:k]
            items.append(np.full(len(best), number, np.int32))
            out_ids.append(id_of[docs[best]])
            out_null.append(no_id[docs[best]])
            out_scores.append(scores[best])
        return pa.table({"item": pa.array(np.concatenate(items)),
                         "doc_id": pa.array(np.concatenate(out_ids), pa.int64(), mask=np.concatenate(out_null)),
                         "score": pa.array(np.concatenate(out_scores), pa.int64())})

    return run


def search(index: Index, items: DataFrame, k: int = TOP, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    spark = items.sparkSession
    prepare(spark)
    item_type = items.schema[id_col].dataType
    rows = items.select(F.col(id_col).alias("item_id"), F.explode(terms_of(F.col(text_col))).alias("term"))
    rows = rows.groupBy("item_id", "term").agg(F.count("*").alias("times")).checkpoint()
    blocks = max(1, -(-rows.count() // QUERY_ROWS))
    postings = spark.read.parquet(index.path)
    parts = []
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        terms = block.select("term").distinct()
        held = postings.select("term", F.aggregate("cell_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).join(
            F.broadcast(terms), "term", "left_semi")
        held = held.groupBy("term").agg(F.sum("n").alias("df"))
        weighed = block.join(F.broadcast(held), "term").select("item_id", "term", "times", F.floor(
            F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long").alias("w"))
        queries: dict = {}
        for r in weighed.collect():   # at most QUERY_ROWS rows, but for one longer item
            queries.setdefault(r.item_id, []).append((r.term, r.times, r.w))
        if not queries:
            continue
        shared = spark.sparkContext.broadcast(list(queries.items()))
        number = spark.createDataFrame([(n, i) for n, i in enumerate(queries)], _item_schema(item_type))
        needed = postings.join(F.broadcast(terms), "term", "left_semi").unionByName(postings.filter("term IS NULL"))
        found = needed.groupBy("shard").applyInArrow(_search_shard(shared, k), "item int, doc_id long, score long")
        parts.append(found.join(F.broadcast(number), "item").drop("item"))
    if not parts:
        return spark.createDataFrame([], _item_schema(item_type)).select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _item_schema(item_type):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([StructField("item", IntegerType()), StructField("item_id", item_type)])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    return search(build_index(docs, path), load(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE_SQL = {"op12_lexical_search": f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
    lens AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
    tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lens),
    q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM
          (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM lens)
          WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
          FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), tot),
    s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
          FROM q JOIN w USING (term) JOIN p USING (term), tot GROUP BY ALL),
    r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
          FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""}
