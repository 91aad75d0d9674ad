"""TF-IDF vectors and exact cosine similarity joins.

Vectors are long frames ``(id, term, w)``: never an n x n matrix.

Weights follow the classic smoothed rule: raw term counts, idf =
ln((1 + n) / (1 + df)) + 1, then L2 normalisation per document.  Tokens are
maximal runs of two or more letters, digits or underscores after lower-casing
(``[\\p{L}\\p{N}_]{2,}``), which is the Unicode word rule without combining
marks (Q10).

Similarity join (exact).  Term ids number the dictionary rare-first (df
ascending).  A document's head are its terms up to the point where
the norm of the rest falls under ``HEAD_REST``.  If y's head ends no earlier
than x's, all shared terms before the end of x's head are in both heads, and the
others add at most the product of the norms that x and y have behind it
(Cauchy-Schwarz); only pairs whose heads' dot product reaches the threshold with
that are verified with the full dot product.
Common terms sit at the end of the order and so fall out of almost every head
(tests compare with brute force).

Neither pairs nor vectors are shuffled: every task packs the documents that it reads into blocks of bounded
size, which are stored once, compressed.  Two stored blocks meet in one task, which reads both, and what leaves it
are the similar pairs.  A term of a single document adds to its norm and to nothing else, so it is in no block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import ranking
from newsloom.session import ensure_checkpoint_dir

# The token rule.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Slack on the head bound so float rounding never loses a candidate.
HEAD_EPS = 1e-7
# The norm under which a document's rest is left out of its head (less where the threshold is low).
HEAD_REST = 0.83
# A block's terms (one document at least) and documents (times ``hot_rows``) at most.
BLOCK_TERMS = 4_000_000
HOT_TERM_ROWS = 1024
BLOCK_DOCS_PER_ROW = 16
# Products that a task holds at a time, and pairs of documents whose sums it holds (they stay in the processor's cache).
CHUNK = 4_000_000
CELLS = 1 << 17
# Terms of the dictionary that is sent to all tasks for the blocks, at most (12 bytes each).
BLOCK_DICTIONARY = 8_000_000
# Characters of the texts that a task counts, and the terms of a dictionary that is sent to all tasks at most.
TASK_CHARS = 16_000_000
BROADCAST_TERMS = 1_000_000


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                     weight_col: str | None = None) -> DataFrame:
    """(id, term, tf[, copies]) from (id, text); ``weight_col`` carries a per-doc multiplicity."""
    cols = [F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")]
    if weight_col:
        cols.append(F.col(weight_col).alias("copies"))
    exploded = docs.select(*cols)
    keys = ["id", "term"] + (["copies"] if weight_col else [])
    return exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, id_col: str = "id", text_col: str = "text",
          copies_col: str | None = None, n_docs: Column | None = None,
          with_term_ids: bool = False) -> DataFrame:
    """L2-normalised TF-IDF rows ``(id, term, df[, tid], w)``.

    ``copies_col`` lets callers pass one row per distinct text with its copy
    count; df and n then count every copy, as if the copies were present.

    The texts are dealt by id and their terms stay where they are counted: a dictionary of at most
    ``BROADCAST_TERMS`` terms comes to them, and only a larger one is joined by term.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    docs = docs.select(id_col, text_col, *([copies_col] if copies_col else [])).repartition(tasks, id_col)
    tf = term_frequencies(docs, id_col, text_col, copies_col)
    mult = F.col("copies") if copies_col else F.lit(1)
    if n_docs is None:
        n_docs = docs.select((F.sum(F.col(copies_col)) if copies_col else F.count(F.lit(1)))).scalar()
    # df: a hash aggregate with map-side partial sums, so a hot term is
    # combined per partition before the shuffle.
    dfreq = tf.groupBy("term").agg(F.sum(mult).cast("long").alias("df"))
    cols = ["id", "term", "df"]
    if with_term_ids:
        dfreq = with_term_ids_column(dfreq)
        cols.append("tid")
    ensure_checkpoint_dir(spark)
    dfreq = dfreq.checkpoint(eager=True)   # counted and joined: one computation
    if dfreq.count() <= BROADCAST_TERMS:
        dfreq = F.broadcast(dfreq)
    return weighted(tf, dfreq, n_docs, cols)


def weighted(tf: DataFrame, dfreq: DataFrame, n_docs: Column, cols: Sequence[str] = ("id", "term", "df")) -> DataFrame:
    """Normalised weights of term counts ``(id, term, tf)`` under document frequencies ``(term, df)``."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    raw = tf.join(dfreq, "term").select(*cols, (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select(*cols, (F.col("w") / norm).alias("w"))


def with_term_ids_column(dfreq: DataFrame) -> DataFrame:
    """Add dense integer term ids ``tid`` to a one-row-per-term dictionary.

    The ids come from a distributed sort of the dictionary, so equal ids always
    mean equal terms, at any vocabulary size.  Rare terms come first.
    """
    return ranking.sequential_ids(dfreq, [F.col("df").asc(), F.col("term").asc()], col="tid")


def packed_vectors(vec: DataFrame) -> DataFrame:
    """One row per document: ``(id, tids, ws)`` sorted by term id.

    A document's vector is bounded by its own length, so this group is never
    larger than one text.
    """
    packed = vec.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tid", "w"))).alias("_v"))
    return packed.select("id", F.col("_v.tid").alias("tids"), F.col("_v.w").alias("ws"))


class _Block:
    """The documents of one block as flat arrays: entries by document, term ids ascending."""

    def __init__(self, data, rest: float) -> None:
        import numpy as np

        stored = _loaded(data)
        self.ids, self.ord = stored["ids"], stored["ord"]
        self.start = np.concatenate([[0], np.cumsum(stored["sizes"], dtype="int64")])
        self.tid, self.w = stored["tid"], _stored_weights(stored)
        doc = np.repeat(np.arange(len(self.ids)), stored["sizes"])
        before = np.concatenate([[0.0], np.cumsum(self.w * self.w)])
        sfx = np.sqrt(np.maximum(before[self.start[1:]][doc] - before[:-1], 0.0))   # norm of the term and all after it
        head = sfx >= rest
        self.rest = np.zeros(len(self.ids))
        np.maximum.at(self.rest, doc[~head], sfx[~head])
        self.head_doc, self.head_tid, self.head_w = doc[head], self.tid[head], self.w[head]
        self.head_start = np.searchsorted(self.head_doc, np.arange(len(self.ids) + 1))
        # Of each document the last term of its head and its norm; of each entry of a head the norm of what comes behind.
        self.span = int(self.tid.max(initial=0)) + 1
        self.last = np.append(self.head_tid, 0)[np.maximum(self.head_start[1:] - 1, 0)].astype("int64")
        self.norm = np.sqrt(before[self.start[1:]] - before[self.start[:-1]])
        self.behind = np.append(np.sqrt(np.maximum(before[self.start[1:]][self.head_doc] - before[1:][head], 0.0)), 0.0)

    def behind_term(self, docs, tids):
        """The norms of documents behind terms that do not stand behind their heads."""
        import numpy as np

        if not hasattr(self, "head_key"):
            self.head_key = self.head_doc * self.span + self.head_tid
        at = np.searchsorted(self.head_key, docs * self.span + np.minimum(tids, self.span - 1), "right")
        none = at == self.head_start[docs]
        return np.where(none, self.norm[docs], self.behind[at - 1])

    def heads_by_term(self):
        """Term ids, documents and weights of the heads, sorted by term."""
        import numpy as np

        order = np.argsort(self.head_tid, kind="stable")
        return self.head_tid[order], self.head_doc[order], self.head_w[order]


def _saved(**arrays) -> bytes:
    """Arrays as compressed bytes."""
    import pickle

    import pyarrow as pa

    plain = pickle.dumps(arrays, protocol=5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _loaded(data) -> dict:
    import pickle

    import pyarrow as pa

    data = memoryview(data)
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd"))


def _stored_weights(stored):
    """The weights of a block's entries: stored as they are, or as counts, their idf by term id and the documents' norms."""
    import numpy as np

    if "w" in stored:
        return stored["w"]
    idf = stored["idf"][np.searchsorted(stored["first"], stored["tid"], "right") - 1] if len(stored["tid"]) else np.zeros(0)
    return stored["n"] * idf / np.repeat(stored["norm"], stored["sizes"])


class _Dictionary:
    """Terms of two or more documents by hash, with ids in the order (df, hash), and the idf of each range of ids."""

    def __init__(self, hashes, df, n_docs: int) -> None:
        import numpy as np

        order = np.lexsort((hashes, df))
        df = df[order]
        self.n_docs = n_docs
        self.first = np.flatnonzero(np.append(True, df[1:] != df[:-1])) if len(df) else np.zeros(0, "int64")
        self.idf = self.idf_of(df[self.first])
        by_hash = np.argsort(hashes[order])
        self.hashes, self.tid = hashes[order][by_hash], by_hash.astype("int32")

    def idf_of(self, df):
        import numpy as np

        return np.log((1.0 + self.n_docs) / (1.0 + df)) + 1.0

    def counted(self, row, hashes, copies):
        """Entries (row, tid, count) of a batch's tokens sorted by row and term id, and the rows' norms."""
        import numpy as np

        terms, at = np.unique(hashes, return_inverse=True)
        tid = np.full(len(terms), -1, "int64")
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
            known = self.hashes[place] == terms
            tid[known] = self.tid[place[known]]
        both, n = np.unique(row * max(1, len(terms)) + at, return_counts=True)
        row, tid = both // max(1, len(terms)), tid[both % max(1, len(terms))]
        own = tid < 0   # in this document only: its df is the document's copies
        square = np.bincount(row[own], (n[own] * self.idf_of(copies[row[own]])) ** 2, minlength=len(copies))
        row, tid, n = row[~own], tid[~own], n[~own]
        order = np.lexsort((tid, row))
        row, tid, n = row[order], tid[order], n[order]
        idf = self.idf[np.searchsorted(self.first, tid, "right") - 1] if len(tid) else np.zeros(0)
        return row, tid, n, np.sqrt(square + np.bincount(row, (n * idf) ** 2, minlength=len(copies)))


def _cut(found, terms: int, docs: int):
    """Blocks ``(arrays, number)`` of a task's documents, which come as arrays by document and by entry per batch."""
    import numpy as np
    from pyspark import TaskContext

    made = 0

    def block(parts):
        nonlocal made
        arrays = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        number = (TaskContext.get().partitionId() << 32) + made
        made += 1
        return arrays, number

    held, size, rows = [], 0, 0
    for part in found:
        at = 0
        ends = np.cumsum(part["sizes"])
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + terms - size, "right")), at + docs - rows, len(ends))
            if to == at and not rows:   # a document with more terms than a block should have
                to = at + 1
            if to > at:
                upto = ends[to - 1]
                held.append({k: v[before:upto] if k in ("tid", "n", "w") else v[at:to] for k, v in part.items()})
                size, rows = size + upto - before, rows + to - at
            if to < len(ends):
                yield block(held)
                held, size, rows = [], 0, 0
            at = to
    if held:
        yield block(held)


def _rows_of_blocks(blocks, **more):
    import pyarrow as pa

    for arrays, number in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_saved(**arrays, **more)], pa.binary())], names=["block", "data"])


def _orders(column):
    """A column's values as an array (numbers stay numbers; with nulls, or of other types: objects)."""
    import numpy as np

    if not column.null_count and str(column.type).startswith("int"):
        return column.to_numpy(zero_copy_only=False).astype("int64")
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _pack_texts(shared, terms: int, docs: int):
    """Texts ``(id, ord, copies, hashes)`` as blocks; texts without tokens have no vector."""

    def run(batches):
        import numpy as np

        words = shared.value

        def counted():
            for batch in batches:
                lists = batch.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(sizes)), sizes)
                row, tid, n, norm = words.counted(row, lists.flatten().to_numpy(), batch.column(2).to_numpy())
                some = sizes > 0
                yield {"ids": batch.column(0).to_numpy()[some], "ord": _orders(batch.column(1))[some], "norm": norm[some],
                       "sizes": np.bincount(row, minlength=len(sizes))[some], "tid": tid.astype("int32"), "n": n.astype("int32")}

        yield from _rows_of_blocks(_cut(counted(), terms, docs), first=words.first, idf=words.idf)

    return run


def _pack_vectors(terms: int, docs: int):
    """Vectors ``(id, ord, tids, ws)`` as blocks."""

    def run(batches):
        import numpy as np

        def flat():
            for batch in batches:
                yield {"ids": batch.column(0).to_numpy(), "ord": _orders(batch.column(1)), "sizes": np.diff(batch.column(2).offsets.to_numpy()),
                       "tid": batch.column(2).flatten().to_numpy(), "w": batch.column(3).flatten().to_numpy()}

        yield from _rows_of_blocks(_cut(flat(), terms, docs))

    return run


BLOCK_SCHEMA = "block long, data binary"


def _frequencies(words: DataFrame) -> DataFrame:
    """``(h, df, docs)`` per term of ``(term, copies)``: a hash that tells all terms apart, copies and rows that hold it."""
    counts = words.groupBy("term").agg(F.sum("copies").cast("long").alias("df"), F.count(F.lit(1)).alias("docs"))
    seed = 0
    while True:
        freq = counts.select(_hash(F.col("term"), seed).alias("h"), "df", "docs").checkpoint(eager=True)
        if freq.count() == freq.select("h").distinct().count():
            return freq, seed
        seed += 1


def _hash(term: Column, seed: int) -> Column:
    return F.xxhash64(term, F.lit(seed))


def packed_blocks(texts: DataFrame, n_docs: int, hot_rows: int = HOT_TERM_ROWS) -> DataFrame:
    """Stored blocks of the TF-IDF vectors of ``texts (id, ord, text, copies)``, which has one row per id.

    df counts every copy, and so does ``n_docs``.  The texts stay where they are read: the dictionary of the terms that
    two documents or more hold comes to them.  A dictionary above ``BLOCK_DICTIONARY`` terms is joined by shuffle.
    """
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    docs_most = hot_rows * BLOCK_DOCS_PER_ROW
    freq, seed = _frequencies(texts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"), "copies"))
    shared_terms = freq.filter("docs > 1")
    size = shared_terms.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("docs"), F.lit(0)).alias("entries")).first()
    tasks = max(-(-size.entries // BLOCK_TERMS), spark.sparkContext.defaultParallelism)
    if size.terms <= BLOCK_DICTIONARY:
        import numpy as np

        table = shared_terms.select("h", "df").toArrow()
        words = spark.sparkContext.broadcast(_Dictionary(np.asarray(table.column("h")), np.asarray(table.column("df")), n_docs))
        del table
        hashes = F.transform(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")), lambda t: _hash(t, seed))
        rows = texts.select(F.col("id").cast("long"), "ord", F.col("copies").cast("long"), hashes.alias("hashes")).coalesce(tasks)
        return rows.mapInArrow(_pack_texts(words, BLOCK_TERMS, docs_most), BLOCK_SCHEMA).checkpoint(eager=True)
    vec = tfidf(texts, "id", "text", copies_col="copies", n_docs=F.lit(n_docs), with_term_ids=True)
    packed = packed_vectors(vec.select("id", "tid", "w")).join(texts.select("id", "ord"), "id")
    rows = packed.select(F.col("id").cast("long"), "ord", "tids", "ws").coalesce(tasks)
    return rows.mapInArrow(_pack_vectors(BLOCK_TERMS, docs_most), BLOCK_SCHEMA).checkpoint(eager=True)


def unpacked(blocks: DataFrame, ord_type: T.DataType) -> DataFrame:
    """The rows ``(id, ord, tids, ws)`` of stored blocks; terms of a single document are not among them."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ord", ord_type),
                           T.StructField("tids", T.ArrayType(T.LongType())), T.StructField("ws", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for data in batch["data"]:
                stored = _loaded(data)
                ends = np.cumsum(stored["sizes"])[:-1]
                yield pd.DataFrame({"id": stored["ids"], "ord": stored["ord"], "tids": np.split(stored["tid"].astype("int64"), ends),
                                    "ws": np.split(_stored_weights(stored), ends)})

    return blocks.select("data").mapInPandas(run, schema)


def block_ids(blocks: DataFrame) -> DataFrame:
    """The ids of the documents of stored blocks."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["data"]:
                yield pd.DataFrame({"id": _loaded(data)["ids"]})

    return blocks.select("data").mapInPandas(run, "id long")


def _runs(first, n):
    """The numbers ``first[i] .. first[i] + n[i] - 1`` of all i, one after the other."""
    import numpy as np

    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _parts(sizes, most: int):
    """Ranges (from, to) of consecutive items with at most ``most`` in all (one item at least)."""
    import numpy as np

    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _head_hits(a: _Block, b: _Block, threshold: float):
    """(document of a, document of b) whose heads' product can make a similar pair."""
    import numpy as np

    b_tid, b_doc, b_w = b.heads_by_term()
    held = np.bincount(b_tid, minlength=max(a.span, b.span))
    lo, n = (np.cumsum(held) - held)[a.head_tid], held[a.head_tid]
    del held
    wide = max(1, len(b.ids))
    step = max(1, CELLS // wide)
    # No rest is larger than these, so the heads of a pair reach at least ``least``.
    rests = max(a.rest.max(initial=0.0), b.rest.max(initial=0.0))
    least = max(threshold - rests - HEAD_EPS, 1e-300)
    for d in range(0, len(a.ids), step):
        docs = min(step, len(a.ids) - d)
        e0, e1 = a.head_start[d], a.head_start[d + docs]
        if not n[e0:e1].any():
            continue
        dots = None
        for f, t in _parts(n[e0:e1], CHUNK):
            at = slice(e0 + f, e0 + t)
            col = _runs(lo[at], n[at])
            cell = b_doc[col] + np.repeat((a.head_doc[at] - d) * wide, n[at])
            part = np.bincount(cell, np.repeat(a.head_w[at], n[at]) * b_w[col], minlength=docs * wide)
            dots = part if dots is None else dots + part
        cell = np.flatnonzero(dots >= least)
        if not len(cell):
            continue
        row, col = cell // wide + d, cell % wide
        # Terms that both heads end before add no more than the norms behind the end of the first (Cauchy-Schwarz).
        end = np.minimum(a.last[row], b.last[col])
        enough = dots[cell] + a.behind_term(row, end) * b.behind_term(col, end) >= threshold - HEAD_EPS
        yield row[enough], col[enough]


def _dots(a: _Block, b: _Block, row, col, laid):
    """Full dot products of pairs of documents (sorted by ``row``): a row's terms are laid out, the others look theirs up.

    ``laid`` holds a zero for each term id.
    """
    import numpy as np

    out = np.zeros(len(row))
    size = np.diff(b.start)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
    for s, e in zip(starts, np.append(starts[1:], len(row))):
        own = slice(a.start[row[s]], a.start[row[s] + 1])
        laid[a.tid[own]] = a.w[own]
        for f, t in _parts(size[col[s:e]], CHUNK):
            docs = col[s + f:s + t]
            n = size[docs]
            at = _runs(b.start[docs], n)
            out[s + f:s + t] = np.bincount(np.repeat(np.arange(t - f), n), laid[b.tid[at]] * b.w[at], minlength=t - f)
        laid[a.tid[own]] = 0.0
    return out


DOT_SCHEMA = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
                           T.StructField("cosine", T.DoubleType())])


def _places(*blocks: _Block):
    """The places of the blocks' documents in the order (ord, id); -1 without ``ord``."""
    import numpy as np
    import pandas as pd

    both = pd.DataFrame({"ord": pd.Series(np.concatenate([b.ord for b in blocks])), "id": np.concatenate([b.ids for b in blocks])})
    place = np.full(len(both), -1)
    order = both[both["ord"].notna()].sort_values(["ord", "id"], kind="stable").index.to_numpy()
    place[order] = np.arange(len(order))
    return np.split(place, np.cumsum([len(b.ids) for b in blocks])[:-1])


def _block_pairs(threshold: float, strict: bool):
    rest = min(HEAD_REST, threshold)

    def met(a: _Block, b: _Block):
        import numpy as np

        place_a, place_b = _places(a) * 2 if a is b else _places(a, b)
        laid = np.zeros(max(a.span, b.span))
        for row, col in _head_hits(a, b, threshold):
            keep = (place_a[row] >= 0) & (place_b[col] >= 0)
            if a is b:
                keep &= row < col
            row, col = row[keep], col[keep]
            if not len(row):
                continue
            dots = _dots(a, b, row, col, laid)
            keep = dots > threshold if strict else dots >= threshold
            row, col, dots = row[keep], col[keep], dots[keep]
            first = place_a[row] < place_b[col]
            yield from zip(np.where(first, a.ids[row], b.ids[col]).tolist(), np.where(first, b.ids[col], a.ids[row]).tolist(), dots.tolist())

    def run(pairs):
        number, a = None, None
        for (i, left), (j, right) in pairs:
            # Of a pair's two meetings one counts; the turns are dealt so that all blocks have as many.
            if i != j and ((i >> 32) + i + (j >> 32) + j) % 2 != (i < j):
                continue
            if i != number:
                number, a = i, _Block(left, rest)
            yield from met(a, a if i == j else _Block(right, rest))

    return run


def similar_pairs(blocks: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """C4: all (lo, hi, cosine) with cosine >= threshold (or > when ``strict``), lo before hi in the order (ord, id).

    ``blocks`` are stored blocks; a task reads the two that meet in it, so nothing is shuffled.
    """
    spark = blocks.sparkSession
    stored = blocks.select("block", "data").rdd
    met = stored.cartesian(stored)
    tasks = max(stored.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism)
    pairs = met.coalesce(min(tasks, met.getNumPartitions())).mapPartitions(_block_pairs(threshold, strict))
    return spark.createDataFrame(pairs, DOT_SCHEMA, verifySchema=False)
