"""Dense-vector similarity.

Cosine work on dense vectors is done in *blocks*: rows are bucketed into
blocks of at most ``block_rows`` rows, and each row is replicated only to the
block pairs it takes part in (not to every other row).  One block pair is one
``applyInPandas`` group of bounded size; it runs numpy matrix products and
emits only what is asked for (top-k per row, best match, or pairs above a
threshold) — never the full pair set.  Where all rows meet all others (top-k,
edges), a row travels once per block, so the blocks are as large as a task can
hold (``TILE_ROWS``), and a task makes its products ``CHUNK`` at a time.  Final top-k per row is a window with a
``row_number() <= k`` filter (partial group limit before the shuffle).

Null or zero vectors never match anything (pgvector would return NULL; Q2).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import greedy
from newsloom.session import ensure_checkpoint_dir

DEFAULT_BLOCK_ROWS = 1024
TILE_ROWS = 8192      # rows of one side that a task holds at most, where all rows meet all others
TILES = 12            # blocks that small inputs are cut into (of ``block_rows`` at least), so that their pairs are spread
CHUNK = 4_000_000     # products that a task holds at a time
PROBED = 512          # rows of a block that give a first bound of a query's k best


# ----------------------------------------------------------------- expressions

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length arrays (NULL when a norm is 0)."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def parse_vector(s: Column) -> Column:
    """JSON text -> array<float>; malformed -> NULL."""
    parsed = F.try_variant_get(F.try_parse_json(s), "$", "array<float>")
    return F.when(F.schema_of_variant(F.try_parse_json(s)).startswith("ARRAY"), parsed)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float")))


# ------------------------------------------------------------ block kernels

def _matrix(series):
    """(row-normalised float64 matrix, mask of usable rows); null/zero vectors are unusable."""
    import numpy as np

    vals = list(series)
    sizes = np.array([-1 if v is None else len(v) for v in vals])
    dim = int(next((n for n in sizes if n > 0), 0))
    if len(vals) and (sizes == dim).all():
        m = np.concatenate(vals).astype("float64").reshape(len(vals), dim)
    else:
        m = np.zeros((len(vals), dim), dtype="float64")
        same = np.flatnonzero(sizes == dim) if dim else []
        if len(same):
            m[same] = np.concatenate([vals[i] for i in same]).astype("float64").reshape(len(same), dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    ok = n[:, 0] > 0
    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m, ok


SIM_DIGITS = 12   # a product's last bits depend on the block it is computed in; equal vectors shall tie everywhere


def _similarities(a, b):
    """Cosines of the normalised rows of two matrices, rounded so that equal vectors have equal values."""
    return (a @ b.T).round(SIM_DIGITS)


def _top_of_rows(s, ids, k: int):
    """(row, column) of the ``k`` largest finite values of each row; equal values by the smaller id."""
    import numpy as np

    k = min(k, s.shape[1])
    if k == 0 or s.shape[0] == 0:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    row, column = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    order = np.lexsort((ids[column], -s[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


TOPK_SCHEMA = T.StructType([T.StructField("q", T.LongType()), T.StructField("c", T.LongType()),
                            T.StructField("sim", T.DoubleType())])


def _best_of(mq, okq, iq, mc, okc, ic, k: int, names=None):
    """Frame ``(q, c, sim)``: each query's ``k`` most similar rows of another id; equal values by the smaller id.

    ``q`` is the query's id, or what ``names`` calls it.
    """
    import numpy as np

    q, c = np.flatnonzero(okq), np.flatnonzero(okc)
    names = iq if names is None else names
    mc, ic, k = mc[c], ic[c], min(k, len(c))
    found = [pd.DataFrame({"q": np.zeros(0, "int64"), "c": np.zeros(0, "int64"), "sim": np.zeros(0)})]
    probed = min(len(c), max(PROBED, 4 * k))
    step = max(1, CHUNK // max(1, len(c)))
    for at in range(0, len(q) if k else 0, step):
        rows = q[at:at + step]
        s = mq[rows] @ mc.T
        s[iq[rows][:, None] == ic[None, :]] = -np.inf
        # The k-th best of some rows bounds that of all from below; few others reach it.
        least = np.partition(s[:, :probed], probed - k, axis=1)[:, probed - k] - 10.0 ** (1 - SIM_DIGITS)
        row, column = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        sim = s[row, column].round(SIM_DIGITS)
        order = np.lexsort((ic[column], -sim, row))
        row, column, sim = row[order], column[order], sim[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append(pd.DataFrame({"q": names[rows[row[best]]], "c": ic[column[best]], "sim": sim[best]}))
    return pd.concat(found, ignore_index=True)


def _topk_kernel(k: int):
    def fn(key, pdf):
        pi, pj = int(key[0]), int(key[1])
        sides = []
        for block in dict.fromkeys((pi, pj)):
            part = pdf[pdf["_b"] == block]
            sides.append((*_matrix(part["vec"]), part["id"].to_numpy(dtype="int64")))
        if pi == pj:
            return _best_of(*sides[0], *sides[0], k)
        return pd.concat([_best_of(*sides[0], *sides[1], k), _best_of(*sides[1], *sides[0], k)])

    return fn


def _tiles(rows, block_rows: int):
    """Blocks for a number (or column) of rows that all meet each other."""
    if isinstance(rows, Column):
        return F.greatest(F.lit(1), F.ceil(rows / F.lit(max(TILE_ROWS, block_rows))),
                          F.least(F.lit(TILES), F.ceil(rows / F.lit(block_rows)))).cast("int")
    return max(1, math.ceil(rows / max(TILE_ROWS, block_rows)), min(TILES, math.ceil(rows / block_rows)))


def _n_blocks(df: DataFrame, block_rows: int) -> int:
    return max(1, math.ceil(df.count() / block_rows))


def topk_nearest(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec",
                 block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Exact top-k most similar other rows for every row: ``(q, c, sim, rank)``.

    Ties are broken by neighbour id.  Work is O(n^2 d) by definition of exact
    kNN; each task holds two blocks.  ``ivf_topk`` is the sub-quadratic option.
    """
    nb = _tiles(df.count(), block_rows)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                     F.pmod(F.xxhash64(id_col), F.lit(nb)).cast("int").alias("_b"))
    rep = base.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    rep = rep.select("id", "vec", "_b", F.least("_b", "_j").alias("_pi"), F.greatest("_b", "_j").alias("_pj"))
    cand = rep.groupBy("_pi", "_pj").applyInPandas(_topk_kernel(k), TOPK_SCHEMA)
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("c").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_of_queries(queries: DataFrame, df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec",
                    block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """D10 for a stated query set: exact top-k rows of ``df`` for every row of ``queries`` (itself left out).

    Each (query block, row block) is one bounded task that emits k rows per query.  A row travels once per
    query block, so the work is |queries| x |df|, not |df| squared.
    """
    nq, nb = _n_blocks(queries, block_rows), _n_blocks(df, block_rows)
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.lit(0).alias("_side"),
                       F.pmod(F.xxhash64(id_col), F.lit(nq)).cast("int").alias("_qb"),
                       F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_cb"))
    c = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.lit(1).alias("_side"),
                  F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("_qb"),
                  F.pmod(F.xxhash64(id_col), F.lit(nb)).cast("int").alias("_cb"))
    cand = q.unionByName(c).groupBy("_qb", "_cb").applyInPandas(_query_block_topk(k), TOPK_SCHEMA)
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("c").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -------------------------------------------------- time-windowed neighbours

BEST_SCHEMA = T.StructType([T.StructField("q", T.LongType()), T.StructField("c", T.LongType()),
                            T.StructField("sim", T.DoubleType())])


def _window_best_kernel(window_s: float):
    import numpy as np
    import pandas as pd

    def fn(pdf):
        qs = pdf[pdf["_side"] == 0]
        cs = pdf[pdf["_side"] == 1]
        if len(qs) == 0 or len(cs) == 0:
            return pd.DataFrame({"q": [], "c": [], "sim": []})
        mq, okq = _matrix(qs["vec"])
        mc, okc = _matrix(cs["vec"])
        s = _similarities(mq, mc)
        tq = qs["_t"].to_numpy(dtype="float64")[:, None]
        tc = cs["_t"].to_numpy(dtype="float64")[None, :]
        oq = qs["_o"].to_numpy(dtype="int64")[:, None]
        oc = cs["_o"].to_numpy(dtype="int64")[None, :]
        iq = qs["id"].to_numpy(dtype="int64")[:, None]
        ic = cs["id"].to_numpy(dtype="int64")[None, :]
        earlier = (oc < oq) | ((oc == oq) & (ic < iq))
        valid = earlier & (tc > tq - window_s) & (tc <= tq) & okq[:, None] & okc[None, :]
        s = np.where(valid, s, -np.inf)
        row, column = _top_of_rows(s, cs["id"].to_numpy(dtype="int64"), 1)
        return pd.DataFrame({"q": qs["id"].to_numpy(dtype="int64")[row],
                             "c": cs["id"].to_numpy(dtype="int64")[column], "sim": s[row, column]})

    return fn


def _time_blocks(df: DataFrame, ts_col: str, window_s: int, block_rows: int) -> DataFrame:
    """(tb, sub, n_sub) per row: tb = ts bucket of the window length, sub-blocks of <= block_rows."""
    tb = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / F.lit(window_s * 1_000_000)).cast("long")
    b = df.withColumn("_tb", tb)
    sizes = b.groupBy("_tb").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_ns"))
    return b.join(sizes, "_tb").withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_ns")).cast("int"))


def window_nearest(df: DataFrame, window_hours: float = 48, id_col: str = "id", vec_col: str = "vec",
                   ts_col: str = "ts", order_col: str | None = None,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """For each row, the most similar row earlier in ``order_col`` with ts in [ts - window, ts].

    Returns ``(q, c, sim)`` for rows that have at least one candidate.  The
    theta join on time is made an equi-join on (bucket, sub-block): a query in
    bucket b only meets candidates in b and b - 1.
    """
    window_s = int(window_hours * 3600)
    order_col = order_col or ts_col
    order_val = (F.unix_micros(F.col(order_col).cast("timestamp")) if order_col == ts_col
                 else F.col(order_col).cast("long"))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                     F.col(ts_col).cast("timestamp").alias("ts"), order_val.alias("_o"))
    blk = _time_blocks(base, "ts", window_s, block_rows)
    sizes = blk.select("_tb", "_ns").distinct()
    prev = sizes.select((F.col("_tb") + 1).alias("_tb"), F.col("_ns").alias("_ns_prev"))
    nxt = sizes.select((F.col("_tb") - 1).alias("_tb"), F.col("_ns").alias("_ns_next"))
    blk = blk.join(prev, "_tb", "left").join(nxt, "_tb", "left")
    blk = blk.withColumn("_t", F.unix_micros("ts") / F.lit(1_000_000.0))
    # Four replicated branches read the blocked rows: materialise them once.
    ensure_checkpoint_dir(df.sparkSession)
    blk = blk.checkpoint(eager=True)
    # Queries: paired with candidate sub-blocks of their own bucket and the previous one.
    q_same = blk.select("id", "vec", "_t", "_o", F.col("_tb").alias("qtb"), F.col("_sub").alias("qs"),
                        F.col("_tb").alias("ctb"), F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("cs"))
    q_prev = (blk.filter(F.col("_ns_prev").isNotNull())
              .select("id", "vec", "_t", "_o", F.col("_tb").alias("qtb"), F.col("_sub").alias("qs"),
                      (F.col("_tb") - 1).alias("ctb"), F.explode(F.sequence(F.lit(0), F.col("_ns_prev") - 1)).alias("cs")))
    # Candidates: paired with query sub-blocks of their own bucket and the next one.
    c_same = blk.select("id", "vec", "_t", "_o", F.col("_tb").alias("ctb"), F.col("_sub").alias("cs"),
                        F.col("_tb").alias("qtb"), F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("qs"))
    c_next = (blk.filter(F.col("_ns_next").isNotNull())
              .select("id", "vec", "_t", "_o", F.col("_tb").alias("ctb"), F.col("_sub").alias("cs"),
                      (F.col("_tb") + 1).alias("qtb"), F.explode(F.sequence(F.lit(0), F.col("_ns_next") - 1)).alias("qs")))
    cols = ["qtb", "qs", "ctb", "cs", "id", "vec", "_t", "_o"]
    rows = (q_same.unionByName(q_prev).select(*cols, F.lit(0).alias("_side"))
            .unionByName(c_same.unionByName(c_next).select(*cols, F.lit(1).alias("_side"))))
    best = rows.groupBy("qtb", "qs", "ctb", "cs").applyInPandas(_window_best_kernel(window_s), BEST_SCHEMA)
    # Best over all candidate groups of a query: an aggregate (partial per partition).
    agg = best.groupBy("q").agg(F.max_by(F.struct("c", "sim"), F.struct(F.col("sim"), -F.col("c"))).alias("b"))
    return agg.select("q", F.col("b.c").alias("c"), F.col("b.sim").alias("sim"))


# --------------------------------------------------------- threshold edges

EDGE_SCHEMA = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
                            T.StructField("sim", T.DoubleType())])


def _similar(ma, oka, mb, okb, threshold: float, strict: bool):
    """(row of a, row of b, cosine) of the pairs that reach the threshold, chunk by chunk."""
    import numpy as np

    step = max(1, CHUNK // max(1, len(mb)))
    for at in range(0, len(ma) if len(mb) else 0, step):
        s = ma[at:at + step] @ mb.T
        hit = (s > threshold) if strict else (s >= threshold)
        hit &= oka[at:at + step, None] & okb[None, :]
        r, c = np.nonzero(hit)
        yield r + at, c, s[r, c]


def _edges_kernel(threshold: float, strict: bool):
    import numpy as np

    def fn(key, pdf):
        pi, pj = int(key[-2]), int(key[-1])
        sides = []
        for block in (pi, pj):
            part = pdf[pdf["_b"] == block]
            sides.append((*_matrix(part["vec"]), part["_o"].to_numpy(dtype="int64"), part["id"].to_numpy(dtype="int64")))
        (ma, oka, oa, ia), (mb, okb, ob, ib) = sides
        found = [pd.DataFrame({"lo": np.zeros(0, "int64"), "hi": np.zeros(0, "int64"), "sim": np.zeros(0)})]
        for r, c, sim in _similar(ma, oka, mb, okb, threshold, strict):
            keep = (oa[r] < ob[c]) if pi == pj else (oa[r] != ob[c])
            r, c, sim = r[keep], c[keep], sim[keep]
            first = oa[r] < ob[c]
            found.append(pd.DataFrame({"lo": np.where(first, ia[r], ib[c]), "hi": np.where(first, ib[c], ia[r]), "sim": sim}))
        return pd.concat(found, ignore_index=True)

    return fn


def threshold_edges(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vec",
                    order_col: str = "id", group_cols: tuple[str, ...] = (), strict: bool = False,
                    block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Pairs (lo, hi, sim) within each group with sim >= threshold (> if strict); lo earlier in order.

    ``order_col`` must be a unique integer order key.  Groups are split into
    blocks, so a group holding a third of all rows is spread over many bounded tasks.
    """
    g = list(group_cols)
    base = df.select(*g, F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                     F.col(order_col).cast("long").alias("_o"))
    if g:
        sizes = base.groupBy(*g).agg(_tiles(F.count(F.lit(1)), block_rows).alias("_nb"))
        base = base.join(sizes, g)
    else:
        base = base.withColumn("_nb", F.lit(_tiles(base.count(), block_rows)))
    base = base.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    rep = base.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rep = rep.select(*g, "id", "vec", "_o", "_b", F.least("_b", "_j").alias("_pi"), F.greatest("_b", "_j").alias("_pj"))
    return rep.groupBy(*g, "_pi", "_pj").applyInPandas(_edges_kernel(threshold, strict), EDGE_SCHEMA)


# ------------------------------------------------------------- highlights

def semantic_highlights(df: DataFrame, n: int = 5, threshold: float = 0.85, group_col: str = "sentiment",
                        id_col: str = "id", vec_col: str = "vec", ts_col: str = "ts",
                        block_rows: int = DEFAULT_BLOCK_ROWS,
                        embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per group, newest first, skip a row whose cosine to a chosen row is > threshold; first n.

    Exact and bounded: the greedy walk only depends on earlier rows, so it is
    run on the newest K rows of each group (a group-limited window); groups
    that keep fewer than n rows while having more than K rows are re-run with
    K x 4.  Rows without a vector never count as duplicates.

    ``embed`` adds ``vec_col`` to rows of ``df`` that have none yet (a vector per id): only the rows that the
    walk comes to are embedded.
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(F.col(group_col).alias("g"), F.col(id_col).cast("long").alias("id"),
                     *([] if embed else [F.col(vec_col).alias("vec")]), F.col(ts_col).alias("ts"))
    order = Window.partitionBy("g").orderBy(F.col("ts").desc_nulls_last(), F.col("id").asc())
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("_size"))
    k = max(4 * n, 16)
    pending = sizes.select("g")
    results = []
    while True:
        pref = (base.join(pending, "g", "left_semi").withColumn("_rn", F.row_number().over(order))
                .filter(F.col("_rn") <= k)).checkpoint(eager=True)
        if embed:
            reached = embed(df.join(pref.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"))
            by_id = reached.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.first(vec_col).alias("vec"))
            pref = pref.join(by_id, "id", "left").checkpoint(eager=True)
        edges = threshold_edges(pref, threshold, "id", "vec", "_rn", ("g",), strict=True, block_rows=block_rows)
        decided = greedy.greedy_select(edges, "lo", "hi")
        kept = (pref.join(decided.withColumnRenamed("node", "id"), "id", "left")
                .filter(F.coalesce(F.col("kept"), F.lit(True))))
        ranked = kept.withColumn("_k", F.row_number().over(Window.partitionBy("g").orderBy("_rn")))
        counts = ranked.groupBy("g").agg(F.count(F.lit(1)).alias("_nk")).join(sizes, "g")
        done = counts.filter((F.col("_nk") >= n) | (F.col("_size") <= k)).select("g").checkpoint(eager=True)
        results.append(ranked.join(done, "g", "left_semi").filter(F.col("_k") <= n)
                       .select(F.col("g").alias(group_col), F.col("id").alias(id_col), F.col("_k").alias("rank"))
                       .checkpoint(eager=True))
        pending = pending.join(done, "g", "left_anti").checkpoint(eager=True)
        if pending.isEmpty():
            break
        k *= 4
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


# --------------------------------------------------------------- IVF index

def ivf_index(df: DataFrame, lists: int = 100, id_col: str = "id", vec_col: str = "vec", seed: int = 7,
              max_iter: int = 20):
    """K-means cells over L2-normalised vectors (Spark ML).  Returns (model, assigned rows)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base = df.select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(vec_col)).alias("vec")).filter(
        F.col("vec").isNotNull())
    feats = base.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell").fit(feats)
    assigned = model.transform(feats).select("id", "vec", "cell")
    return model, assigned


def _nearest_cells(centroids, nprobe: int):
    """Arrow-batched UDF: the ``nprobe`` most similar centroids of each vector (ties by cell id)."""
    import numpy as np

    cm = np.asarray(centroids, dtype="float64")
    cn = np.linalg.norm(cm, axis=1, keepdims=True)
    cm = np.divide(cm, cn, out=np.zeros_like(cm), where=cn > 0)

    @F.pandas_udf("array<int>")
    def cells(vecs: pd.Series) -> pd.Series:
        m, _ = _matrix(vecs)
        s = m @ cm.T
        order = np.lexsort((np.broadcast_to(np.arange(cm.shape[0]), s.shape), -s), axis=1)[:, :nprobe]
        return pd.Series([row.astype("int32").tolist() for row in order])

    return cells


PROBE_SAMPLE = 128   # queries whose exact neighbours decide the number of probed cells


def probes_for_recall(assigned: DataFrame, centroids: list, k: int, recall: float, sample: int = PROBE_SAMPLE,
                      block_rows: int = DEFAULT_BLOCK_ROWS) -> int:
    """The number of cells to probe so that ``recall`` of the exact top-k of a query sample lie in them.

    The sample is hash-picked and bounded; its exact neighbours come from one pass over all rows, and for each
    of them it is enough to know how far down the query's list of nearest cells its own cell stands.
    """
    queries = assigned.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(sample).select("id", "vec")
    exact = topk_of_queries(queries, assigned, k, block_rows=block_rows).select("q", "c")
    order = queries.select(F.col("id").alias("q"), _nearest_cells(centroids, len(centroids))(F.col("vec")).alias("cells"))
    ranks = (exact.join(order, "q").join(assigned.select(F.col("id").alias("c"), "cell"), "c")
             .select(F.array_position("cells", F.col("cell").cast("int")).alias("r")))
    found = sorted(r.r for r in ranks.collect())   # at most sample x k numbers
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) if found else 1


def ivf_topk(df: DataFrame, k: int = 5, lists: int | None = None, nprobe: int | None = None, id_col: str = "id",
             vec_col: str = "vec", seed: int = 7, block_rows: int = DEFAULT_BLOCK_ROWS, recall: float = 0.95) -> DataFrame:
    """Approximate top-k: probe the ``nprobe`` nearest cells, verify exactly inside them.

    ``lists`` defaults to the square root of the row count and ``nprobe`` to what ``recall`` needs on a sample.

    The centroid matrix (``lists`` x d, so the square root of the rows) travels
    in the probing UDF's closure.  Cells are put together into tiles of about ``TILE_ROWS`` rows, and
    a query goes to a tile once, with the cells that it probes there.  Verification is blocked per tile
    (query blocks x member blocks), so a cell holding a third of all vectors is spread over many
    bounded tasks and only top-k rows per query leave each task.
    """
    if lists is None:
        lists = max(1, math.isqrt(df.count()))
    model, assigned = ivf_index(df, lists, id_col, vec_col, seed)
    centroids = [[float(x) for x in c] for c in model.clusterCenters()]
    if nprobe is None:
        ensure_checkpoint_dir(df.sparkSession)
        assigned = assigned.checkpoint(eager=True)
        nprobe = probes_for_recall(assigned, centroids, k, recall, block_rows=block_rows)
    tiles = _tiles(assigned.count(), block_rows)
    tile = F.pmod(F.col("cell"), F.lit(tiles)).cast("int")
    probe = assigned.select("id", "vec", _nearest_cells(centroids, nprobe)(F.col("vec")).alias("near"))
    probe = probe.select("id", "vec", "near", F.explode(F.array_distinct(F.transform("near", lambda c: F.pmod(c, F.lit(tiles))))).alias("tile"))
    probe = probe.select("tile", "id", "vec", F.filter("near", lambda c: F.pmod(c, F.lit(tiles)) == F.col("tile")).alias("cells"))
    # Per tile: members and probing queries are split into blocks; each (tile, query block, member
    # block) is one bounded task emitting only top-k per query.
    members = assigned.select(tile.alias("tile"), "id", "vec", F.array(F.col("cell").cast("int")).alias("cells"))
    rows = max(TILE_ROWS, block_rows)
    m_sizes = members.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_km"))
    q_sizes = probe.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_kq"))
    sizes = m_sizes.join(q_sizes, "tile")
    q_rows = (probe.join(sizes, "tile")
              .select("tile", F.pmod(F.xxhash64("id"), F.col("_kq")).cast("int").alias("_qb"),
                      F.explode(F.sequence(F.lit(0), F.col("_km") - 1)).alias("_cb"), "id", "vec", "cells", F.lit(0).alias("_side")))
    c_rows = (members.join(sizes, "tile")
              .select("tile", F.explode(F.sequence(F.lit(0), F.col("_kq") - 1)).alias("_qb"),
                      F.pmod(F.xxhash64("id"), F.col("_km")).cast("int").alias("_cb"), "id", "vec", "cells", F.lit(1).alias("_side")))
    cand = q_rows.unionByName(c_rows).groupBy("tile", "_qb", "_cb").applyInPandas(_probed_topk(k), TOPK_SCHEMA)
    w2 = Window.partitionBy("q").orderBy(F.col("sim").desc(), F.col("c").asc())
    return cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def _probed_topk(k: int):
    """Kernel: for each query row (_side 0) the top-k member rows (_side 1) of the cells that it probes, self excluded."""
    import numpy as np

    def fn(pdf):
        qs, cs = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        (mq, okq), iq = _matrix(qs["vec"]), qs["id"].to_numpy(dtype="int64")
        (mc, okc), ic = _matrix(cs["vec"]), cs["id"].to_numpy(dtype="int64")
        asked = np.concatenate([np.zeros(0, "int64"), *qs["cells"]])
        asker = np.repeat(np.arange(len(qs)), [len(c) for c in qs["cells"]])
        cell = np.concatenate([np.zeros(0, "int64"), *cs["cells"]])
        found = [pd.DataFrame({"q": np.zeros(0, "int64"), "c": np.zeros(0, "int64"), "sim": np.zeros(0)})]
        for one in np.unique(cell):
            q, c = asker[asked == one], np.flatnonzero(cell == one)
            found.append(_best_of(mq[q], okq[q], iq[q], mc[c], okc[c], ic[c], k, names=q))
        best = pd.concat(found, ignore_index=True).sort_values(["q", "sim", "c"], ascending=[True, False, True])
        best = best.groupby("q").head(k)
        return best.assign(q=iq[best["q"].to_numpy()])

    return fn


def _query_block_topk(k: int):
    """Kernel: for each query row (_side 0) the top-k member rows (_side 1) by cosine, self excluded."""
    import numpy as np

    def fn(pdf):
        qs = pdf[pdf["_side"] == 0]
        cs = pdf[pdf["_side"] == 1]
        if len(qs) == 0 or len(cs) == 0:
            return pd.DataFrame({"q": [], "c": [], "sim": []})
        mq, okq = _matrix(qs["vec"])
        mc, okc = _matrix(cs["vec"])
        iq = qs["id"].to_numpy(dtype="int64")
        ic = cs["id"].to_numpy(dtype="int64")
        s = _similarities(mq, mc)
        s[~okq, :] = -np.inf
        s[:, ~okc] = -np.inf
        s[iq[:, None] == ic[None, :]] = -np.inf
        row, column = _top_of_rows(s, ic, k)
        return pd.DataFrame({"q": iq[row], "c": ic[column], "sim": s[row, column]})

    return fn
