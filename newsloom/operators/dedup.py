"""Key-based dedup, seen-set joins and near-duplicate removal.

Every "first wins" rule is an aggregate (``min_by``), not a window, so a hot
key is collapsed by the map-side partial aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import greedy, ranking, tfidf
from newsloom.session import ensure_checkpoint_dir


def dedupe_by_key(df: DataFrame, key: str, order_col: str, last: bool = False,
                  drop_empty: bool = True) -> DataFrame:
    """D1 (first wins) / D2 (last wins); null and empty keys dropped."""
    src = df.filter(F.col(key).isNotNull() & (F.col(key) != "")) if drop_empty else df
    return ranking.first_wins(src, key, order_col, last=last)


def dedupe_by_expr(df: DataFrame, key: Column, order_col: str, last: bool = False) -> DataFrame:
    """First (or last) row per computed key, e.g. the text or its first 250 chars."""
    return ranking.first_wins(df.withColumn("_dedup_key", key), "_dedup_key", order_col, last=last).drop("_dedup_key")


def distinct_in_order(arr: Column) -> Column:
    """Order-preserving distinct of an array column (first occurrence kept)."""
    return F.array_distinct(arr)


def unseen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in the seen set; NULL keys are kept (left anti)."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def new_vs_table(batch: DataFrame, table: DataFrame, key: str, order_col: str) -> DataFrame:
    """Rows whose key is absent from the table, first per key within the batch."""
    fresh = unseen(batch.filter(F.col(key).isNotNull()), table, key)
    return ranking.first_wins(fresh, key, order_col)


def exact_copies(docs: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """Map every doc to its copy group's first member: ``(id, rep, n_copies, is_rep)``.

    The group key is the SHA-256 of the text (null texts form one group, which
    has no tokens and therefore no near duplicates); the representative is the
    earliest member in ``order_col`` (then id).  Both steps are aggregates or
    an equi-join on the hash, so a copy group holding a third of all rows is
    combined map-side and split by AQE's skew join, never held by one task.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(order_col).alias("ord"),
                        F.coalesce(F.sha2(F.col(text_col), 256), F.lit("")).alias("h"))
    reps = keyed.groupBy("h").agg(F.min_by("id", F.struct("ord", "id")).alias("rep"),
                                  F.count(F.lit(1)).alias("n_copies"))
    return (keyed.join(reps, "h")
            .select("id", "rep", "n_copies", (F.col("id") == F.col("rep")).alias("is_rep")))


BROADCAST_ODD = 2_000_000   # ids that are broadcast because their texts are copies or come more than once


def _distinct_blocks(docs: DataFrame, id_col: str, text_col: str, order_col: str, copies: DataFrame, hot_rows: int) -> DataFrame:
    """Stored blocks of TF-IDF vectors over one row per distinct text, with df/n counting every copy."""
    # A repeated id is one document, with its earliest place: repeats scale its counts, which the norm undoes.
    groups = copies.filter(F.col("rep").isNotNull()).groupBy(F.col("rep").alias("id")).agg(
        F.count_distinct("id").alias("copies"), F.count(F.lit(1)).alias("_rows")).checkpoint(eager=True)
    # What is told of an id is whether it is no representative, or has copies, or comes more than once: most texts are
    # none of these, so the texts stay where they are read.
    odd = (copies.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("_times")).join(groups, "id", "left")
           .select(F.col("id").alias("_odd"), "copies", "_times").filter("copies IS NULL OR copies > 1 OR _times > 1").checkpoint(eager=True))
    counts = odd.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_times") > 1) & F.col("copies").isNotNull()).alias("again")).first()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(order_col).alias("ord")).filter(F.col("id").isNotNull())
    rows = rows.join(F.broadcast(odd) if counts.n <= BROADCAST_ODD else odd, F.col("id") == F.col("_odd"), "left")
    rows = rows.filter("_odd IS NULL OR copies IS NOT NULL").withColumn("copies", F.coalesce("copies", F.lit(1)))
    reps = rows.select("id", "ord", "text", "copies")
    if counts.again:
        reps = (rows.filter("_times IS NULL OR _times = 1").select("id", "ord", "text", "copies").unionByName(
            rows.filter("_times > 1").groupBy("id", "copies").agg(
                F.min("ord").alias("ord"), F.concat_ws("\n", F.collect_list("text")).alias("text"))))
    n_docs = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    return tfidf.packed_blocks(reps, n_docs, hot_rows)


def _copies(docs: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """The copy groups, computed once (a reliable checkpoint)."""
    ensure_checkpoint_dir(docs.sparkSession)
    return exact_copies(docs, id_col, text_col, order_col).checkpoint(eager=True)


def tfidf_on_distinct(docs: DataFrame, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """TF-IDF over one row per distinct text, with df/n counting every copy: packed rows ``(id, ord, tids, ws)``.

    Terms that only one of the texts holds count in the norm and are left out of the rows.
    """
    blocks = _distinct_blocks(docs, id_col, text_col, order_col, _copies(docs, id_col, text_col, order_col), tfidf.HOT_TERM_ROWS)
    return tfidf.unpacked(blocks, docs.schema[order_col].dataType)


def near_duplicate_pairs(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                         order_col: str | None = None, threshold: float = 0.85,
                         strict: bool = False, hot_rows: int = tfidf.HOT_TERM_ROWS) -> DataFrame:
    """C4 over distinct texts: ``(doc_a, doc_b, cosine)`` between copy-group representatives."""
    order_col = order_col or id_col
    blocks = _distinct_blocks(docs, id_col, text_col, order_col, _copies(docs, id_col, text_col, order_col), hot_rows)
    pairs = tfidf.similar_pairs(blocks, threshold, strict=strict)
    return pairs.select(F.col("lo").alias("doc_a"), F.col("hi").alias("doc_b"), "cosine")


def greedy_dedup(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                 order_col: str | None = None, threshold: float = 0.85) -> DataFrame:
    """Greedy leader dedup in ``order_col`` order, cosine >= threshold.

    Returns every input id with ``kept`` and ``reason`` in
    {'kept', 'exact_copy', 'near_duplicate'}.  Later exact copies always
    share their first copy's fate (if it is kept they are within threshold of
    it; if it is removed, whatever removed it removes them), so they are
    decided without entering the similarity graph.
    """
    order_col = order_col or id_col
    copies = _copies(docs, id_col, text_col, order_col)
    blocks = _distinct_blocks(docs, id_col, text_col, order_col, copies, tfidf.HOT_TERM_ROWS)
    edges = tfidf.similar_pairs(blocks, threshold)
    decided = greedy.greedy_select(edges, "lo", "hi")
    # A text without tokens has a zero vector (cosine 0 with anything, its
    # copies included), so its copies are kept like the reference keeps them.
    has_vec = tfidf.block_ids(blocks).select(F.col("id").alias("rep")).distinct().withColumn("_v", F.lit(True))
    out = (copies.join(decided.withColumnRenamed("node", "id"), "id", "left")
           .join(has_vec, "rep", "left")
           .select("id", "rep",
                   F.when(~F.col("is_rep") & F.col("_v").isNotNull(), F.lit("exact_copy"))
                    .when(F.col("kept") == False, F.lit("near_duplicate"))  # noqa: E712
                    .otherwise(F.lit("kept")).alias("reason")))
    return out.select(F.col("id").alias(id_col), (F.col("reason") == "kept").alias("kept"), "reason")


def accounting_by_reason(decisions: DataFrame, reason_col: str = "reason", stay: str = "kept") -> DataFrame:
    """One pass over a decision column: rows per reason, and whether that reason lets a row stay."""
    return (decisions.groupBy(F.col(reason_col).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("stays", F.col("reason") == stay))


def text_drop_reasons(docs: DataFrame, id_col: str, text_col: str, prefix: int = 250) -> DataFrame:
    """``(id, reason)`` of D3 then D4 in one pass: 'exact_text', 'prefix' or 'kept' for every row.

    The first row of each text survives D3; D4 keeps the first survivor of each prefix.  The survivor of a
    prefix is the first row of that prefix, so both firsts are aggregates over the input.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h"),
                        F.sha2(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, prefix), 256).alias("p"))
    firsts = keyed.groupBy("p", "h").agg(F.min("id").alias("first_h"))
    top = firsts.groupBy("p").agg(F.min("first_h").alias("first_p"))
    both = firsts.join(top, "p").select("h", "first_h", "first_p")
    reason = (F.when(F.col("id") != F.col("first_h"), F.lit("exact_text"))
               .when(F.col("id") != F.col("first_p"), F.lit("prefix")).otherwise(F.lit("kept")))
    return keyed.join(both, "h").select("id", reason.alias("reason"))


def batch_accounting(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Row count after each named processing stage, as one long frame (stage, rows).

    Each count is its own aggregate over the stage's plan; callers pass the
    stages in processing order (input first).
    """
    out = None
    for i, (name, df) in enumerate(stages):
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
