"""Benchmark decontamination with spaced seeds (DataFrame functions only).

A mask such as ``11001011`` hashes the words at its ones and ignores the words at its zeros, so a
substituted word under a zero does not hide a match.  Seeds of the benchmark items are joined with the
seeds at every word position of every document.  A hit fixes how the item lies over the document; the
words on that diagonal are then compared one by one.  A document is contaminated when some stretch of
``WINDOW`` words of an item (the whole item if it is shorter) lies in it with at least ``MIN_MATCH`` of
the words equal.  The masks lose nothing for these values: every way to place two substitutions in 12 or 13
words leaves a seed whole, and shorter items have masks by their length (``SHORT_MASKS``) that survive every
way to place the one or two substitutions which ``MIN_MATCH`` allows them (checked in the tests).

While the benchmark has at most ``BROADCAST_SEEDS`` seeds, they are broadcast and documents are scanned
in one pass without a shuffle of words; a larger benchmark is joined by shuffling seed hashes, and only the
documents that were hit are read again.

Defined cases: null and empty texts match nothing; items without a word match
nothing; items of one to four words must stand in the document whole and unchanged (80 % of them is all of them);
items of equal words count as one, with the smallest id; repeated document
rows give one result row per id and item; empty tables give an empty result; other columns are ignored
(:func:`keep_clean` carries them through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import drop_rows, load, prepare, text_key, words_of

MASKS = ("11001011", "11010011")
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "10111", "11011", "11101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11111", "110111"),
               9: ("110111",), 10: ("11001011", "11010011", "110111"), 11: ("11001011", "11010011", "110111")}
LONG_ITEM = 12                # items of so many words use MASKS
WINDOW = 13
MIN_MATCH = 0.8
BROADCAST_SEEDS = 1_000_000   # about 50 MB in memory


def _seed(words, at, mask_no: int, mask: str) -> F.Column:
    return F.xxhash64(F.lit(mask_no), *[F.get(words, at + i) for i, c in enumerate(mask) if c == "1"])


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_key, item_id, item_words)``: one row per different word sequence."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
    return (items.filter(F.size("item_words") > 0)
            .withColumn("item_key", F.xxhash64(F.md5(F.array_join("item_words", " "))))
            .groupBy("item_key", "item_words").agg(F.min("item_id").alias("item_id")))


def _masks_for(items: DataFrame, masks: tuple[str, ...]) -> dict[str, F.Column]:
    """The masks in use, each with the condition on the length of the items that it is for."""
    n = F.size("item_words")
    short = items.filter(n < LONG_ITEM).select(n.alias("n")).distinct().collect()   # one row per length at most
    lengths: dict[str, list[int]] = {m: [] for m in masks}
    for r in sorted(short):
        for m in SHORT_MASKS[r["n"]]:
            lengths.setdefault(m, []).append(r["n"])
    return {m: n.isin(own) | ((n >= LONG_ITEM) & F.lit(m in masks)) for m, own in lengths.items()}


def _with_seeds(df: DataFrame, words: str, masks: list[str], kept: list[str],
                uses: dict[str, F.Column] | None = None) -> DataFrame:
    """One row per word position and mask (whose ``uses`` holds): ``kept`` columns, ``at`` and ``key``."""
    last = F.size(words) - min(map(len, masks))
    at = df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    keys = []
    for i, m in enumerate(masks):
        fits = F.col("at") + len(m) <= F.size(words)
        keys.append(F.when(fits & uses[m] if uses else fits, _seed(F.col(words), F.col("at"), i, m)))
    return at.select(*kept, "at", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
               min_match: float = MIN_MATCH, text_col: str = "text", id_col: str = "doc_id",
               broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``(doc_id, item_id, first_word, matched_words, item_words, overlap)`` of every contaminated pair.

    ``first_word`` is the word of the document on which the item's first word lies (it may be negative if
    the document begins inside the passage); ``overlap`` is the share of the item's words that match there.
    """
    prepare(docs.sparkSession)
    items = benchmark_items(benchmark).checkpoint()
    uses = _masks_for(items, masks)
    all_masks = list(uses)
    seeds = (_with_seeds(items, "item_words", all_masks, ["item_key", "item_words"], uses)
             .select("key", "item_key", F.col("at").alias("item_at"), F.size("item_words").alias("n_item")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    worded = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    small = seeds.count() <= broadcast_seeds
    start = (F.col("at") - F.col("item_at")).alias("start")
    # The item's place in the document: words[max(start, 0) : start + n_item].
    lead = F.greatest(-F.col("start"), F.lit(0))
    piece = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("n_item") - lead).alias("piece")
    if small:
        hits = (_with_seeds(worded, "words", all_masks, ["doc_id", "words"])
                .join(F.broadcast(seeds), "key").select("doc_id", "words", "item_key", "n_item", start))
        places = hits.select("doc_id", "item_key", "start", piece)
    else:
        hits = (_with_seeds(worded, "words", all_masks, ["doc_id", "words"]).select("doc_id", "at", "key")
                .join(seeds, "key").select("doc_id", "item_key", "n_item", start).distinct())
        back = worded.withColumnRenamed("doc_id", "__doc_id")
        places = (hits.join(back, hits["doc_id"].eqNullSafe(back["__doc_id"]))
                  .select("doc_id", "item_key", "start", piece))
    # Many seeds of one passage agree on the place: merged map-side.
    places = places.groupBy("doc_id", "item_key", "start", "piece").agg(F.count("*").alias("seeds"))
    joined = places.join(F.broadcast(items) if small else items, "item_key")
    own = F.slice("item_words", lead + 1, F.size("piece"))
    equal = F.zip_with("piece", own, lambda a, b: (a == b).cast("int"))
    n_item = F.size("item_words")
    width = F.least(F.lit(window), n_item)
    joined = (joined.select("doc_id", "item_id", "start", n_item.alias("n_item"), width.alias("width"), equal.alias("eq"))
              .filter(F.size("eq") >= F.col("width")))
    total = F.aggregate("eq", F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("eq") - F.col("width")), lambda i: F.aggregate(
        F.slice("eq", i + 1, F.col("width")), F.lit(0), lambda a, x: a + x)))
    found = joined.select("doc_id", "item_id", "start", "n_item", total.alias("matched"), best.alias("best"), "width")
    found = found.filter(F.col("best") >= F.ceil(F.col("width") * min_match))
    top = F.max(F.struct("matched", (-F.col("start")).alias("neg"), "n_item")).alias("t")
    return (found.groupBy("doc_id", "item_id").agg(top)
            .select("doc_id", "item_id", (-F.col("t.neg")).cast("long").alias("first_word"),
                    F.col("t.matched").cast("long").alias("matched_words"),
                    F.col("t.n_item").cast("long").alias("item_words"),
                    (F.col("t.matched") / F.col("t.n_item")).alias("overlap")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) without the contaminated rows; rows that share an id are decided by their own texts."""
    key = text_key(F.col(text_col))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).alias("id"), key.alias("key")))
    leaks = find_leaks(keyed, benchmark, id_col="__row", text_col=text_col, **options)
    return drop_rows(docs, leaks.select("doc_id.id", "doc_id.key"), key, id_col)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
