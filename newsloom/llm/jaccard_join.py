"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Words are hashed in the JVM; a task turns them into five-word shingles, a digest of the word sequence
   (texts with equal words are one *node*) and the MinHash bands.
2. Band hashes are shuffled; buckets with at least two nodes are candidates.  Buckets with the same members
   in several bands are merged before anything is compared.
3. Every candidate node's n-gram set is sent to its buckets.  A bucket above ``BLOCK`` nodes is cut into
   blocks, and each pair of blocks is compared by a task of its own, so no bucket is capped and none has to fit
   into one task.  A pair is compared only in the first band that both nodes share.
4. A comparison returns one row per linked node (its number of links and the smallest node it hangs
   together with), never the pairs.  Connected components of those rows are the classes.

Bands and rows follow from the threshold and the target recall (:func:`choose_bands`).

Result of :func:`jaccard_classes`, one row per document: ``class_id`` is the smallest id among all
documents that hang together by links; ``n_links`` counts the *different* texts whose similarity with this
one is at least the threshold; ``n_copies`` counts the documents with the same word sequence.

Defined cases: a text of one to four words has one shingle, all its words; null texts and texts without a
word have no shingles, link to nothing and form a class of their own each row's id; rows repeated with
the same words are copies of one node; a null id is the class id only if the class has no id at all;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.llm.common import drop_rows, hot_lookup, load, prepare, text_key, words_of
from newsloom.llm.components import components

WORDS = 5              # words of a shingle
THRESHOLD = 0.8        # least Jaccard similarity of a link
TARGET_RECALL = 0.9995  # of pairs right at the threshold; more similar pairs are found more surely
MAX_HASHES = 128
BLOCK = 256            # nodes of a block of a large bucket
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES
                 ) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands still reach ``recall`` within ``max_hashes``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows of many texts and the offsets of each text's windows.

    A text shorter than n words has one window, filled up with zeros.
    """
    sizes = np.diff(offsets)
    counts = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = offsets[:-1][owner] + np.arange(out_offsets[-1]) - out_offsets[:-1][owner]
    end = offsets[1:][owner]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        at = first + k
        h = _mixed(h * _MIX + np.where(at < end, padded[at], np.uint64(0)) + np.uint64(k + 1))
    return h, out_offsets


def _bands(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of the texts that have shingles, texts x bands."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][full]
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX)
    out = np.zeros((len(full), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(full), np.uint64(b + 1))
        for r in range(rows):
            s = seeds[b * rows + r]
            values = (shingles ^ s) * (s | np.uint64(1))
            values ^= values >> np.uint64(32)
            h = _mixed(h * _MIX + np.minimum.reduceat(values, starts))
        out[:, b] = h
    return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values (as uint64) and offsets of an Arrow list column."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def _digest(words: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, offsets = _flat(batch.column(1))
            shingles, at = _shingles(words, offsets, n)
            signed = _bands(shingles, at, bands, rows).view(np.int64)
            nodes = [_digest(words[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]
            sizes = np.where(np.diff(at) > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                             pa.array(signed.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), lists],
                                             names=["doc_id", "node", "bands"])
    return run


def _node_sets(n: int, bands: int, rows: int):
    """Bands and n-gram sets of candidate nodes; rows whose text is not the node's own are left out."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, offsets = _flat(batch.column(0))
            wanted = batch.column(1).to_pylist()
            keep = [i for i, w in enumerate(wanted) if _digest(words[offsets[i]:offsets[i + 1]]) == w]
            if not keep:
                continue
            shingles, at = _shingles(words, offsets, n)
            sets = [np.unique(shingles[at[i]:at[i + 1]]) for i in keep]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets)
            signed = _bands(values, ends, bands, rows).view(np.int64)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(1), taken.column(2),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * bands, pa.int32()), pa.array(signed.reshape(-1))),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))],
                names=["node", "places", "bands", "grams"])
    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products over blocks of shared n-grams."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, uses = np.unique(values, return_inverse=True, return_counts=True)
    shared = uses > 1
    column = np.cumsum(shared) - 1
    inside = shared[inverse]
    owner, column = owner[inside], column[inverse[inside]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def _compare(band: int, cross: bool, sides: np.ndarray, nodes: list[bytes], bands: np.ndarray, sets: list[np.ndarray],
             threshold: float) -> list[tuple[bytes, bytes, int]]:
    """Verified links of one block or (``cross``) between two blocks: (node, smallest node it hangs together with, links)."""
    n = len(nodes)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if cross:   # pairs within one block belong to another task
        wanted &= sides[:, None] != sides[None, :]
    for k in range(band):   # pairs that met in an earlier band were compared there
        wanted &= bands[:, k][:, None] != bands[:, k][None, :]
    left, right = np.nonzero(wanted)
    size = np.array([len(s) for s in sets])
    near = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right])
    left, right = left[near], right[near]
    if len(left) == 0:
        return []
    if len(left) > 4 * n:
        both = _overlaps(sets)[left, right].astype(np.float64)
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)])
    linked = both >= threshold * (size[left] + size[right] - both) - 1e-9
    left, right = left[linked], right[linked]
    links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find(i), find(j)
        if a != b:
            a, b = (a, b) if nodes[a] < nodes[b] else (b, a)
            root[b] = a
    return [(nodes[i], nodes[find(i)], int(links[i])) for i in np.flatnonzero(links)]


def _verify(threshold: float):
    """Compare the members of each bucket; rows arrive sorted by bucket."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, members = None, {}

        def close() -> list:
            if len(members) < 2:
                return []
            rows = sorted(members.items())
            sides = np.array([r[1][0] for r in rows])
            bands = np.stack([r[1][1] for r in rows])
            return _compare(key[0], key[2] != key[3], sides, [r[0] for r in rows], bands, [r[1][2] for r in rows], threshold)

        def out(rows: list):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["node", "root", "links"])

        for batch in batches:
            found = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)]))
            block, nodes = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            bands, bands_at = _flat(batch.column(6))
            grams, grams_at = _flat(batch.column(7))
            for i, k in enumerate(keys):
                if k != key:
                    found += close()
                    key, members = k, {}
                # Copies out of the batch, so that a bucket keeps no batch alive.
                members[nodes[i]] = (block[i] != k[2], bands[bands_at[i]:bands_at[i + 1]].copy(),
                                     grams[grams_at[i]:grams_at[i + 1]].copy())
            if found:
                yield out(found)
        found = close()
        if found:
            yield out(found)
    return run


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = TARGET_RECALL,
                    text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(doc_id, class_id, n_links, n_copies)`` for every row."""
    prepare(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    id_type = docs.schema[id_col].dataType
    id_type = id_type.simpleString() if isinstance(id_type, StructType) else "bigint"
    texts = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    signed = (texts.select("doc_id", hashed.alias("words"))
              .mapInArrow(_signatures(n, bands, rows), f"doc_id {id_type}, node binary, bands array<long>").checkpoint())
    nodes = (signed.filter("node IS NOT NULL").groupBy("node")
             .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")).checkpoint())

    # Buckets, one entry per node; copies are merged map-side.
    entries = (signed.filter("node IS NOT NULL").select("node", F.posexplode("bands").alias("band", "h"))
               .groupBy("band", "h", "node").agg(F.count("*").alias("c")).drop("c"))
    buckets = (entries.groupBy("band", "h").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("s1"),
        F.bit_xor(F.xxhash64("node", F.lit(5))).alias("s2")).filter("size > 1"))
    # The same members in several bands: only the first band is compared.
    kept = (buckets.groupBy("size", "s1", "s2").agg(F.min(F.struct("band", "h")).alias("k"))
            .select("k.band", "k.h", "size"))
    members = entries.join(kept, ["band", "h"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    members = members.select("band", "h", "node", blocks.alias("nb"), mine.alias("block"))
    places = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    places = places.select("node", F.struct(
        "band", "h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "block").alias("place"))
    # At most (bands x blocks of a bucket) places per node.
    wanted = places.groupBy("node").agg(F.collect_list("place").alias("places")).join(nodes, "node")
    wanted = wanted.select(F.col("rep"), F.col("node").alias("w_node"), "places")
    pick = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]))
    sets = (pick.select(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"), "w_node", "places")
            .mapInArrow(_node_sets(n, bands, rows),
                        "node binary, places array<struct<band:int,h:long,lo:int,hi:int,block:int>>, "
                        "bands array<long>, grams array<long>"))
    sent = sets.select(F.explode("places").alias("p"), "node", "bands", "grams")
    sent = sent.select("p.band", "p.h", "p.lo", "p.hi", "p.block", "node", "bands", "grams")
    key = ["band", "h", "lo", "hi"]
    links = (sent.repartition(*key).sortWithinPartitions(*key)
             .mapInArrow(_verify(threshold), "node binary, root binary, links long").checkpoint())
    labels = components(links, "node", "root")
    smallest = labels.join(nodes, "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = labels.join(smallest, "label").join(counts, "node").select("node", "class_id", "n_links")
    # Only nodes with copies or links are looked up.
    info = (nodes.join(linked, "node", "left").filter("n_copies > 1 OR n_links IS NOT NULL")
            .select("node", F.coalesce("class_id", "rep").alias("class_id"), "n_links", "n_copies").checkpoint())
    worded = signed.filter("node IS NOT NULL").select("doc_id", "node")
    wordless = signed.filter("node IS NULL").select("doc_id", "node")
    found = hot_lookup(worded, info, "node", "n_copies", signed.count()).select("doc_id", "node", "class_id", "n_links", "n_copies")
    return (found.unionByName(wordless, allowMissingColumns=True)
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")))


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` (all columns) with the document of smallest id of each class (null ids last).

    Rows that share an id are decided by their own texts; a row that repeats id and text stays or goes with the other.
    """
    key = text_key(F.col(text_col))
    keyed = docs.withColumn("__row", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")))
    classes = jaccard_classes(keyed, text_col=text_col, id_col="__row", **options)
    gone = classes.filter(F.col("doc_id") != F.col("class_id"))
    return drop_rows(docs, gone.select("doc_id.id", "doc_id.key"), key, id_col)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(load(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
