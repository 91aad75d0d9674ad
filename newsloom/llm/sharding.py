"""Sharding by balanced label propagation (DataFrame functions only).

Linked documents (here: those with equal texts) should share a shard while every shard holds the same
number of rows.  The state is one narrow row per document: its link group and its current shard.

1. Start: documents are dealt out by a hash of their id and text, unlinked ones as well.  All orders follow that hash,
   so the result does not depend on how the input is partitioned.
2. Rounds of iterative joins: a group's members per shard are counted (map-side first), every member wants
   to move to the shard where most of its group already is, and moves are admitted under quotas.  A shard may
   take in as many documents as it has room for, once linked documents that want to leave and unlinked
   documents, which may stand anywhere, are counted out.  A group larger than a shard's quota fills its
   favourite shard and goes on with its next best one in the following round.
3. Repair: linked documents come first, unlinked ones fill up; what exceeds a shard's exact quota (unlinked
   rows first, since they rank last) moves to the free places of the other shards.  Afterwards the counts
   are at most one apart (law ``rows``).

Ranks and slots are numbered inside hash buckets and offset by bucket sums, so no shard is sorted in one
task.  Only per-shard counts (``shards`` squared numbers at most) reach the driver.

Defined cases: a null text has size 1 and counts as equal to other null texts only; rows repeated with the
same id are separate rows; null ids are allowed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import hot_lookup, load, positions_by_key, prepare, utf8_size

SHARDS = 16
ROUNDS = 2 * SHARDS   # at most; rounds end when no group has anywhere to go


def text_nodes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(row, doc_id, skey, size, text_crc32, group)``; ``group`` is a digest of the text, null texts share one.

    ``skey`` depends on id and text only and decides all orders; ``row`` tells repeated rows apart.
    """
    text = F.col(text_col)
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
        F.xxhash64(id_col, F.coalesce(F.md5(text.cast("binary")), F.lit("null")), F.lit(31)).alias("skey"),
        (utf8_size(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group"))


def quotas(total: int, shards: int) -> list[int]:
    """Rows of each shard: as even as can be."""
    return [total // shards + (1 if s < total % shards else 0) for s in range(shards)]


def _table(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A tiny literal table (one row per shard at most)."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def propagate(linked: DataFrame, room: list[int], shards: int, rounds: int) -> DataFrame:
    """Move the members of link groups towards the shard where most of their group is.

    ``linked`` has ``row, skey, group, shard``; ``room[s]`` is the number of linked
    documents that shard ``s`` may hold in all.
    """
    total = linked.count()
    state = linked.withColumn("settled", F.lit(False))
    for _ in range(rounds):
        held = state.groupBy("group", "shard").agg(
            F.count("*").alias("k"), F.max("settled").alias("closed"),
            F.count(F.when(~F.col("settled"), 1)).alias("open")).checkpoint()
        # Shards that are full of settled groups take no more.
        settled = {r["shard"]: r["n"] for r in
                   state.filter("settled").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        free = [max(0, room[s] - settled.get(s, 0)) for s in range(shards)]
        open_to = _table(state.sparkSession, "shard, room", [(s, f) for s, f in enumerate(free)])
        wanted = (held.filter("NOT closed").join(F.broadcast(open_to.filter("room > 0")), "shard")
                  .groupBy("group").agg(F.max(F.struct("k", (-F.xxhash64("group", "shard")).alias("t"), "shard")).alias("m"))
                  .select("group", F.col("m.shard").alias("goal")))
        waiting = held.groupBy("group").agg(F.sum("open").alias("n")).filter("n > 0")
        goals = waiting.join(wanted, "group").checkpoint()
        if goals.isEmpty():
            break
        # Quota: groups are admitted, large ones first, until the room of the goal is used up.
        ordered = _cumulative(goals, "goal", "n")
        admitted = (ordered.join(F.broadcast(open_to.select(F.col("shard").alias("goal"), "room")), "goal")
                    .select("group", "goal", "n", F.least(F.col("n"), F.greatest(F.col("room") - F.col("before"), F.lit(0)))
                            .alias("quota")).filter("quota > 0"))
        state = _move(state, admitted, total).checkpoint()
    return state.select("row", "skey", "shard")


def _cumulative(df: DataFrame, part: str, amount: str, key: str = "group", rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the rows of the same ``part`` that come earlier (large first)."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    rank = -F.floor(F.log2(F.col(amount))).cast("int")   # large groups choose first
    b = F.struct(rank.alias("r"), F.pmod(F.xxhash64(key, F.lit(23)), F.lit(buckets)).cast("int").alias("b"))
    tagged = df.withColumn("__b", b)
    sums = tagged.groupBy(part, "__b").agg(F.sum(amount).alias("__s"))
    w = Window.partitionBy(part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, "__b", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(part, "__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("__in", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(offsets, [part, "__b"])
            .withColumn("before", F.col("__off") + F.col("__in")).drop("__b", "__in", "__off"))


def _move(state: DataFrame, admitted: DataFrame, total: int) -> DataFrame:
    """Settle up to ``quota`` members of each admitted group in its goal, members already there first."""
    open_rows = state.filter("NOT settled")
    offers = hot_lookup(open_rows, admitted.withColumnRenamed("n", "uses"), "group", "uses", total)
    none = offers.filter("goal IS NULL").select("row", "skey", "group", "shard", F.lit(False).alias("settled"))
    whole = (offers.filter("goal IS NOT NULL AND quota >= uses")
             .select("row", "skey", "group", F.col("goal").cast("int").alias("shard"), F.lit(True).alias("settled")))
    # A group that its goal can't take whole is cut by an exact rank; at most one per shard and round.
    cut = offers.filter("goal IS NOT NULL AND quota < uses").checkpoint()
    ranked = positions_by_key(cut, "group", [F.when(F.col("shard") == F.col("goal"), 0).otherwise(1), F.col("skey"), F.col("row")], key="skey")
    stays = F.col("pos") < F.col("quota")
    cut = ranked.select("row", "skey", "group", F.when(stays, F.col("goal")).otherwise(F.col("shard")).cast("int").alias("shard"),
                        stays.alias("settled"))
    return state.filter("settled").unionByName(none).unionByName(whole).unionByName(cut)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text_col: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row, under the law ``rows``."""
    spark = docs.sparkSession
    prepare(spark)
    nodes = text_nodes(docs, text_col, id_col).checkpoint()
    total = nodes.count()
    out = ["doc_id", "size", "text_crc32"]
    law = [F.lit("rows").alias("law")]
    if total == 0:
        return nodes.select(*out, *law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
                            F.lit(None).cast("int").alias("grown_shard"))
    quota = quotas(total, shards)
    groups = nodes.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    start = F.pmod(F.xxhash64("skey", F.lit(29)), F.lit(shards)).cast("int").alias("shard")
    size_of = groups.withColumnRenamed("n", "uses")
    dealt = hot_lookup(nodes.select("row", "skey", "group"), size_of, "group", "uses", total)
    linked = dealt.filter("uses IS NOT NULL").select("row", "skey", "group", start).checkpoint()
    moved = propagate(linked, quota, shards, rounds)
    single = dealt.filter("uses IS NULL").select("row", "skey", start)
    rank = F.lit(0).alias("rank")
    placed = (moved.select("row", "skey", "shard", rank)
              .unionByName(single.select("row", "skey", "shard", F.lit(1).alias("rank"))).checkpoint())
    # Repair: rows beyond the quota of a shard (unlinked ones rank last) fill the free places of the others.
    numbered = positions_by_key(placed, "shard", [F.col("rank"), F.col("skey"), F.col("row")], key="skey").checkpoint()
    counts = {r["shard"]: r["n"] for r in numbered.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    limits = F.broadcast(_table(spark, "s, quota", list(enumerate(quota))))
    numbered = numbered.join(limits, numbered["shard"] == F.col("s")).drop("s")
    fine = numbered.filter("pos < quota").select("row", "shard", F.col("pos").alias("slot"))
    spare = numbered.filter("pos >= quota").select("row", "skey", "rank", F.lit(0).alias("pool")).checkpoint()
    holes, at = [], 0
    for s in range(shards):
        gap = quota[s] - counts.get(s, 0)
        if gap > 0:
            holes.append((s, at, at + gap, counts.get(s, 0)))
            at += gap
    if holes:
        queue = positions_by_key(spare, "pool", [F.col("rank"), F.col("skey"), F.col("row")], key="skey")
        # The place in the queue decides the shard: one branch per shard at most.
        place = None
        for s, lo, hi, first in holes:
            there = F.struct(F.lit(s).alias("shard"), (F.col("pos") - lo + first).alias("slot"))
            inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
            place = F.when(inside, there) if place is None else place.when(inside, there)
        fine = fine.unionByName(queue.select("row", place.alias("p")).select("row", "p.shard", "p.slot"))
    return (nodes.join(fine, "row")
            .select(*out, *law, "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
