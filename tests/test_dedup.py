import random

import duckdb

from newsloom.operators import dedup, greedy
from newsloom.plans.textdedup import TFIDF_CTE
from tests.conftest import SF01


def test_greedy_fixture(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6)], "lo long, hi long")
    got = {r.node for r in greedy.greedy_select(edges).collect() if r.kept}
    assert got == {1, 3, 4}


def test_greedy_matches_ordered_walk_on_random_graphs(spark):
    rnd = random.Random(7)
    rows, expected = [], {}
    for g in range(40):
        n = rnd.randint(2, 14)
        p = rnd.choice([0.15, 0.3, 0.5])
        es = [(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < p]
        base = g * 100
        rows += [(base + i, base + j) for i, j in es]
        in_graph = sorted({x for e in es for x in e})
        expected.update({base + i: (i in greedy.greedy_python(in_graph, es)) for i in in_graph})
    edges = spark.createDataFrame(rows, "lo long, hi long")
    got = {r.node: r.kept for r in greedy.greedy_select(edges).collect()}
    assert got == expected


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("", 5)], "url string, seq int")
    first = {(r.url, r.seq) for r in dedup.dedupe_by_key(df, "url", "seq").collect()}
    last = {(r.url, r.seq) for r in dedup.dedupe_by_key(df, "url", "seq", last=True).collect()}
    assert first == {("a", 1), ("b", 2)}
    assert last == {("a", 3), ("b", 2)}


def test_seen_anti_join_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    seen = spark.createDataFrame([("a",)], "url string")
    assert sorted(r.url or "" for r in dedup.unseen(df, seen).collect()) == ["", "b"]


def test_greedy_dedup_matches_reference_walk_sf001(spark):
    """D7 on whole sf0.01 documents vs. the ordered walk over all-pairs cosines (DuckDB)."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    pairs = con.sql(f"""
        WITH {TFIDF_CTE}
        SELECT a.id, b.id FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id
        GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.85""").fetchall()
    ids = [r[0] for r in con.sql("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    expected = greedy.greedy_python(ids, pairs)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    out = dedup.greedy_dedup(docs, "doc_id", "text", "doc_id", 0.85).collect()
    assert len(out) == len(ids)
    assert {r.doc_id for r in out if r.kept} == expected
    reasons = {r.reason for r in out}
    assert reasons <= {"kept", "exact_copy", "near_duplicate"}


def test_zero_vector_copies_are_kept(spark):
    docs = spark.createDataFrame([(1, "!!"), (2, "!!"), (3, "same words here"), (4, "same words here")],
                                 "id long, text string")
    got = {r.id: r.reason for r in dedup.greedy_dedup(docs, "id", "text").collect()}
    assert got == {1: "kept", 2: "kept", 3: "kept", 4: "exact_copy"}


def _expanded_pair_count(spark, docs):
    """All-pairs count implied by representative pairs + copy groups (copies have cosine 1)."""
    from pyspark.sql import functions as F
    pairs = dedup.near_duplicate_pairs(docs, "doc_id", "text", threshold=0.85)
    copies = dedup.exact_copies(docs, "doc_id", "text", "doc_id").filter("is_rep").select("rep", "n_copies")
    n = {r.rep: r.n_copies for r in copies.collect()}
    cross = sum(n[r.doc_a] * n[r.doc_b] for r in pairs.collect())
    has_tokens = {r.id for r in docs.select(F.col("doc_id").alias("id"), "text")
                  .filter(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)) > 0).collect()}
    within = sum(c * (c - 1) // 2 for rep, c in n.items() if rep in has_tokens)
    return cross + within


def test_golden_pair_counts_sf001(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    assert _expanded_pair_count(spark, docs) == 190
    sig = docs.select("doc_id", F.concat(F.substring("text", 1, 80), F.lit(" "), F.substring("text", 1, 300)).alias("text"))
    assert _expanded_pair_count(spark, sig) == 176


def _greedy(spark, edges, **options):
    from newsloom.operators import greedy
    rows = greedy.greedy_select(spark.createDataFrame(edges, "lo long, hi long"), **options).collect()
    return {r.node for r in rows if r.kept}, {r.node for r in rows}


def test_greedy_equals_the_walk_for_any_ranges_and_numbers(spark):
    import random

    from newsloom.operators import greedy
    rng = random.Random(5)
    for size, numbers in ((1, "sorted"), (7, "sorted"), (40, "mixed"), (10_000, "mixed")):
        order = list(range(60)) if numbers == "sorted" else rng.sample(range(1000), 60)
        edges = [(order[i], order[j]) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.08 or j == i + 1]
        kept, nodes = _greedy(spark, edges + edges[:5], range_edges=size)
        assert kept == greedy.greedy_python(order, edges) & nodes, (size, numbers)


def test_a_chain_of_ten_thousand_settles_in_tens_of_jobs(spark):
    """Every row is similar to the next one only: each depends on all before it."""
    n = 10_000
    spark.sparkContext.setJobGroup("greedy-chain", "chain")
    kept, _ = _greedy(spark, [(i, i + 1) for i in range(n)], range_edges=2_000)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy-chain"))
    spark.sparkContext.setJobGroup("", "")
    assert kept == set(range(0, n + 1, 2))
    assert jobs < 100, jobs
