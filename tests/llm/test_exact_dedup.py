import hashlib
from collections import Counter, defaultdict

from newsloom.llm import exact_dedup as D

from .fixtures import documents, empty, messy


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(df):
    texts = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(texts)
    got = D.exact_groups(df).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    assert Counter((r.doc_id, sha[r.text_sha256]) for r in got) == Counter((i, t or "") for i, t in texts)
    for r in got:
        assert (r.keep_id, r.group_size) == want[sha[r.text_sha256]]
    kept = Counter(sha[r.text_sha256] for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(want, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_messy_rows(spark):
    check(messy(spark))


def test_empty_table(spark):
    assert D.exact_groups(empty(spark)).collect() == []
    assert D.keep_rows(empty(spark)).collect() == []


def test_hot_text_over_many_ranges(spark):
    """One text holds a third of the rows and spans several sorted ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = [(i, "hot text" if i % 3 == 0 else f"text {i % 50}" if i % 3 == 1 else f"own {i}") for i in range(600)]
        df = documents(spark, texts + [(i, "hot text") for i in (0, 3, 597)], 5)
        check(df)
        pids = (df.select("doc_id", "text").repartitionByRange("text", "doc_id").rdd.getNumPartitions())
        assert pids > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_keep_rows_keeps_one_row_per_text(spark):
    df = messy(spark)
    out = D.keep_rows(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert Counter(texts) == Counter(dict.fromkeys({r.text or "" for r in df.collect()}, 1))
    by_text = {r.text: r.doc_id for r in out.collect()}
    assert by_text["alpha beta gamma"] == 5 and by_text["one"] == 9
