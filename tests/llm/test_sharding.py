import zlib
from collections import Counter, defaultdict

from newsloom.llm import sharding as S

from .fixtures import documents, empty, messy


def check(spark, texts, shards=16):
    df = documents(spark, texts)
    out = S.shard(df, shards).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in texts)
    counts = Counter(r.shard for r in out)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    text = defaultdict(list)
    for i, t in texts:
        text[i].append(t)
    for r in out:
        assert (r.size, r.text_crc32) in [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r.doc_id]]
        assert r.law == "rows" and r.grown_shard is None
    return out


def test_groups_stay_together(spark):
    texts = [(i, f"group {i % 40}" if i < 400 else f"own {i}") for i in range(1600)]
    out = check(spark, texts)
    place = {r.doc_id: r.shard for r in out}
    for g in range(40):
        assert len({place[i] for i in range(400) if i % 40 == g}) == 1


def test_hot_group_is_split_by_quota(spark):
    texts = [(i, "hot") for i in range(700)] + [(i, f"own {i}") for i in range(700, 1600)]
    out = check(spark, texts)
    held = Counter(r.shard for r in out if r.doc_id < 700)
    assert len(held) <= 9 and sum(n == 100 for n in held.values()) >= 6


def test_same_shards_under_any_partitioning(spark):
    texts = [(i, f"group {i % 30}" if i < 300 else "hot" if i < 600 else f"own {i}") for i in range(1200)] + [(None, "x"), (5, "group 5"), (5, "group 5")]
    one, two = (sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in S.shard(documents(spark, t, n)).collect()), key=str)
                for t, n in ((texts, 1), (texts[::-1], 7)))
    assert one == two


def test_only_links(spark):
    check(spark, [(i, f"g{i % 3}") for i in range(203)])


def test_messy_and_empty(spark):
    df = messy(spark)
    check(spark, [(r.doc_id, r.text) for r in df.collect()], 4)
    check(spark, [(1, "a")], 16)
    assert S.shard(empty(spark)).collect() == []
