import datetime as dt
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import filters, paging, seen_filter, sketches, text_index, tfidf, tfidf_state
from newsloom.streaming import streams as S

TEXTS = ["The quick brown fox", "quick!", "QUICKsand and fo", None, "", "ab", "ünïcode ÜNÏ text", "100% of a_b", "fox " * 3000,
         "日本語のテキスト", "😀😀 smile 😀x", "line\nbreak the fox"]


def _texts(spark):
    rows = [(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, title string, summary string").repartition(3)


def test_trigram_search_equals_the_scan(spark, tmp_path):
    df, path = _texts(spark), str(tmp_path)
    text_index.build(df, path, ["title", "summary"])
    for term in ("quick", "QUICK", "fox", "the", "fo", "a", "", "zzz", "quickx", "%", "100%", "a_b", "axb", "ÜNÏ", "本語の", "😀😀", "😀 smile",
                 "k\nb", "fox fox fox fox", "k brown"):
        want = filters.search_filter(df, term)
        got = text_index.search(df, path, term, ["title", "summary"])
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), term


def test_trigram_search_opens_its_buckets_only(spark, tmp_path):
    df, path = _texts(spark), str(tmp_path)
    text_index.build(df, path, ["title", "summary"])
    plan = text_index.candidates(spark, path, "quicksand")._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan)[1].split(",")
    assert 0 < len(opened) <= text_index.PROBES and "PushedFilters: [In(gram" in plan
    text_index.build(df.limit(0), f"{path}/empty", ["title"])
    assert text_index.search(df.limit(0), f"{path}/empty", "quick", ["title"]).collect() == []


def _grams(*texts):
    return {t.lower()[i:i + 3] for t in texts if t for i in range(len(t.lower()) - 2)}


@pytest.mark.parametrize("stretch, id_type", [(1, "long"), (40, "string")])
def test_trigram_postings_hold_every_document(spark, tmp_path, stretch, id_type):
    df, path = _texts(spark).withColumn("id", F.col("id").cast(id_type)), str(tmp_path)
    text_index.build(df, path, ["title", "summary"], stretch=stretch)
    want = {(g, r.id) for r in df.collect() for g in _grams(r.title, r.summary)}
    got = [(r.gram, i) for r in text_index._postings(spark, path).collect() for i in r.ids]
    assert len(got) == len(want) and set(got) == want
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {g: sum(g == h for h, _ in want) for g, _ in want}
    got = text_index.search(df, path, "😀 smile", ["title", "summary"])
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in filters.search_filter(df, "😀 smile").collect())


def test_trigram_postings_are_blocks_of_documents(spark, tmp_path):
    """A stretch of rows writes one posting row per trigram, not one per trigram and document."""
    df = spark.range(600).select("id", F.concat(F.lit("the same words "), F.col("id") % 3).alias("title")).coalesce(2)
    text_index.build(df, str(tmp_path), ["title"])
    pairs = sum(len(_grams(r.title)) for r in df.collect())
    assert spark.read.parquet(f"{tmp_path}/postings").count() <= pairs / 100
    assert text_index.search(df, str(tmp_path), "words 1", ["title"]).count() == 200


def test_trigrams_of_more_letters_than_a_key_holds():
    letters = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000][:320_000]
    texts = ["".join(letters[i::500]) for i in range(500)]
    found = [*text_index._inverted(pa.table({"id": range(500), "a": texts, "b": [None, *texts[1:]]}))]
    pairs = [(g, i) for b in found for g, ids in zip(b["gram"].to_pylist(), b["ids"].to_pylist(), strict=True) for i in ids]
    assert len(found) > 1 and len(pairs) == 500 * 638
    assert set(pairs) == {(t[k:k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)}


def _keys(spark, values):
    return spark.createDataFrame([(v, 1) for v in values], "key string, x int").repartition(3)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_seen_set_is_exact(spark, tmp_path, monkeypatch, limit):
    """Runs, a repeated run, compaction, nulls and repeats; with the filter and with one too large to use."""
    monkeypatch.setattr(seen_filter, "MAX_FILTER_BYTES", limit)
    path = str(tmp_path / "seen")
    seen = seen_filter.SeenSet(spark, path, 300)
    batch = spark.createDataFrame([(None if i % 50 == 49 else f"u{i % 400}", i) for i in range(600)], "url string, id long").repartition(4)
    assert seen.unseen(batch).count() == 600
    assert seen.add(_keys(spark, [f"u{i}" for i in range(0, 100)] + [None, "u5", ""]), run="a").count() == 101
    assert seen.add(_keys(spark, [f"u{i}" for i in range(50, 200)]), run="b").count() == 100
    assert seen.add(_keys(spark, [f"u{i}" for i in range(50, 200)]), run="b").count() == 100   # a replay loses nothing
    known = {f"u{i}" for i in range(200)}

    def check(s):
        want = sorted(r.id for r in batch.collect() if r.url not in known)
        assert sorted(r.id for r in s.unseen(batch).collect()) == want
        assert sorted(s.unseen(batch).columns) == sorted(batch.columns)

    check(seen)
    seen.compact()
    again = seen_filter.SeenSet(spark.newSession(), path)
    assert again.bits == seen.bits and again.keys().count() == 201
    check(again)
    again.add(_keys(spark, ["u300"]), run="c")
    known.add("u300")
    check(seen)


def test_few_new_keys_reach_the_join(spark, tmp_path):
    seen = seen_filter.SeenSet(spark, str(tmp_path), 5000)
    seen.add(_keys(spark, [f"old{i}" for i in range(5000)]))
    new = _keys(spark, [f"new{i}" for i in range(5000)])
    assert new.filter(seen.maybe_seen(F.col("key"))).count() < 0.03 * 5000
    old = _keys(spark, [f"old{i}" for i in range(5000)])
    assert old.filter(seen.maybe_seen(F.col("key"))).count() == 5000   # never a miss


def test_pages_equal_the_sorted_slices(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(53)], "id long, rank int").repartition(5)
    path = str(tmp_path)
    paging.store(df, [F.col("rank"), F.col("id").desc()], path, block_rows=8)
    order = [r.id for r in df.orderBy("rank", F.col("id").desc()).collect()]
    for per_page in (1, 5, 8, 20, 100):
        assert paging.pages(spark, path, per_page) == -(-53 // per_page)
        for page in (1, 2, paging.pages(spark, path, per_page), 99):
            got = [r.id for r in paging.page(spark, path, page, per_page).collect()]
            assert got == order[(page - 1) * per_page:page * per_page]
    plan = paging.page(spark, path, 2, 8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(block#\d+L?\), \(block#\d+L? >= 1\), \(block#\d+L? <= 1\)\]", plan), plan   # one range
    paging.store(df.limit(0), [F.col("id")], f"{path}/empty")
    assert paging.page(spark, f"{path}/empty", 1, 10).collect() == [] and paging.pages(spark, f"{path}/empty", 10) == 1


def test_incremental_weights_equal_a_recompute(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["one two two", "two three", None, "", "four one one", "three", "one two two", "five"])], "id long, text string")
    path = str(tmp_path / "state")
    for run in range(4):
        tfidf_state.add_run(docs.filter(F.col("id") % 4 == run), path, str(run))
    tfidf_state.add_run(docs.filter(F.col("id") % 4 == 1), path, "1")   # a replay counts once
    whole = {(r.id, r.term): (r.df, round(r.w, 12)) for r in tfidf.tfidf(docs).collect()}
    batch = docs.filter(F.col("id") % 4 == 0)
    for state in (path, str(tmp_path / "one")):
        got = {(r.id, r.term): (r.df, round(r.w, 12)) for r in tfidf_state.vectors(batch, state).collect()} if state == path else got
        assert got == {k: v for k, v in whole.items() if k[0] % 4 == 0}
    tfidf_state.compact(spark, path, str(tmp_path / "one"))
    assert {(r.id, r.term): (r.df, round(r.w, 12)) for r in tfidf_state.vectors(batch, str(tmp_path / "one")).collect()} == got
    assert tfidf_state.vectors(batch, str(tmp_path / "none")).collect() == []


def test_merged_sketches_stay_in_their_bounds(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=i % 240), f"v{(i * 7919) % 6000}", f"w{min(i % 97, i % 13)}") for i in range(24_000)] + [(None, "x", "y")]
    df = spark.createDataFrame(rows, "published_ts timestamp, value string, item string")
    now = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    days = sketches.daily(df, ["value"]).checkpoint()
    got = {r.days: r for r in sketches.merged(days, ["value"], now, (1, 7, 30)).collect()}
    for n in (1, 7, 30):
        inside = [r for r in rows if r[0] and 0 <= (dt.date(2024, 1, 10) - r[0].date()).days < n]
        exact = len({v for _, v, _ in inside})
        assert got[n].rows == len(inside)
        assert abs(got[n].value - exact) <= 4 * sketches.relative_error() * exact + 1
    items = sketches.daily_items(df, "item")
    count = {}
    for t, _, w in rows:
        if t and 0 <= (dt.date(2024, 1, 10) - t.date()).days < 7:
            count[w] = count.get(w, 0) + 1
    top = sketches.top_items(items, now, 7, 5).collect()
    assert sorted((r["count"] for r in top), reverse=True) == sorted(count.values(), reverse=True)[:5]
    assert all(count[r.item] == r["count"] for r in top)


def test_panes_are_repeated_not_events(spark):
    panes = spark.createDataFrame([(dt.datetime(2024, 1, d), 10 * d, d, 1) for d in (1, 2, 5)],
                                  "window_start timestamp, count long, positive long, negative long")
    got = {r.window_start.day if r.window_start.month == 1 else -r.window_start.day: r["count"] for r in S.windows_from_panes(panes, 3).collect()}
    assert got == {-30: 10, -31: 30, 1: 30, 2: 20, 3: 50, 4: 50, 5: 50}


def test_top_items_over_days_out_of_range_and_many_words(spark, tmp_path):
    """Partitions without a day in range, and more words than the sketches follow."""
    from newsloom.operators import sketches
    words = [("2024-01-%02d 08:00:00" % (1 + i % 26), f"w{i % 6000}") for i in range(30000)]
    words += [("2024-01-%02d 09:00:00" % (20 + i % 7), f"top{i % 5}") for i in range(1500 + 10)] + [("2024-01-25 09:00:00", "top0")] * 7
    df = spark.createDataFrame(words, "ts string, item string").withColumn("published_ts", F.to_timestamp("ts")).repartition(4)
    now = F.to_timestamp(F.lit("2024-01-26 00:00:00"))
    path = str(tmp_path / "items")
    sketches.daily_items(df, "item", tracked=100).repartition(8, "day").write.parquet(path)
    days = spark.read.parquet(path).repartition(16)
    got = [(r["item"], r["count"]) for r in sketches.exact_top_items(df, days, "item", now, 7, 5, tracked=100, candidates=50).collect()]
    want = (df.filter("published_ts >= '2024-01-20' AND published_ts < '2024-01-27'").groupBy("item").count()
            .orderBy(F.col("count").desc(), "item").limit(5).collect())
    assert got == [(r["item"], r["count"]) for r in want] and got[0][1] > 300
    assert sketches.top_items(days, F.to_timestamp(F.lit("2023-01-01 00:00:00")), 7, 5, 100).collect() == []
