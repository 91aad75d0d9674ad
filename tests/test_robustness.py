"""Probes of the cases that the oracles' tables do not hold: nulls, failing rows, replays, long streams."""

import datetime as dt

import pytest
from newsloom import session
from newsloom.functions import html_tree as HT
from newsloom.operators import adapt, dedup, enrich, filters, ranking
from newsloom.plans import streamq
from newsloom.sources import catalog, files
from newsloom.streaming import streams as S
from pyspark.sql import functions as F


def test_greedy_dedup_returns_null_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "alpha beta gamma"), (4, None), (5, "")], "id long, text string")
    out = {r.id: r.reason for r in dedup.greedy_dedup(df).collect()}
    assert out == {1: "kept", 2: "kept", 3: "exact_copy", 4: "kept", 5: "kept"}


def test_first_wins_with_null_and_tied_order(spark):
    df = spark.createDataFrame([("u1", None, "a"), ("u1", None, "b"), ("u2", None, "c"), ("u2", 5, "d"), ("u3", 1, "e"), ("u3", 1, "f")],
                               "url string, ord int, v string")
    rows = {r.url: (r.ord, r.v) for r in ranking.first_wins(df, "url", "ord").collect()}
    assert rows["u1"][1] in ("a", "b") and rows["u2"] == (5, "d") and rows["u3"][0] == 1
    again = {r.url: (r.ord, r.v) for r in ranking.first_wins(df.repartition(7), "url", "ord").collect()}
    assert rows == again
    assert {r.url: r.v for r in ranking.first_wins(df, "url", "ord", last=True).collect()}["u2"] == "d"


def test_one_failing_row_keeps_the_others(spark):
    def poisoned():
        def call(texts):
            if any("poison" in t for t in texts):
                raise ValueError("poisoned")
            return ["Positive"] * len(texts)
        return call

    df = spark.createDataFrame([(i, "en", "poison " * 10 if i == 7 else f"a text that is long enough, number {i}") for i in range(50)],
                               "id long, language string, text string").coalesce(1)
    out = {r.id: r.label for r in enrich.classify(df, models={"en": poisoned}).collect()}
    assert out.pop(7) == "neutral" and set(out.values()) == {"positive"}


def test_enrichment_error_gives_empty_summary(spark):
    def poisoned():
        def call(prompts):
            if any("poison" in p for p in prompts):
                raise ValueError("poisoned")
            return ["SUMMARY: a summary that is long enough to be taken just as it stands here. SENTIMENT: Positive"] * len(prompts)
        return call

    df = spark.createDataFrame([(i, "poison text" if i == 3 else f"text {i}", "s") for i in range(20)],
                               "id long, full_text string, summary string").coalesce(1)
    out = {r.id: (r.enriched_summary, r.enriched_sentiment) for r in enrich.enrich(df, model=poisoned).collect()}
    assert out.pop(3) == ("", "Neutral") and set(out.values()) == {("a summary that is long enough to be taken just as it stands here.", "Positive")}


def test_ids_beyond_the_int_range(spark):
    docs = spark.createDataFrame([(70_000_000, "t", "en", "s"), (3, "t", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.id: r.published_ts for r in adapt.news_view(docs, labels).collect()}
    epoch = dt.datetime(2024, 1, 1)
    assert got[3] == epoch + dt.timedelta(minutes=111)
    assert got[70_000_000] == epoch + dt.timedelta(minutes=37 * 70_000_000)


def test_counts_of_a_stream_of_120_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i in range(120):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(src)
    stream = S.file_stream(spark, src, spark.range(1).schema, max_files_per_trigger=1).observe("input", F.count(F.lit(1)).alias("rows"))
    q = S.run_available_now(stream, f"{tmp_path}/ck", lambda batch, n: batch.write.format("noop").mode("append").save())
    assert S.observed_count(q, "input", "rows") == 120


def test_replayed_batch_decides_as_before(spark, tmp_path):
    sink = streamq.semantic_batch_sink(spark, f"{tmp_path}/hist", f"{tmp_path}/dec", 0.9)
    schema = "id long, vec array<float>, label string, ts timestamp"
    t0 = dt.datetime(2024, 1, 1, 12)
    first = spark.createDataFrame([(1, [1.0, 0.0], "x", t0), (2, [0.0, 1.0], "x", t0), (3, [1.0, 0.01], "x", t0)], schema)
    second = spark.createDataFrame([(4, [1.0, 0.0], "x", t0 + dt.timedelta(hours=20)), (5, [-1.0, 0.0], "x", t0 + dt.timedelta(hours=20))], schema)

    def decisions():
        return {r.id: r.decision for r in spark.read.parquet(f"{tmp_path}/dec").collect()}

    sink(first, 0)
    sink(second, 1)
    before = decisions()
    assert before == {1: "inserted", 2: "inserted", 3: "semantic_batch", 4: "semantic_history", 5: "inserted"}
    sink(first, 0)
    sink(second, 1)
    assert decisions() == before
    assert spark.read.parquet(f"{tmp_path}/hist").count() == 3


def test_published_rows_are_the_marked_rows(spark, tmp_path):
    run = S.publish_then_mark(f"{tmp_path}/out", f"{tmp_path}/seen")
    rows = spark.range(100).select((F.rand() * 1000).cast("int").cast("string").alias("url"))   # changes when evaluated again
    run(rows, 0)
    published = {r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert published == {r.url for r in spark.read.parquet(f"{tmp_path}/seen").collect()}


def test_json_array_records_keep_their_order(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('[{"url": "z", "full_text": "1"}, {"url": "a", "full_text": "2"}, {"url": "m", "full_text": "3"}]')
    (tmp_path / "a" / "seen.json").write_text('[{"url": "no", "full_text": "0"}]')
    recs = files.read_json_records(spark, [f"file://{tmp_path}/a"], require_any=("full_text",))
    assert [r.url for r in recs.orderBy("source_file", "source_pos").collect()] == ["z", "a", "m"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "y.json").write_text('{"url": "z", "full_text": "1"}\nbroken\n\n{"url": "a", "full_text": "2"}\n')
    recs = files.read_json_records(spark, [f"file://{tmp_path}/l"], require_any=("full_text",), lines=True)
    assert [r.url for r in recs.orderBy("source_file", "source_pos").collect()] == ["z", "a"]
    assert [r.lines for r in files.unreadable_lines(spark, [f"file://{tmp_path}/l"]).collect()] == [1]


def test_added_columns_of_an_older_table(spark, tmp_path):
    name = "older_table_for_migration"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (id BIGINT, title STRING) USING parquet LOCATION 'file://{tmp_path}/t'")
    spark.sql(f"INSERT INTO {name} VALUES (1, 'old')")
    try:
        columns = catalog.ensure_table(spark, name, f"file://{tmp_path}/t")
        assert {c for c, _ in catalog.NEWS_DDL_COLUMNS} <= set(columns)
        row = spark.table(name).first()
        assert (row.id, row.title, row.sentiment) == (1, "old", None)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        filters.require_columns(spark.range(1), ["id", "text"])


def test_nested_containers():
    inner = HT._inner_elements("<article>first part <article>quote</article> and the rest</article>", [("article", "", "")])
    assert inner == ["first part <article>quote</article> and the rest"]
    page = '<p>menu</p><div class="a newsStory"><div>x</div><p>open</div>'
    assert HT._inner_elements(page, [("", "", "articleBody"), ("div", "newsStory", "")]) == ["<div>x</div><p>open"]
    assert HT._inner_elements("no tags", [("div", "", "")]) == []


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(FakeSession())
