"""What reaches Python workers and the driver stays bounded: batches, columns, parser classes, gradients."""

from __future__ import annotations

import gc

from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.functions import dates, html_tree
from newsloom.operators import enrich, labels
from newsloom.session import ARROW_ROWS, bound_arrow_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_queries_run_on_small_arrow_batches(spark):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        entry._prepare(spark)
        assert int(spark.conf.get(KEY)) == ARROW_ROWS
        spark.conf.set(KEY, "20")
        bound_arrow_batches(spark)
        assert spark.conf.get(KEY) == "20"
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_pages_leave_no_parser_classes_behind():
    from html.parser import HTMLParser
    html_tree._strip_junk("<p>a</p>", ["nav"], [], [])
    html_tree._inner_elements("<main>a</main>", [("main", "", "")])
    gc.collect()
    gc.disable()
    try:
        n = len(HTMLParser.__subclasses__())
        for _ in range(20):
            assert html_tree._strip_junk("<nav><p>x</p></nav><p class='share'>b</p><p>a</p>", ["nav"], [], ["share"]) == "<p>a</p>"
            assert html_tree._inner_elements("<main>a<main>b</main></main>", [("main", "", "")]) == ["a<main>b</main>"]
        assert len(HTMLParser.__subclasses__()) == n
    finally:
        gc.enable()


def test_pages_of_all_kinds_through_the_columns(spark):
    df = spark.createDataFrame([(1, "<main><nav>n</nav><p>ä&amp;b</p></main>"), (2, None), (3, "")], "id long, html string")
    got = {r.id: (r.a, r.b) for r in df.select("id", html_tree.remove_junk_nested(F.col("html")).alias("a"),
                                               html_tree.inner_elements(F.col("html"), ["main"]).alias("b")).collect()}
    assert got == {1: ("<main><p>ä&amp;b</p></main>", ["<nav>n</nav><p>ä&amp;b</p>"]), 2: (None, []), 3: ("", [])}


def test_models_are_sent_what_they_read(spark):
    body = "great success " * 1000
    df = spark.createDataFrame([(1, "en", body, "s"), (2, None, None, None), (3, "xx", " " * 40 + "bad", ""), (4, "de", "war " * 10, "x")],
                               "id long, language string, full_text string, summary string")
    got = enrich.classify(df, "full_text", "language")
    assert got.columns == [*df.columns, "label"]
    assert {r.id: r.label for r in got.collect()} == {1: "positive", 2: "neutral", 3: "neutral", 4: "negative"}
    plans = [got, enrich.enrich(df)]
    for p in plans:
        assert "MapInPandas" not in p._jdf.queryExecution().executedPlan().toString()
    out = {r.id: r for r in plans[1].collect()}
    assert out[1].enriched_sentiment == "Positive" and out[2].enriched_summary == "" and out[4].enriched_sentiment == "Negative"
    assert plans[1].columns == [*df.columns, "enriched_summary", "enriched_sentiment"]


def test_gradients_are_merged_on_executors():
    assert labels.sentiment_classifier_spec().getStages()[-1].getAggregationDepth() >= 4


def test_arabic_dates_are_prepared_once_per_row(spark):
    df = spark.createDataFrame([("الأربعاء، ١٥ يناير ٢٠٢٥ - ٠٣:٤٥ م",), ("x",), (None,)], "s string")
    whole = dates.with_arabic_date(df, "s", "r")
    each = df.select("s", dates.normalize_arabic_date(F.col("s")).alias("r"))
    assert sorted(whole.collect(), key=str) == sorted(each.collect(), key=str)
    once, often = (p._jdf.queryExecution().optimizedPlan().toString().count("translate(") for p in (whole, each))
    assert once * 4 < often, (once, often)
