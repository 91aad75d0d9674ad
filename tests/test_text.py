from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ngrams


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_normalize_arabic(spark):
    assert one(spark, T.normalize_arabic(F.col("s")), "الْعَرَبِيَّة") == "العربيه"
    assert one(spark, T.normalize_arabic(F.col("s")), "إلى أين؟") == "الي اين"
    assert one(spark, T.normalize_arabic(F.col("s")), None) == ""


def test_highlight_escapes_text_not_term(spark):
    assert one(spark, T.highlight(F.col("s"), "cats"), "Cats & dogs") == "<mark>Cats</mark> &amp; dogs"
    assert one(spark, T.highlight(F.col("s"), "&"), "a & b") == "a <mark>&amp;</mark> b"


def test_parse_model_output(spark):
    src = "x" * 400
    df = spark.createDataFrame([("SUMMARY: Long enough text. SENTIMENT: Positive", src),
                                ("SENTIMENT: Negative", src), ("", src)], "o string, src string")
    got = [tuple(r.r) for r in df.select(T.parse_model_output(F.col("o"), F.col("src")).alias("r")).collect()]
    assert got == [("Long enough text.", "Positive"), ("x" * 300 + "...", "Negative"), ("x" * 300 + "...", "Neutral")]


def test_repair_json(spark):
    df = spark.createDataFrame([('```json\n{"summary":"s","sentiment":"Positive"}\n```',),
                                ('{"summary":"s", "senti',), (None,)], "o string")
    got = [tuple(r.r) for r in df.select(T.repair_json(F.col("o")).alias("r")).collect()]
    assert got == [("s", "Positive"), ("s", "Neutral"), ("", "Neutral")]


def test_rtl_and_short_label(spark):
    assert one(spark, T.is_rtl(F.col("s")), "خبر عاجل") is True
    assert one(spark, T.is_rtl(F.col("s")), "breaking") is False
    assert one(spark, T.short_text_label(F.col("s"), F.lit("positive")), "  short  ") == "neutral"


def test_lead_summary_three_sentences(spark):
    txt = "One. Two!  Three?\nFour. Five."
    assert one(spark, T.lead_summary(F.col("s")), txt) == "One. Two! Three?"


def test_cookie_hard_stop(spark):
    txt = "Real news here. Welcome Your personal data will be processed blah"
    assert one(spark, T.clean_text_remove_dates(F.col("s")), txt) == "Real news here."
    assert one(spark, T.clean_text_remove_dates(F.col("s")), "Published 12/3/2025 10:00:00 ok") == "Published ok"


def test_bigrams_across_documents(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "")], "id long, t string")
    got = {(r.w1, r.w2) for r in ngrams.bigrams_across_documents(df, "t", [F.col("id")]).collect()}
    assert got == {("beta", "gamma")}


def test_tfidf_rows_stay_with_their_document(spark, monkeypatch):
    """Terms are not shuffled to the dictionary, unless it is too large; repeated ids are one document either way."""
    from newsloom.operators import tfidf
    rows = [(i % 40, f"alpha beta{i % 7} beta{i % 7} gamma{i % 3}") for i in range(50)] + [(99, None), (None, "alpha")]
    df = spark.createDataFrame(rows, "id long, text string")
    near = tfidf.tfidf(df)
    plan = near._jdf.queryExecution().sparkPlan().toString() + near._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "BroadcastHashJoin" in plan
    got = {(r.id, r.term, r.df, round(r.w, 9)) for r in near.collect()}
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 0)
    assert got == {(r.id, r.term, r.df, round(r.w, 9)) for r in tfidf.tfidf(df).collect()}
    assert len(got) == 40 * 3 + 1 + sum(len({j % 7 for j in (i, i + 40)}) + len({j % 3 for j in (i, i + 40)}) - 2 for i in range(10))
