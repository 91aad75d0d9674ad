import json
import os
import tempfile

from pyspark.sql import functions as F

from newsloom.operators import api
from newsloom.operators.metrics import sentiment_kpis
from newsloom.operators.filters import enrich_for_analysis
from newsloom.sources import demo, files


def test_json_forms_and_key_presence(spark):
    root = tempfile.mkdtemp(prefix="nl-landing-")
    os.makedirs(f"{root}/english/bbc")
    os.makedirs(f"{root}/english/nyt")
    with open(f"{root}/english/bbc/bbc_20250101_000000.json", "w") as f:
        json.dump([{"url": "old", "full_text": "x"}], f)
    with open(f"{root}/english/bbc/bbc_20250102_000000.json", "w") as f:
        json.dump([{"url": "a", "full_text": "t"}, {"url": "b", "summary": "s"}, {"url": "c"}], f, indent=2)
    with open(f"{root}/english/nyt/nyt_20250102_000000.json", "w") as f:
        json.dump({"url": "n1", "full_text": None}, f, indent=2)   # single object, explicit null (Q19)
    with open(f"{root}/english/nyt/seen_links.json", "w") as f:
        json.dump(["a"], f)
    os.utime(f"{root}/english/bbc/bbc_20250101_000000.json", (1, 1))
    found = files.latest_per_folder(files.list_files(spark, root))
    assert sorted(r.folder for r in found.collect()) == ["english/bbc", "english/nyt"]
    recs = files.read_json_records(spark, found, require_any=("full_text", "summary"))
    assert sorted(r.url for r in recs.collect()) == ["a", "b", "n1"]


def test_seen_state_missing_then_append(spark):
    path = tempfile.mkdtemp(prefix="nl-seen-") + "/state"
    assert files.load_seen(spark, path).count() == 0
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    files.save_seen(spark, keys, path, now="2025-01-01 00:00:00")
    files.save_seen(spark, spark.createDataFrame([("b",), ("c",)], "url string"), path)
    assert sorted(r.url for r in files.load_seen(spark, path).collect()) == ["a", "b", "c"]


def test_guardian_summary_precedence(spark):
    items = spark.createDataFrame(
        [("t", None), (None, "b" * 200)],
        "trail string, body string").select(
        F.lit("T").alias("webTitle"), F.lit("u").alias("webUrl"), F.lit(None).cast("string").alias("sectionName"),
        F.lit("world").alias("section"), F.lit("2025-10-22T15:17:57Z").alias("webPublicationDate"),
        F.struct(F.col("trail").alias("trailText"), F.lit(None).cast("string").alias("standfirst"),
                 F.col("body").alias("bodyText"), F.lit(None).cast("string").alias("body"),
                 F.lit(None).cast("string").alias("thumbnail"), F.lit("By X").alias("byline")).alias("fields"),
        F.array(F.struct(F.lit("keyword").alias("type"), F.lit("k").alias("webTitle"))).alias("tags"))
    got = api.normalize_guardian(items).collect()
    assert got[0].summary is None
    assert got[1].summary == "b" * 180 + "..."
    assert got[1].published_date == "Wednesday, 22 October 2025 15:17:57"
    assert got[1].author == "By X" and got[1].category == "world"


def test_nyt_image_fallback(spark):
    df = spark.createDataFrame([([], [{"media-metadata": [{"url": "s"}, {"url": "L"}]}])],
                               "multimedia array<struct<url:string>>, media array<struct<`media-metadata`:array<struct<url:string>>>>")
    items = df.select(F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("a").alias("abstract"),
                      F.lit("2025").alias("published_date"), "multimedia", "media")
    assert api.normalize_nyt(items, F.lit("world")).first().image_url == "L"


def test_demo_rows_and_zero_input_kpis(spark):
    d = demo.demo_rows(spark, "2025-01-01 12:00:00")
    assert d.count() == 20 and d.select("source").distinct().count() == len(demo.SOURCES)
    empty = enrich_for_analysis(d.limit(0))
    row = sentiment_kpis(empty).first()
    assert (row.total, row.positive, row.negative, row.neutral, row.pos_rate, row.sentiment_score) == (0, 0, 0, 0, 0.0, 0.0)
