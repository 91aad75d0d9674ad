from pyspark.sql import functions as F

from newsloom.functions import dates as D


def parse(spark, value, tz="UTC"):
    row = spark.createDataFrame([(value,)], "s string").select(
        F.date_format(D.parse_datestr(F.col("s"), tz), "yyyy-MM-dd HH:mm:ss").alias("r")).first()
    return row.r


def test_fixture_dates(spark):
    assert parse(spark, "2025-11-28T14:23:17Z") == "2025-11-28 14:23:17"
    assert parse(spark, "Wednesday, 22 October 2025 15:17:57") == "2025-10-22 15:17:57"
    assert parse(spark, "Wed, 22 Oct 2025 15:17:57 GMT") == "2025-10-22 15:17:57"
    # Arabic, local Cairo (UTC+2 in January / December)
    assert parse(spark, "الجمعة، 15 يناير 2025 - 03:45 م", "Africa/Cairo") == "2025-01-15 13:45:00"
    assert parse(spark, "15 ديسمبر 2025 10:05 ص", "Africa/Cairo") == "2025-12-15 08:05:00"
    assert parse(spark, "٢٨/١١/٢٠٢٥ ١٤:٣٠", "Africa/Cairo") == "2025-11-28 12:30:00"
    assert parse(spark, "1732800000") == "2024-11-28 13:20:00"
    assert parse(spark, None) is None and parse(spark, "") is None and parse(spark, "junk") is None


def test_iso_and_display(spark):
    df = spark.createDataFrame([("2025-11-28T14:23:17Z",), ("2025-11-28T14:23:17.123456",), ("junk",)], "s string")
    got = [r.r for r in df.select(D.normalize_english(F.col("s")).alias("r")).collect()]
    assert got == ["2025-11-28T14:23:17+00:00", "2025-11-28T14:23:17.123456+00:00", None]
    disp = [r.r for r in df.select(D.display(D.parse_datestr(F.col("s"))).alias("r")).collect()]
    assert disp == ["Fri, 28 Nov 2025 16:23", "Fri, 28 Nov 2025 16:23", "Unknown"]
    assert spark.createDataFrame([("2025-10-22T15:17:57Z",), ("bad",)], "s string").select(
        D.long_form(F.col("s")).alias("r")).collect()[0].r == "Wednesday, 22 October 2025 15:17:57"


def test_arabic_long_form(spark):
    r = spark.createDataFrame([("الجمعة، 15 يناير 2025 - 03:45 م",)], "s string").select(
        D.normalize_arabic_date(F.col("s")).alias("r")).first().r
    assert r == "Wednesday, 15 January 2025 – 15:45"
