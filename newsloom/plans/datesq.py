"""Registered date queries over ``events``.

Each event's timestamp is rendered in one of the collectors' formats (chosen
by ``event_type``) and parsed back; the oracle states the expected instant
directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.plans.registry import register
from newsloom.sources.tables import table


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def rendered(ts, kind):
    return (F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .when(kind == "view", F.date_format(ts, "EEEE, dd MMMM yyyy HH:mm:ss"))
             .when(kind == "purchase", F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
             .when(kind == "signup", F.date_format(ts, "d/M/yyyy HH:mm"))
             .otherwise(F.unix_seconds(ts).cast("string")))


@register("i2_parse_multiformat_dates", sql="""
SELECT event_id, strftime(CASE WHEN event_type = 'signup' THEN date_trunc('minute', ts)
                               ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM events
""")
def i2_parse_multiformat_dates(spark, sf):
    e = _events(spark, sf).withColumn("s", rendered(F.col("ts"), F.col("event_type")))
    p = D.with_parsed_date(e, "s", "p", "UTC")
    return p.select("event_id", F.date_format("p", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("i4_iso_utc_normalise", sql="""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS iso
FROM events
""")
def i4_iso_utc_normalise(spark, sf):
    e = _events(spark, sf).withColumn("s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return D.with_parsed_date(e, "s", "p", "UTC").select("event_id", D.iso_utc(F.col("p")).alias("iso"))


@register("i5_long_form_date", sql="""
SELECT event_id, strftime(ts, '%A, %d %B %Y %H:%M:%S') AS long_form FROM events
""")
def i5_long_form_date(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", D.long_form(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("long_form"))


@register("i6_display_date", sql="""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Unknown'
                      ELSE strftime(timezone('Africa/Cairo', ts AT TIME ZONE 'UTC'), '%a, %d %b %Y %H:%M') END AS display
FROM events
""")
def i6_display_date(spark, sf):
    e = _events(spark, sf)
    ts = F.when(F.col("event_type") != "error", F.col("ts"))
    return e.select("event_id", D.display(ts).alias("display"))


@register("b7_published_else_scraped", sql="""
SELECT event_id, strftime(date_trunc('second', CASE WHEN event_type = 'error' THEN ts + INTERVAL 1 HOUR ELSE ts END),
                          '%Y-%m-%d %H:%M:%S') AS published
FROM events
""")
def b7_published_else_scraped(spark, sf):
    e = _events(spark, sf)
    pub = F.when(F.col("event_type") == "error", F.lit("junk")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    scr = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = D.with_parsed_date(D.with_parsed_date(e.select("event_id", pub.alias("pub"), scr.alias("scr")),
                                              "pub", "p1"), "scr", "p2")
    return e.select("event_id", F.date_format(F.coalesce("p1", "p2"), "yyyy-MM-dd HH:mm:ss").alias("published"))


def arabic_rendering(ts):
    """An Arabic date string for each instant (Cairo local time): weekday، d month yyyy - hh:mm ص/م."""
    local = F.from_utc_timestamp(ts, "Africa/Cairo")
    months = F.array(*[F.lit(ar) for ar in AR_MONTH_NAMES])
    days = F.array(*[F.lit(d) for d in AR_WEEKDAYS_SUN_FIRST])
    latin = F.concat(F.element_at(days, F.dayofweek(local)), F.lit("، "), F.date_format(local, "d"), F.lit(" "),
                     F.element_at(months, F.month(local)), F.lit(" "), F.date_format(local, "yyyy"), F.lit(" - "),
                     F.date_format(local, "hh:mm"), F.lit(" "),
                     F.when(F.hour(local) < 12, F.lit("ص")).otherwise(F.lit("م")))
    return F.translate(latin, D.LATIN_DIGITS, D.ARABIC_DIGITS)


# One Arabic name per month (January..December) and weekday (Sunday..Saturday).
AR_MONTH_NAMES = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر",
                  "نوفمبر", "ديسمبر"]
AR_WEEKDAYS_SUN_FIRST = ["الأحد", "الاثنين", "الثلاثاء", "الأربعاء", "الخميس", "الجمعة", "السبت"]


@register("i1_i3_arabic_date_roundtrip", sql="""
SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events
""")
def i1_i3_arabic_date_roundtrip(spark, sf):
    e = _events(spark, sf).withColumn("s", arabic_rendering(F.col("ts")))
    p = D.with_parsed_date(e, "s", "p", "Africa/Cairo")
    return p.select("event_id", F.date_format("p", "yyyy-MM-dd HH:mm:ss").alias("parsed"))
