"""Date translation, parsing and formatting as Column expressions.

Parsing is an ordered ``coalesce`` of ``try_to_timestamp`` over a fixed
format list, after Arabic digits/months/AM-PM are translated and a leading
weekday name is removed (Spark refuses weekday letters in parse patterns,
Q24).  Values are stored as UTC instants; a string without a zone is read in
the ``tz`` argument (per source, Q18).  Formatting uses the session time zone,
which the engine runs in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import py_strip

# ---------------------------------------------------------------- fixed values
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"
# Arabic month names -> English (union of the dashboard and processor tables).
# "يوليوز" must be replaced before "يوليو" (its prefix), SURVEY Q17.
AR_MONTHS = [
    ("يناير", "January"), ("فبراير", "February"), ("مارس", "March"),
    ("أبريل", "April"), ("ابريل", "April"), ("مايو", "May"), ("يونيو", "June"),
    ("يونيه", "June"), ("يوليوز", "July"), ("يوليو", "July"),
    ("أغسطس", "August"), ("اغسطس", "August"), ("سبتمبر", "September"),
    ("أكتوبر", "October"), ("اكتوبر", "October"), ("نوفمبر", "November"),
    ("ديسمبر", "December"),
]
AR_DAYS = ["السبت", "الأحد", "الاحد", "الاثنين", "الإثنين", "الثلاثاء", "الاربعاء", "الأربعاء", "الخميس", "الجمعة"]
# Ordered parse formats (after translation and weekday removal), zone-free ones first.
NAIVE_FORMATS = [
    "d MMMM yyyy HH:mm:ss",
    "d MMMM yyyy – HH:mm",
    "d MMMM yyyy - hh:mm a",
    "d MMMM yyyy hh:mm a",
    "d MMMM yyyy HH:mm",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy HH:mm",
    "d MMMM yyyy",
]
ZONED_FORMATS = ["d MMM yyyy HH:mm:ss z"]
DISPLAY_FORMAT = "EEE, dd MMM yyyy HH:mm"
LONG_FORMAT = "EEEE, dd MMMM yyyy HH:mm:ss"
ARABIC_LONG_FORMAT = "EEEE, dd MMMM yyyy – HH:mm"
LOCAL_TZ = "Africa/Cairo"
# ------------------------------------------------------------------------------

ISO_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
ZONE_SUFFIX_RE = r"(Z|[+-]\d{2}:?\d{2})$"
EPOCH_RE = r"^\d{9,11}(\.\d+)?$"


def _alternation(words) -> str:
    return "(" + "|".join(words) + ")"


def arabic_to_english(s: Column) -> Column:
    """Digits, month names, separators and AM/PM markers attached to a time.

    A date string holds one month name: it is found with one ordered
    alternation (longer names first where one is a prefix of another) and
    mapped through a literal map, which keeps the expression small.
    """
    t = py_strip(s)
    t = F.replace(F.replace(F.replace(t, F.lit("،"), F.lit(",")), F.lit("|"), F.lit(" ")), F.lit("ـ"), F.lit(" "))
    t = F.translate(t, ARABIC_DIGITS, LATIN_DIGITS)
    month_map = F.create_map(*[x for ar, en in AR_MONTHS for x in (F.lit(ar), F.lit(en))])
    found = F.regexp_extract(t, _alternation(ar for ar, _ in AR_MONTHS), 1)
    t = F.when(found != "", F.replace(t, found, F.element_at(month_map, found))).otherwise(t)
    t = F.regexp_replace(t, r"(\d{1,2}[:.]\d{1,2})\s*ص", "$1 AM")
    t = F.regexp_replace(t, r"(\d{1,2}[:.]\d{1,2})\s*م", "$1 PM")
    return t


def strip_weekday(s: Column) -> Column:
    """Drop Arabic day names and a leading ``Word,`` weekday."""
    t = F.regexp_replace(s, _alternation(AR_DAYS) + "،?", "")
    t = F.regexp_replace(py_strip(t), r"^[,،\s]+", "")
    return py_strip(F.regexp_replace(t, r"^\p{L}+\s*[,،]\s*", ""))


def prepare_datestr(s: Column) -> Column:
    """Translated, weekday-free form of a date string (the input of ``parse_prepared``)."""
    raw = py_strip(F.coalesce(s.cast("string"), F.lit("")))
    return strip_weekday(arabic_to_english(raw))


def parse_prepared(t: Column, raw: Column, tz: str = "UTC") -> Column:
    """Parse a prepared string ``t`` (``raw`` is the original, for epoch numbers)."""
    iso = t.rlike(ISO_RE)
    zoned_iso = F.when(iso & t.rlike(ZONE_SUFFIX_RE), F.try_to_timestamp(t))
    naive_iso = F.when(iso & ~t.rlike(ZONE_SUFFIX_RE), F.try_to_timestamp(t))
    zoned = F.coalesce(zoned_iso, *[F.try_to_timestamp(t, F.lit(f)) for f in ZONED_FORMATS])
    naive = F.coalesce(naive_iso, *[F.try_to_timestamp(t, F.lit(f)) for f in NAIVE_FORMATS])
    m = r"(\d{1,2})[^\d](\d{1,2})[^\d](\d{4}).*?(\d{1,2}):(\d{2})"
    fallback = F.try_make_timestamp(
        F.regexp_extract(t, m, 3).cast("int"), F.regexp_extract(t, m, 2).cast("int"),
        F.regexp_extract(t, m, 1).cast("int"), F.regexp_extract(t, m, 4).cast("int"),
        F.regexp_extract(t, m, 5).cast("int"), F.lit(0))
    fallback = F.when(t.rlike(m), fallback)
    r = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    epoch = F.when(r.rlike(EPOCH_RE), F.timestamp_seconds(r.cast("double")))
    local = F.coalesce(naive, fallback)
    return F.coalesce(epoch, zoned, F.to_utc_timestamp(local, tz))


def parse_datestr(s: Column, tz: str = "UTC") -> Column:
    """String -> UTC timestamp, or NULL.  Naive values are read in ``tz``.

    For whole tables prefer ``with_parsed_date``, which computes the prepared
    string once per row instead of once per format branch.
    """
    return parse_prepared(prepare_datestr(s), s, tz)


def with_parsed_date(df: DataFrame, src: str, out: str, tz: str = "UTC") -> DataFrame:
    """Add ``out`` = I2 parse of column ``src`` (prepared string materialised once)."""
    tmp = f"_{out}_prep"
    return (df.withColumn(tmp, prepare_datestr(F.col(src)))
            .withColumn(out, parse_prepared(F.col(tmp), F.col(src), tz)).drop(tmp))


def published_ts(published: Column, scraped: Column, tz: str = "UTC") -> Column:
    """parse(published) else parse(scraped)."""
    return F.coalesce(parse_datestr(published, tz), parse_datestr(scraped, tz))


def iso_utc(ts: Column) -> Column:
    """I4: ISO-8601 with offset (+00:00); microseconds only when non-zero (Python isoformat)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNotNull(),
                  F.concat(whole, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                           F.lit("+00:00")))


def normalize_english(s: Column) -> Column:
    """I4: English processor date -> ISO-8601 UTC (naive = UTC), NULL if unparseable."""
    return iso_utc(parse_datestr(s, "UTC"))


def normalize_arabic_date(s: Column, tz: str = LOCAL_TZ) -> Column:
    """Arabic processor date -> 'Wednesday, 15 January 2025 – 15:45' in local time."""
    return F.date_format(F.from_utc_timestamp(parse_datestr(s, tz), tz), ARABIC_LONG_FORMAT)


def with_arabic_date(df: DataFrame, src: str, out: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Add ``out`` = I3 of column ``src``, for whole tables: the string is prepared and parsed once per row."""
    tmp = f"_{out}_ts"
    return (with_parsed_date(df, src, tmp, tz)
            .withColumn(out, F.date_format(F.from_utc_timestamp(F.col(tmp), tz), ARABIC_LONG_FORMAT)).drop(tmp))


def long_form(iso: Column) -> Column:
    """ISO timestamp -> 'Wednesday, 22 October 2025 15:17:57' (UTC); bad input returned unchanged."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), LONG_FORMAT), iso)


def display(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """I6: '%a, %d %b %Y %H:%M' in local time, or 'Unknown'."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, tz), DISPLAY_FORMAT), F.lit("Unknown"))
