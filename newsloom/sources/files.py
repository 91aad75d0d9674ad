"""File sources and sinks: landing JSON, seen-state, CSV, XML.

Discovery lists file *metadata* through the ``binaryFile`` source with only
``path``/``modificationTime`` selected (the content column is pruned), so
finding the newest file per folder never reads file bodies.  Folder and file
rules are column expressions on the path; "newest per folder" is a
``max_by`` aggregate.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import ensure_checkpoint_dir

# The raw article record (10 text fields).
RAW_ARTICLE_FIELDS = ["source", "language", "category", "title", "url", "summary", "full_text",
                      "image_url", "published_date", "scraped_at"]
RAW_ARTICLE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RAW_ARTICLE_FIELDS])
PROCESSED_SCHEMA = T.StructType(RAW_ARTICLE_SCHEMA.fields + [T.StructField("sentiment", T.StringType())])
SEEN_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("reason", T.StringType()),
                            T.StructField("first_seen", T.TimestampType())])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/newsloom-{name}-{uuid.uuid4().hex[:12]}"


def list_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """A2: (path, file_name, folder, modified) for files under ``root`` matching ``glob``,
    names containing 'seen' dropped; ``folder`` is the path relative to root without the file (A1)."""
    meta = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root).select("path", F.col("modificationTime").alias("modified")))
    rel = F.regexp_extract("path", r"^.*?" + _root_pattern(root) + r"/(.*)$", 1)
    name = F.regexp_extract(rel, r"([^/]*)$", 1)
    folder = F.regexp_replace(rel, r"/?[^/]*$", "")
    return (meta.select("path", name.alias("file_name"), folder.alias("folder"), "modified")
            .filter(~F.lower(F.col("file_name")).contains("seen")))


def _root_pattern(root: str) -> str:
    import re
    tail = root.rstrip("/").split("://")[-1]
    return re.escape(tail)


def latest_per_folder(files: DataFrame) -> DataFrame:
    """A3/A4: the newest output per folder.

    A folder written by Spark holds ``run_ts=<YYYYMMDD_HHMMSS>`` run
    directories of part files: the latest run (names sort by time) is kept
    whole.  A flat folder of single files keeps its newest file (modification
    time, then path).  The per-folder choice is one small aggregate joined back.
    """
    run = F.regexp_extract("folder", r"(?:^|/)run_ts=([^/]+)$", 1)
    f = (files.withColumn("run", run)
         .withColumn("folder", F.regexp_replace("folder", r"/?run_ts=[^/]+$", ""))
         .withColumn("unit", F.when(F.col("run") != "", F.col("run")).otherwise(F.col("path"))))
    latest = f.groupBy("folder").agg(F.max_by("unit", F.struct("run", "modified", "path")).alias("unit"))
    return f.join(latest, ["folder", "unit"], "left_semi").drop("unit")


def read_json_records(spark: SparkSession, paths: list[str] | DataFrame, schema: T.StructType = RAW_ARTICLE_SCHEMA,
                      require_any: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """Records from files holding a JSON array, a single object or JSON lines.

    By default each file is read whole (one collector run writes one array)
    and parsed with ``from_json``; unreadable files parse to NULL and are
    skipped.  ``lines=True`` reads JSON-lines files line by line, so a large
    Spark-written file is split across tasks.  ``require_any`` admits a
    record only if one of those keys is *present* (explicit null counts, Q19),
    which a fixed schema alone cannot tell.  Adds ``source_file`` and the
    record's place in it, ``source_pos`` (sorts in file order: block of the
    file, then number in the block).
    """
    if isinstance(paths, DataFrame):
        paths = run_paths(paths)
    if not paths:
        empty = T.StructType([*schema.fields, T.StructField("source_file", T.StringType())])
        return spark.createDataFrame([], empty).withColumn(
            "source_pos", F.struct(F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("n")))
    meta = F.col("_metadata.file_path").alias("source_file")
    seen = F.lower(F.col("_metadata.file_name")).contains("seen")
    if lines:
        raw = spark.read.text(paths).filter(~seen).select(
            F.col("value"), meta, F.struct(F.col("_metadata.file_block_start").alias("block"),
                                           F.monotonically_increasing_id().alias("n")).alias("source_pos"))
        m = F.from_json(F.col("value"), "map<string,string>")
        recs = raw.select("source_file", "source_pos", m.alias("m")).filter(F.col("m").isNotNull())
        return _project_records(recs, schema, require_any)
    raw = spark.read.text(paths, wholetext=True).filter(~seen).select(F.col("value"), meta)
    body = F.trim(F.col("value"))
    non_blank = F.filter(F.split(body, r"\r?\n"), lambda ln: F.trim(ln) != "")
    parsed_lines = F.transform(non_blank, lambda ln: F.from_json(ln, "map<string,string>"))
    all_lines_ok = F.forall(parsed_lines, lambda m: m.isNotNull())
    single = F.from_json(body, "map<string,string>")
    as_maps = (F.when(body.startswith("["), F.from_json(body, "array<map<string,string>>"))
                .when((F.size(parsed_lines) > 0) & all_lines_ok, parsed_lines)
                .when(single.isNotNull(), F.array(single)))
    recs = raw.select("source_file", F.posexplode(as_maps).alias("n", "m")).withColumn(
        "source_pos", F.struct(F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("n")))
    return _project_records(recs, schema, require_any)


def run_paths(files: DataFrame) -> list[str]:
    """What to read of the chosen files: the folder of a run, or the one newest file of a flat folder.

    One path per outlet folder, however many part files a run has.
    """
    in_run = F.col("path").rlike(r"/run_ts=[^/]+/[^/]*$")
    unit = F.when(in_run, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.col("path"))
    return sorted(r.p for r in files.select(unit.alias("p")).distinct().collect())


def unreadable_lines(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """``(source_file, lines)`` of non-blank JSON lines that do not parse (skipped by the reader)."""
    paths = run_paths(paths) if isinstance(paths, DataFrame) else paths
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    bad = (F.trim("value") != "") & F.from_json(F.col("value"), "map<string,string>").isNull()
    return raw.filter(bad).groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))


def _project_records(recs: DataFrame, schema: T.StructType, require_any: tuple[str, ...]) -> DataFrame:
    if require_any:
        present = F.lit(False)
        for k in require_any:
            present = present | F.map_contains_key("m", k)
        recs = recs.filter(present)
    return recs.select(*[F.col("m").getItem(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], "source_file", "source_pos")


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """The seen-state table, or an empty one when it does not exist yet."""
    try:
        return spark.read.schema(SEEN_SCHEMA).parquet(path)
    except Exception as e:  # missing path only
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], SEEN_SCHEMA)
        raise


def save_seen(spark: SparkSession, new_keys: DataFrame, path: str, reason: str = "processed",
              now: str | None = None) -> DataFrame:
    """Append only keys not already seen (anti join); returns the appended rows.

    A ``reason`` column of ``new_keys`` gives each key its own reason.
    """
    seen = load_seen(spark, path)
    ts = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    why = F.min("reason") if "reason" in new_keys.columns else F.first(F.lit(reason))
    fresh = (new_keys.filter(F.col("url").isNotNull()).groupBy("url").agg(why.alias("reason"))
             .join(seen.select("url"), "url", "left_anti")
             .select("url", "reason", ts.alias("first_seen")))
    fresh.write.mode("append").parquet(path)
    return fresh


def write_json_run(df: DataFrame, root: str, run_ts: str | None = None, compression: str | None = None) -> str:
    """Records as JSON under ``root/run_ts=YYYYMMDD_HHMMSS`` (UTF-8, not escaped).

    A run owns its folder: writing the run again replaces it.
    """
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    out = f"{root.rstrip('/')}/run_ts={run_ts}"
    df.write.mode("overwrite").json(out, compression=compression)
    return out


CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    """A10/A11 sink: header, quoted fields; text with newlines and quotes round-trips."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A10 source with an explicit schema (no inference)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_rss(df: DataFrame, path: str) -> None:
    """Write (title, link, description, pubDate) rows as RSS-style XML items."""
    df.write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


RSS_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in ("title", "link", "description", "pubDate")])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS ``<item>`` elements as rows (built-in XML source)."""
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)
