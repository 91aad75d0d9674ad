"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Patterns find candidates in every text.  Their values are hashed and aggregated over the corpus by distinct
owners and repositories: a value that many owners hold is a copied example; a value that a single owner
holds and that looks random is taken for a live credential and gets a span of kind ``live``.

Spark's regex functions return matches without positions, so a text is split by the pattern as well: the
gaps between matches, exploded with the matches, give all positions by one running sum per text and kind.
Only matches are shuffled, never texts.

No value is ever stored: what is checkpointed and shuffled is its digest, salted anew in every run (or with the
caller's ``salt``), and whether it looks random, both computed in the pass that finds it.  The given documents have no
repository; the query takes ``source`` for the owner and ``source/lang`` as a stand-in for the repository, and
callers name the columns that really hold them.

Kinds: the base kinds ``assign``, ``access`` and ``hex``; of the method ``github``, ``slack``, ``jwt``,
``pem`` (formats that carry their own mark) and ``live``.  Positions are code points, end exclusive; the
span of ``assign`` is the whole match, its value is the assigned string.

Defined cases: null texts count as empty; a row without a match has counts 0 and the digest of the empty
string; null owners and languages count as one owner or repository of their own; repeated rows are scanned
separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import hot_lookup, load, prepare

# kind: pattern, group of the value, least length of the value.  The base kinds come first.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),   # the runs of 16 and more are the runs [0-9a-f]+ that pass
    "github": (r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
}
BASE = ("assign", "access", "hex")
LIVE = "live"
ORDER = [*KINDS, LIVE]
EXAMPLE_OWNERS = 3     # a value of so many owners is a copied example
EXAMPLE_REPOS = 6      # or of so many repositories
LIVE_CHARS = 8         # a live-looking value has so many different characters


def _matches(text, kind_no: int, pattern: str, group: int) -> F.Column:
    """All matches of a pattern with the length of the gap before each."""
    gaps = F.split(text, pattern, -1)   # one more gap than matches
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(gaps.alias("g"), matches.alias("m"), values.alias("v")), lambda p, i: F.struct(
        F.lit(kind_no).alias("kind_no"), i.alias("no"), F.length(p["g"]).alias("gap"), F.length(p["m"]).alias("length"),
        p["v"].alias("value")))
    return F.filter(rows, lambda r: r["length"].isNotNull())


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
               repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per match, and one with a null kind for a document without any.

    ``(row, doc_id, owner, repo, kind_no, no, gap, length, value, good)``; ``row`` tells repeated ids apart.
    """
    name = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), name.alias("owner"),
                       repo.alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, found = F.col("text"), []
    none = F.expr("CAST(array() AS array<struct<kind_no:int,no:int,gap:int,length:int,value:string>>)")
    for kind_no, (pattern, group, _) in enumerate(KINDS.values()):
        found.append(F.when(text.rlike(pattern), _matches(text, kind_no, pattern, group)).otherwise(none))
    out = base.select("row", "doc_id", "owner", "repo", F.explode_outer(F.concat(*found)).alias("c"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("c.kind_no") + 1)
    return out.select("row", "doc_id", "owner", "repo", "c.*", (F.length("c.value") >= least).alias("good"))


def ownership(found: DataFrame) -> DataFrame:
    """``(value_hash, owners, repos, uses)`` of every candidate value of the corpus.

    Uses of one owner and repository are merged map-side first, so a value copied everywhere costs one row
    per owner and repository.
    """
    each = found.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("uses"))
    return each.groupBy("value_hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repos"),
                                          F.sum("uses").alias("uses"))


def _looks_live(value) -> F.Column:
    chars = F.size(F.array_distinct(F.split(value, "")))
    placeholder = F.lower(value).rlike("example|changeme|placeholder|your[_-]|xxxx|test")
    return (chars >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~placeholder


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
         repo_cols: tuple[str, ...] = ("source", "lang"), salt: str | None = None) -> DataFrame:
    """``(row, doc_id, kind, start, end, value_hash, owners, repos)``; documents without a span have null kinds."""
    prepare(docs.sparkSession)
    raw = candidates(docs, text_col, id_col, owner_col, repo_cols)
    salted = F.concat(F.lit(salt or uuid.uuid4().hex), "value")
    raw = raw.withColumn("value_hash", F.when(F.col("good"), F.sha2(salted, 256))).withColumn(
        "random", F.when(F.col("good"), _looks_live(F.col("value")))).drop("value").checkpoint()
    w = Window.partitionBy("row", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("length")).over(w)
    placed = (raw.filter("kind_no IS NOT NULL").withColumn("end", stop)   # failing matches count for positions
              .filter("good").withColumn("start", F.col("end") - F.col("length")))
    used = raw.filter("good")
    counts = ownership(used).checkpoint()
    total = used.count()
    known = hot_lookup(placed, counts, "value_hash", "uses", total)
    known = known.withColumn("live", (F.col("owners") == 1) & (F.col("repos") < EXAMPLE_REPOS) & F.col("random"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    kinds = F.when(F.col("live"), F.array(kind, F.lit(LIVE))).otherwise(F.array(kind))
    spans = known.select("row", "doc_id", F.explode(kinds).alias("kind"), F.col("start").cast("long").alias("start"),
                         F.col("end").cast("long").alias("end"), "value_hash", "owners", "repos")
    every = raw.groupBy("row").agg(F.first("doc_id").alias("doc_id")).select(
        "row", "doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("kind", "string"), ("start", "long"), ("end", "long"), ("value_hash", "string"), ("owners", "long"),
            ("repos", "long"))])
    return spans.unionByName(every)


def span_digest(spans: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans and the list of all spans."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    entry = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))
    live = F.col("kind") == LIVE
    g = spans.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list(entry)).alias("e"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(F.col("owners") >= EXAMPLE_OWNERS, 1)).alias("n_example"))

    def listed(entries) -> F.Column:
        return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("e", lambda x: x["rank"] <= len(BASE))
    return g.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                    listed(F.col("e")).alias("spans"), "n_live", "n_example")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan(load(spark, sf_dir, "documents")))


QUERIES = {"op6_secret_scan": op6_secret_scan}
