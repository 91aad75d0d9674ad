"""Registered vector queries over ``embeddings``.

Event time for vectors is derived from the table itself: ``2024-01-01`` +
``vec_id * 37`` minutes (the same rule as the news adapter).  Test vectors
are 64-d with max pairwise cosine 0.513 at sf0.01, so similarity thresholds
here are 0.35 (the value at which the data has neighbours).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import adapt, ann_index, loader, signatures, vectors
from newsloom.plans.registry import register
from newsloom.sources.tables import table

THRESHOLD = 0.35
NOW_LOAD = "2024-01-07 00:00:00"


def vecs(spark, sf):
    e = table(spark, sf, "embeddings")
    ts = adapt.minutes_after("2024-01-01 00:00:00", F.col("vec_id") * 37)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label", ts.alias("ts"))


VEC_CTE = """
v AS (SELECT vec_id AS id, embedding AS vec, label,
             TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 37 AS BIGINT)) AS ts,
             sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
      FROM embeddings)"""


def cos_sql(a: str, b: str) -> str:
    return (f"(list_sum(list_transform(list_zip({a}.vec, {b}.vec), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
            f" / nullif({a}.nrm * {b}.nrm, 0))")


@register("d9_cosine_next_vector", sql=f"""
WITH {VEC_CTE}
SELECT a.id, round({cos_sql('a', 'b')}, 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1
""")
def d9_cosine_next_vector(spark, sf):
    v = vecs(spark, sf)
    a = v.select("id", F.col("vec").alias("va"))
    b = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("vb"))
    return a.join(b, "id").select("id", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@register("d10_topk_nearest_vectors", sql=f"""
WITH {VEC_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s)
SELECT q, c, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5
""")
def d10_topk_nearest_vectors(spark, sf):
    out = vectors.topk_nearest(vecs(spark, sf), k=5, block_rows=256)
    return out.select("q", "c", F.round("sim", 6).alias("sim"), "rank")


@register("d10_topk_of_query_set", sql=f"""
WITH {VEC_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM v a JOIN v b ON a.id <> b.id AND a.id % 100 = 0),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rank FROM s)
SELECT q, c, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5
""")
def d10_topk_of_query_set(spark, sf):
    """A stated query set (ids divisible by 100) against all rows."""
    v = vecs(spark, sf)
    out = vectors.topk_of_queries(v.filter(F.col("id") % 100 == 0), v, k=5, block_rows=256)
    return out.select("q", "c", F.round("sim", 6).alias("sim"), "rank")


@register("c3_window_nearest_neighbour", sql=f"""
WITH {VEC_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM v a JOIN v b
      ON (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND b.ts > a.ts - INTERVAL 48 HOUR),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rn FROM s WHERE sim IS NOT NULL)
SELECT q, c, round(sim, 6) AS sim FROM r WHERE rn = 1
""")
def c3_window_nearest_neighbour(spark, sf):
    out = vectors.window_nearest(vecs(spark, sf), window_hours=48, block_rows=256)
    return out.select("q", "c", F.round("sim", 6).alias("sim"))


@register("c3_semantically_unique", sql=f"""
WITH {VEC_CTE},
s AS (SELECT a.id AS q, max({cos_sql('a', 'b')}) AS best FROM v a JOIN v b
      ON (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND b.ts > a.ts - INTERVAL 48 HOUR GROUP BY a.id)
SELECT v.id, coalesce(s.best < {THRESHOLD}, true) AS is_unique FROM v LEFT JOIN s ON v.id = s.q
""")
def c3_semantically_unique(spark, sf):
    v = vecs(spark, sf)
    best = vectors.window_nearest(v, window_hours=48, block_rows=256)
    return v.select("id").join(best.select(F.col("q").alias("id"), "sim"), "id", "left").select(
        "id", F.coalesce(F.col("sim") < THRESHOLD, F.lit(True)).alias("is_unique"))


# Copies and altered copies: copy j of a vector stands j * 100 rows later, and has the first (id + 5 j) % 17 of its
# numbers set to 0 (cosines from about 0.85 up to 1).
COPIES_CTE = f"""
{VEC_CTE},
vc AS (SELECT id, vec, nrm, ts FROM v UNION ALL
       SELECT id + 1000000 * j AS id, w AS vec,
              sqrt(list_sum(list_transform(w, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm, ts + to_minutes(CAST(j * 3700 AS BIGINT)) AS ts
       FROM (SELECT id, j, ts, list_transform(vec, lambda x, i: CASE WHEN i <= (id + 5 * j) % 17 THEN 0::FLOAT ELSE x END) AS w
             FROM v, (VALUES (1), (2)) js(j)))"""


def copies(spark, sf):
    """The vectors with two altered copies of each (see ``COPIES_CTE``)."""
    v = vecs(spark, sf).select("id", "vec", "ts")
    more = v.withColumn("j", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("zeros", (F.col("id") + 5 * F.col("j")) % 17)
    cut = F.transform("vec", lambda x, i: F.when(i < F.col("zeros"), F.lit(0.0).cast("float")).otherwise(x))
    more = more.select((F.col("id") + 1_000_000 * F.col("j")).alias("id"), cut.alias("vec"),
                       (F.col("ts") + F.make_dt_interval(mins=F.col("j") * 3700)).alias("ts"))
    return v.unionByName(more)


@register("c3_signed_projections", sql=f"""
WITH {COPIES_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM vc a JOIN vc b
      ON (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND b.ts > a.ts - INTERVAL 72 HOUR),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rn FROM s WHERE round(sim, 12) >= 0.85)
SELECT q, c, round(sim, 6) AS sim FROM r WHERE rn = 1
""")
def c3_signed_projections(spark, sf):
    """C3 at the loader's threshold by banded signatures: the nearest earlier row inside 72 h, over altered copies."""
    out = signatures.nearest_in_window(copies(spark, sf), 0.85, 72)
    return out.select("q", "c", F.round("sim", 6).alias("sim"))


@register("c3_window_nearest_of_copies", sql=f"""
WITH {COPIES_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM vc a JOIN vc b
      ON (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND b.ts > a.ts - INTERVAL 72 HOUR),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rn FROM s WHERE sim IS NOT NULL)
SELECT q, c, round(sim, 6) AS sim FROM r WHERE rn = 1
""")
def c3_window_nearest_of_copies(spark, sf):
    """The exact form over the same rows: equal vectors tie, and the smaller id wins."""
    out = vectors.window_nearest(copies(spark, sf), window_hours=72, block_rows=256)
    return out.select("q", "c", F.round("sim", 6).alias("sim"))


@register("d10_topk_of_copies", sql=f"""
WITH {COPIES_CTE},
s AS (SELECT a.id AS q, b.id AS c, {cos_sql('a', 'b')} AS sim FROM vc a JOIN vc b ON a.id <> b.id AND a.id % 100 = 0),
r AS (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, c) AS rank FROM s)
SELECT q, c, round(sim, 6) AS sim, rank FROM r WHERE rank <= 2
""")
def d10_topk_of_copies(spark, sf):
    """A stated query set over rows with equal vectors: ties by neighbour id."""
    v = copies(spark, sf)
    out = vectors.topk_of_queries(v.filter(F.col("id") % 100 == 0), v, k=2, block_rows=256)
    return out.select("q", "c", F.round("sim", 6).alias("sim"), "rank")


@register("d14_parse_vector_json", sql="""
WITH j AS (SELECT vec_id, CASE WHEN label = 3 THEN 'not a vector' ELSE to_json(embedding)::VARCHAR END AS s FROM embeddings),
p AS (SELECT vec_id, CASE WHEN json_valid(s) THEN CAST(s AS FLOAT[]) END AS v FROM j)
SELECT vec_id, len(v) AS dim, round(CAST(v[1] AS DOUBLE), 6) AS first FROM p
""")
def d14_parse_vector_json(spark, sf):
    e = table(spark, sf, "embeddings")
    s = F.when(F.col("label") == 3, F.lit("not a vector")).otherwise(F.to_json("embedding"))
    v = vectors.parse_vector(s)
    return e.select("vec_id", F.size(v).alias("dim"), F.round(F.try_element_at(v, F.lit(1)).cast("double"), 6).alias("first")).select(
        "vec_id", F.when(F.col("dim") >= 0, F.col("dim")).alias("dim"), "first")


HIGHLIGHTS_WALK_SQL = f"""
WITH RECURSIVE {VEC_CTE},
r AS (SELECT id, label, vec, nrm, row_number() OVER (PARTITION BY label ORDER BY ts DESC, id) AS rn FROM v),
pairs AS MATERIALIZED (SELECT a.label, a.id AS a, b.id AS b FROM r a JOIN r b ON a.label = b.label AND a.id <> b.id
                       WHERE {cos_sql('a', 'b')} > {THRESHOLD}),
walk(label, rn, kept) AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r
  UNION ALL
  SELECT w.label, w.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = x.id AND list_contains(w.kept, p.a))
              THEN w.kept ELSE list_append(w.kept, x.id) END
  FROM walk w JOIN r x ON x.label = w.label AND x.rn = w.rn + 1),
final AS (SELECT label, arg_max(kept, rn) AS kept FROM walk GROUP BY label)
SELECT label, unnest(list_slice(kept, 1, 5)) AS id, unnest(range(1, len(list_slice(kept, 1, 5)) + 1)) AS rank
FROM final
"""


@register("d12_semantic_highlights", sql=HIGHLIGHTS_WALK_SQL)
def d12_semantic_highlights(spark, sf):
    """The oracle replays the newest-first walk per label (recursive CTE); tests also check it."""
    return vectors.semantic_highlights(vecs(spark, sf), n=5, threshold=THRESHOLD, group_col="label")


@register("d11_ivf_approximate_topk")
def d11_ivf_approximate_topk(spark, sf):
    """Approximate by design: rows-only; tests measure recall against d10 at two sizes."""
    out = vectors.ivf_topk(vecs(spark, sf), k=5)
    return out.select("q", "c", F.round("sim", 6).alias("sim"), "rank")


@register("d11_stored_index_search")
def d11_stored_index_search(spark, sf):
    """A stored index: built over the rows up to the load time, the others appended without fitting, then searched by
    the stated query set.  Approximate by design: tests measure recall against d10 before and after the append."""
    v = vecs(spark, sf)
    late = F.col("ts") >= F.to_timestamp(F.lit(NOW_LOAD))
    path = ann_index.scratch_path(spark)
    ann_index.build(v.filter(~late), path)
    ann_index.append(v.filter(late), path)
    return ann_index.search(spark, path, v.filter(F.col("id") % 100 == 0), k=5)


def load_inputs(spark, sf):
    v = vecs(spark, sf)
    url = F.concat(F.lit("https://v.example/"), F.col("id").cast("string"))
    history = v.filter(F.col("ts") < F.to_timestamp(F.lit(NOW_LOAD)) + F.expr("INTERVAL 24 HOURS")).select(
        "id", url.alias("url"), "vec", F.col("ts").alias("inserted_at"))
    batch = v.filter(F.col("ts") >= F.to_timestamp(F.lit(NOW_LOAD))).select(
        (F.col("id") + F.lit(1_000_000)).alias("id"), url.alias("url"), "vec", F.col("ts").alias("seq"))
    return batch, history


# The loader's sequential visibility, replayed in SQL: url check, 48 h history check, then a
# recursive walk over the remaining batch rows in (seq, id) order carrying the inserted ids.
LOADER_WALK_SQL = f"""
WITH RECURSIVE {VEC_CTE},
hist AS (SELECT id, 'https://v.example/' || CAST(id AS VARCHAR) AS url, vec, nrm, ts AS inserted_at FROM v
         WHERE ts < TIMESTAMP '{NOW_LOAD}' + INTERVAL 24 HOUR),
bat AS (SELECT id + 1000000 AS id, 'https://v.example/' || CAST(id AS VARCHAR) AS url, vec, nrm, ts AS seq FROM v
        WHERE ts >= TIMESTAMP '{NOW_LOAD}'),
b1 AS (SELECT * FROM bat WHERE url NOT IN (SELECT url FROM hist)),
hh AS (SELECT DISTINCT b.id FROM b1 b JOIN hist h ON h.inserted_at > TIMESTAMP '{NOW_LOAD}' - INTERVAL 48 HOUR
       WHERE {cos_sql('b', 'h')} >= {THRESHOLD}),
b2 AS (SELECT b.*, row_number() OVER (ORDER BY seq, id) AS rn FROM b1 b WHERE id NOT IN (SELECT id FROM hh)),
pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM b2 x JOIN b2 y ON x.rn < y.rn
                       WHERE {cos_sql('x', 'y')} >= {THRESHOLD}),
walk(rn, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = o.id AND list_contains(w.kept, p.a))
              THEN w.kept ELSE list_append(w.kept, o.id) END
  FROM walk w JOIN b2 o ON o.rn = w.rn + 1),
final AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
mx AS (SELECT coalesce(max(id), 0) AS m FROM hist)
SELECT bat.id,
       CASE WHEN list_contains(f.kept, bat.id) THEN 'inserted'
            WHEN bat.id IN (SELECT id FROM hh) THEN 'semantic_history'
            WHEN bat.id IN (SELECT id FROM b1) THEN 'semantic_batch'
            ELSE 'url_duplicate' END AS decision,
       CASE WHEN list_contains(f.kept, bat.id) THEN mx.m + list_position(f.kept, bat.id) END AS new_id
FROM bat, final f, mx
"""


@register("d13_incremental_semantic_dedup", sql=LOADER_WALK_SQL)
def d13_incremental_semantic_dedup(spark, sf):
    """The oracle replays the loader's row-by-row walk in SQL; Spark runs it as set operations + rounds."""
    batch, history = load_inputs(spark, sf)
    return loader.incremental_load(batch, history, NOW_LOAD, threshold=THRESHOLD, window_hours=48,
                                   order_col="seq", block_rows=256)


def _news_highlights_sql():
    from newsloom.plans.modelq import EMBED_CTE
    from newsloom.plans.registry import NEWS_CTE
    return f"""
WITH RECURSIVE {NEWS_CTE}, {EMBED_CTE},
r AS (SELECT id, lower(sentiment) AS g, row_number() OVER (PARTITION BY lower(sentiment) ORDER BY published_ts DESC, id) AS rn FROM news),
rv AS (SELECT r.g, r.id, ev.cell, ev.v FROM r JOIN ev USING (id)),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM rv a JOIN rv b ON a.g = b.g AND a.cell = b.cell AND a.id <> b.id
                       GROUP BY a.id, b.id HAVING sum(a.v * b.v) > 0.85),
walk(g, rn, kept) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM r
  UNION ALL
  SELECT w.g, w.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = x.id AND list_contains(w.kept, p.a))
              THEN w.kept ELSE list_append(w.kept, x.id) END
  FROM walk w JOIN r x ON x.g = w.g AND x.rn = w.rn + 1),
final AS (SELECT g, arg_max(kept, rn) AS kept FROM walk GROUP BY g)
SELECT g AS sentiment, unnest(list_slice(kept, 1, 5)) AS id, unnest(range(1, len(list_slice(kept, 1, 5)) + 1)) AS rank FROM final
"""


@register("d12_news_highlights_by_sentiment", sql=_news_highlights_sql())
def d12_news_highlights_by_sentiment(spark, sf):
    """The dashboard's use of D12 — newest five per sentiment over news rows, skipping any whose
    embedding (K5 stand-in encoder on title + summary) has cosine > 0.85 to a chosen one."""
    from newsloom.operators import enrich
    from newsloom.plans.common import news
    n = news(spark, sf).select("id", "title", "summary", F.lower("sentiment").alias("sentiment"), "published_ts")
    return vectors.semantic_highlights(n, n=5, threshold=0.85, group_col="sentiment", id_col="id", vec_col="vec",
                                       ts_col="published_ts", embed=lambda rows: enrich.embed_articles(rows, out="vec"))
