from pyspark.sql import functions as F

from newsloom.operators import ranking


def test_sequential_ids_gap_free_under_skew(spark):
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = ranking.sequential_ids(df.repartition(6), [F.col("k"), F.col("id")], col="seq").collect()
    expected = sorted((r.k, r.id) for r in df.collect())
    got = sorted(out, key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(1, n + 1))
    assert [(r.k, r.id) for r in got] == expected


def test_first_n_per_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 2000, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")).alias("g"),
                                  F.col("id"))
    out = ranking.first_n_per_group(df, "g", [F.col("id").desc()], 3).collect()
    hot = sorted(r.id for r in out if r.g == "hot")
    assert hot == [1997, 1998, 1999]
    assert len(out) == 3 * 11


def test_page_and_count(spark):
    df = spark.range(450).withColumnRenamed("id", "x")
    page2 = [r.x for r in ranking.page(df, [F.col("x")], 2, 200).collect()]
    assert page2 == list(range(200, 400))
    assert ranking.page_count(df, 200).first().pages == 3
