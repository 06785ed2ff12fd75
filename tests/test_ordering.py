"""Ranks against a plain sort, with a hot sort key, ties, NULLs and no rows."""

from pyspark.sql import functions as F

from vendorscope.operators.ordering import with_rank


def test_ranks_are_the_sorted_places(spark):
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 101 == 0, F.lit(None))
        .otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("x")).repartition(7)
    got = with_rank(df, [F.col("x").desc_nulls_last()], ["id"], "place")
    rows = sorted(got.collect(), key=lambda r: r.place)
    want = sorted(df.collect(), key=lambda r: (r.x is None, -(r.x or 0.0), r.id))
    assert [r.place for r in rows] == list(range(1, 30_001))
    assert [(r.id, r.x) for r in rows] == [(r.id, r.x) for r in want]
    assert got.columns == ["id", "x", "place"]


def test_a_hot_key_spreads(spark):
    """Equal sort keys are split by the tie-breaking column."""
    df = spark.range(50_000).select("id", F.lit(1.0).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_rank(df, [F.col("x").asc()], ["id"])
        sizes = [r["count"] for r in df.orderBy("x", "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) > 1 and max(sizes) < 25_000
    assert got.filter("rank <> id + 1").count() == 0


def test_no_rows(spark):
    assert with_rank(spark.range(0), [F.col("id")]).count() == 0
