from __future__ import annotations

from pyspark.sql import functions as F

from ampliq.joins import counted_lookup, dealt_lookup, fits_broadcast


def test_counted_lookup_with_a_hot_key(spark):
    """Nine rows in ten on one key, nulls among the keys, keys without a partner; both ways give the plain join."""
    key = F.when(F.col("id") % 10 < 9, F.lit(7)).when(F.col("id") % 100 == 9, F.lit(None)).otherwise(F.col("id"))
    big = spark.range(0, 20_000, 1, 8).select(key.alias("k"), F.lit("same").alias("v"))
    table = spark.range(0, 15_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner"):
        plain = big.join(table, ["k"], how).groupBy("k", "v", "w").count()
        for max_rows in (1_000_000, 100):
            got = counted_lookup(big, table, ["k"], how, max_rows=max_rows, salts=8).groupBy("k", "v", "w").count()
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_dealt_out(spark):
    """No partition of the join gets more than its share of the hot key's rows."""
    big = spark.range(0, 16_000, 1, 8).select(F.lit(1).alias("k"), "id")
    table = spark.range(0, 500).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = counted_lookup(big, table, ["k"], max_rows=10, salts=8)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 16_000 and max(sizes) <= 8_000


def test_empty_sides(spark):
    big = spark.range(0, 100).select(F.col("id").alias("k"))
    table = spark.range(0, 50).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    assert counted_lookup(big, table.limit(0), ["k"], max_rows=-1).where("w is null").count() == 100
    assert counted_lookup(big.limit(0), table, ["k"], max_rows=10).count() == 0


def test_few_rows_of_many_bytes_are_not_broadcast(spark):
    """What the driver holds follows the bytes: a thousand long texts, arrays or blobs are no small table, ten are."""
    wide = spark.range(0, 1000).select("id", F.repeat(F.lit("x"), 40_000).alias("text"))
    assert not fits_broadcast(wide) and fits_broadcast(wide.limit(10))
    assert not fits_broadcast(wide.select("id", F.array("text").alias("texts")))
    assert not fits_broadcast(wide.select(F.col("text").cast("binary").alias("a.b")))
    assert fits_broadcast(wide.select("id", F.lit(None).cast("string").alias("text")))
    joined = counted_lookup(spark.range(0, 50).select("id"), wide, ["id"])
    assert joined.where("length(text) = 40000").count() == 50


def test_a_dealt_table_is_not_gathered(spark):
    """A table too large by its counts may be small as files; Spark must not broadcast it by their bytes."""
    big, table = spark.range(0, 100).select(F.col("id").alias("k")), spark.range(0, 50).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = dealt_lookup(big, table, ["k"])
    assert "SortMergeJoin [k" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("w = 1").count() == 50
