from pyspark.sql import functions as F

from logsleuth.operators import distribute


def test_global_index_is_dense_and_partition_independent(spark, rows_of):
    values = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    expected = [(v, v) for v in range(1000)]
    for partitions in (1, 8):
        indexed = distribute.global_index(values.repartition(partitions), ["v"], "i")
        assert rows_of(indexed, "v", "i") == expected


def test_global_index_splits_one_hot_key(spark, rows_of):
    values = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), F.col("id").alias("n")
    )
    indexed = distribute.global_index(values, ["k", "n"], "i").collect()
    ordered = sorted((r["k"], r["n"], r["i"]) for r in indexed)
    assert [i for _, _, i in ordered] == list(range(3000))


def test_with_previous_across_blocks(spark, rows_of):
    values = spark.range(100).select((F.col("id")).alias("i"), (F.col("id") * 10).alias("v"))
    marked = distribute.with_previous(values, "i", "v", "before", block=7)
    assert rows_of(marked, "i", "before")[1:] == [(i, (i - 1) * 10) for i in range(1, 100)]
    assert marked.filter("i = 0").first()["before"] is None


def test_skew_join_salts_hot_keys_and_loses_nothing(spark, rows_of, make_events):
    events = make_events([{"ip": "hot" if i % 3 else f"cold{i}"} for i in range(300)])
    table = events.groupBy("ip_address").agg(F.count("*").alias("n")).withColumn("label", F.upper("ip_address"))
    hot = distribute.hot_keys(table, ["ip_address"], "n", hot_rows=20).collect()
    assert [(r["ip_address"], r["_salts"]) for r in hot] == [("hot", 10)]
    joined = distribute.skew_join(events, table, ["ip_address"], "n", hot_rows=20)
    assert joined.count() == 300
    assert joined.filter(F.col("label") != F.upper("ip_address")).count() == 0
    assert joined.filter(F.col("label").isNull()).count() == 0


def test_exact_percentile_interpolates(spark):
    values = spark.range(11).select(F.col("id").cast("double").alias("x"), "id")
    assert distribute.exact_percentile(values, "x", 0.25, ["id"]).first()["x"] == 2.5
    assert distribute.exact_percentile(values, "x", 0.5, ["id"]).first()["x"] == 5.0
    assert distribute.exact_percentile(values, "x", 1.0, ["id"]).first()["x"] == 10.0
