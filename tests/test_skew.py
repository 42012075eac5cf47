"""Joins with a key that holds a third of all rows."""

from pyspark.sql import functions as F

from tidegraph.operators.skew import heavy_keys, skewed_join


def test_skewed_join_is_the_plain_join(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i) for i in range(3000)] + [(None, -1)], "k int, a int")
    right = spark.createDataFrame([(i % 60, i) for i in range(200)] + [(None, -2)], "k int, b int")
    got = skewed_join(left, right, "k", 3001, heavy=100)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(map(tuple, want.select("k", "a", "b").collect()))
    assert skewed_join(left.where("false"), right, "k", 0).count() == 0 and skewed_join(left, right.where("false"), "k", 3001).count() == 0


def test_no_part_of_a_heavy_key_is_large(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k int, a int")
    parts = {r.k: r["__parts"] for r in heavy_keys(left, "k", 3000, 100).collect()}
    assert parts == {0: 10}
    plan = skewed_join(left, left.withColumnRenamed("a", "b"), "k", 3000, heavy=100)
    assert plan.where("k = 0").count() == 1000 * 1000
    salts = left.where("k = 0").withColumn("s", F.pmod(F.xxhash64("k", "a"), F.lit(10))).groupBy("s").count()
    assert salts.agg(F.max("count")).head()[0] < 2 * 100
