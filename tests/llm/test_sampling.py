"""Bounded samples: the first by hash, whatever is thinned out before."""

from pyspark.sql import functions as F

from rankbench.llm import sampling


def test_first_by_hash(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    every = rows.orderBy(sampling.draw(3, "k"), "k").collect()
    for most in (1, 40, 4999, 5000, 9000):
        found = sampling.first_by_hash(rows, most, 3, "k").collect()
        assert {r["k"] for r in found} == {r["k"] for r in every[:most]}
    assert sampling.first_by_hash(rows.limit(0), 5, 3, "k").collect() == []


def test_thinning_leaves_little_more_than_asked(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "k")
    left = rows.where(sampling.draw(1, "k") < sampling.enough(1000, F.lit(100_000))).count()
    assert 1000 <= left <= 1500
