"""Fetching the rows of a run out of a large table."""

import pytest
from pyspark.sql import functions as F

from rankbench.operators import joins
from rankbench.session import checkpointed


@pytest.fixture
def tables(spark):
    table = spark.range(20_000).select(
        F.concat(F.lit("d"), "id").alias("docno"), F.concat(F.lit("text "), "id").alias("text")
    )
    table = table.unionByName(spark.createDataFrame([(None, "no id")], "docno string, text string"))
    run = spark.range(600).select(
        F.concat(F.lit("q"), F.col("id") % 7).alias("qid"), F.concat(F.lit("d"), F.col("id") * 31).alias("docno")
    )
    gone = spark.createDataFrame([("q1", "gone"), ("q1", None)], "qid string, docno string")
    return checkpointed(run.unionByName(gone)), checkpointed(table.repartition(4))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways_give_the_plain_join(tables, monkeypatch, how):
    run, table = tables
    plain = run.join(table, "docno", how)
    for bound in (joins.BROADCAST_BYTES, 0):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
        found = joins.fetch(run, table, how)
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_filter_holds_for_all_ids_and_few_others(tables):
    run, table = tables
    ids = run.select("docno").distinct()
    holds = joins.bloom_filter(ids, "docno", ids.count())
    assert ids.where(F.col("docno").isNotNull() & ~holds(F.col("docno"))).isEmpty()
    others = table.join(ids, "docno", "left_anti").where(F.col("docno").isNotNull())
    assert others.where(holds(F.col("docno"))).count() < 0.03 * others.count()
    plan = table.where(holds(F.col("docno")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_many_ids_are_not_filtered(tables, monkeypatch):
    run, table = tables
    monkeypatch.setattr(joins, "MOST_BITS", 2048)
    assert joins.bloom_filter(run, "docno", 600) is None
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert joins.fetch(run, table).count() == run.join(table, "docno").count()


def test_no_ids(spark, tables):
    _, table = tables
    none = spark.createDataFrame([], "qid string, docno string")
    holds = joins.bloom_filter(none, "docno", 0)
    assert table.where(holds(F.col("docno"))).count() == 0
