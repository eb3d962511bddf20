"""Term-pruned retrieval: the rows of plain retrieval, from less of the postings."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench.operators import lexical, lexicon_index, pruned
from rankbench.operators.joins import broadcast_if_short
from rankbench.session import checkpointed, fresh_path


def corpus_of(spark, n, seed):
    """Documents over words whose frequencies fall steeply, one in all of them."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = draw.zipf(1.3, size=draw.integers(1, 60))
        rows.append((f"d{i:05}", "the " + " ".join(f"w{min(w, 300)}" for w in words)))
    rows += [("empty", ""), ("none", None)]
    return spark.createDataFrame(rows, "docno string, text string")


@pytest.fixture(scope="module")
def indexed(spark):
    return lexicon_index.write_index(corpus_of(spark, 3000, 1), fresh_path(spark, "pruned-base"))


@pytest.fixture(scope="module")
def topics(spark):
    draw = np.random.default_rng(2)
    rows = [
        (f"q{i}", " ".join(f"w{w}" for w in draw.integers(1, 300, size=draw.integers(1, 6))))
        for i in range(40)
    ]
    # common words, whose weight is negative, beside rare ones; repeats; unknown words; nothing
    rows += [("neg", "the the w1 w250"), ("only", "the"), ("twice", "w9 w9 w9 w30"), ("no", "zzz"), ("", "")]
    rows.append(("null", None))
    return spark.createDataFrame(rows, "qid string, query string")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("block, k", [(128, 10), (8, 10), (1, 3), (8, 5000)])
def test_same_rows(spark, indexed, topics, block, k):
    impacts = pruned.write_impacts(indexed, fresh_path(spark, "impacts"), block=block, folders=5)
    same(pruned.retrieve_pruned(topics, impacts, k), lexical.retrieve(topics, indexed, k=k))


def test_other_weights_and_many_query_terms(spark, indexed, topics):
    weights = lexical.tfidf_weights()
    impacts = pruned.write_impacts(indexed, fresh_path(spark, "impacts"), weights, block=16)
    plain = lexical.retrieve(topics, indexed, weights)
    same(pruned.retrieve_pruned(topics, impacts), plain)
    same(pruned.retrieve_pruned(topics, impacts, broadcast_rows=0), plain)


def test_layout_holds_every_posting_once(spark, indexed):
    impacts = pruned.write_impacts(indexed, fresh_path(spark, "impacts"), block=8, folders=3)
    found = pruned._postings(impacts.blocks, "term", "block", "top")
    assert found.select("docno", "dl", "term", "tf").exceptAll(
        indexed.postings.select("docno", "dl", "term", "tf")
    ).isEmpty()
    assert found.count() == indexed.postings.count()
    # impacts fall from block to block, and the first of a block is its top
    avgdl = indexed.stats.first()["avgdl"]
    scored = found.withColumn("impact", impacts.weights[1](F.lit(avgdl)))
    ends = scored.groupBy("term", "block").agg(F.max("impact").alias("a"), F.min("impact").alias("b"), F.first("top").alias("top"), F.count("*").alias("n"))
    assert ends.where("abs(a - top) > 1e-12").isEmpty()
    following = ends.alias("x").join(ends.alias("y"), F.expr("x.term = y.term and x.block + 1 = y.block"))
    assert following.where("x.b < y.a or x.n < 8").isEmpty()
    assert impacts.blocks.where("(block = 0) <> (tier = 0)").isEmpty()
    tiers = {r["block"]: r["tier"] for r in impacts.blocks.select("block", "tier").distinct().collect()}
    for block, tier in tiers.items():
        assert block == 0 or 4 ** (tier - 1) <= block < 4**tier


def test_postings_are_shuffled_once_by_term(spark, indexed):
    mean = F.lit(indexed.stats.first()["avgdl"])
    impact = lexical.bm25_weights()[1](mean)
    once = pruned.blocks_by_term(indexed, impact, 8)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(term#" in plan
    # terms of more postings than a task ranks are ranked by several: the same blocks
    assert indexed.lexicon.where("df > 50").count() and indexed.lexicon.where("df <= 50").count()
    parted = pruned.blocks_by_term(indexed, impact, 8, task_postings=50)
    assert once.exceptAll(parted).isEmpty() and parted.exceptAll(once).isEmpty()


def test_blocks_are_written_where_they_are_ranked(spark, indexed):
    """A task ranks the terms of one folder, so blocks are not shuffled to their folders."""
    impact = lexical.bm25_weights()[1](F.lit(indexed.stats.first()["avgdl"]))
    stored = pruned.blocks_by_folder(indexed, impact, 3, 8)
    assert stored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    tasks = stored.groupBy(F.spark_partition_id()).agg(F.countDistinct("folder").alias("n"))
    assert 3 < tasks.count() <= 9 and tasks.where("n > 1").isEmpty()
    parted = pruned.blocks_by_folder(indexed, impact, 3, 8, task_postings=50)
    assert stored.exceptAll(parted).isEmpty() and parted.exceptAll(stored).isEmpty()


def test_candidates_must_reach_what_the_given_blocks_reach(spark):
    """Two documents have 9 - 2 at least, so one that has 4 + 1.5 at most is none."""
    judged = spark.createDataFrame(
        [("q", "a", 1.0, True, 9.0), ("q", "b", 1.0, False, 1.5), ("free", "a", None, True, 9.0)],
        "qid string, term string, bar double, gives boolean, most double",
    )
    given = spark.createDataFrame(
        [("q", "d1", 9.0), ("q", "d2", 4.0), ("q", "d2", 6.0), ("q", "d3", 4.0), ("q", "d4", 5.6), ("free", "d3", 0.1)],
        "qid string, docno string, part double",
    )
    lost = spark.createDataFrame([("q", -2.0), ("free", 0.0)], "qid string, lost double")
    found = pruned.candidates(judged, given, lost, 2)
    assert sorted((r["qid"], r["docno"]) for r in found.collect()) == [
        ("free", "d3"), ("q", "d1"), ("q", "d2"), ("q", "d4")
    ]


def test_blocks_are_skipped_and_folders_pruned(spark, indexed):
    impacts = pruned.write_impacts(indexed, fresh_path(spark, "impacts"), block=8, folders=4)
    topics = spark.createDataFrame([("q", "w200 w2")], "qid string, query string")
    terms = lexical.query_terms(topics).withColumn("folder", pruned.folder_of("term", 4))
    asked = checkpointed(
        impacts.terms.join(broadcast_if_short(checkpointed(terms)), ["folder", "term"]).select(
            "qid", "folder", "term", "top", F.when(F.col("term") == "w200", 5.0).otherwise(1.0).alias("weight")
        )
    )
    judged = pruned.judged_blocks(asked, impacts, 3)
    n = {r["gives"]: r["count"] for r in judged.groupBy("gives").count().collect()}
    assert 0 < n[True] < n[False]
    met = pruned._met(impacts.blocks, asked.drop("top"), ["folder", "term"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "docnos#" in line)
    named = sorted(r["folder"] for r in asked.select("folder").distinct().collect())
    assert len(named) < 4
    filters = scan[scan.index("PartitionFilters") :]
    assert re.search(r"folder#\d+ (IN|=) ", filters)
    assert all(str(n) in filters for n in named)


def test_empty_index(spark):
    none = spark.createDataFrame([], "docno string, text string")
    index = lexicon_index.build_index(none)
    impacts = pruned.write_impacts(index, fresh_path(spark, "impacts"))
    topics = spark.createDataFrame([("q", "a")], "qid string, query string")
    assert pruned.retrieve_pruned(topics, impacts).collect() == []


def test_many_weightings_read_the_postings_once(spark, indexed, topics):
    both = {"bm25": lexical.bm25_weights(), "tfidf": lexical.tfidf_weights()}
    found = lexical.retrieve_many(topics, indexed, both)
    for name, weights in both.items():
        same(
            found.where(F.col("system") == name).select("qid", "docno", "score", "rank"),
            lexical.retrieve(topics, indexed, weights),
        )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[docno#") - plan.count("Generate") >= 0
    tables = [line for line in plan.splitlines() if "Relation" in line and ",term#" in line and ",tf#" in line]
    assert len(tables) == 1


def test_pretokenised_queries(spark, indexed, topics):
    cut = topics.withColumn("query", F.lower("query"))
    same(
        lexical.retrieve(cut, indexed, pretokenised=True), lexical.retrieve(topics, indexed)
    )
