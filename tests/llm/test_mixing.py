"""Mixing: targets, apportionment and taken words against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankbench.llm import mixing
from rankbench.llm.queries import QUERIES


def slow_targets(sizes, weights=(5, 2, 1), passes=3):
    """Share by weight; stop at the limit; share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: passes * sizes[s] for s in free if share[s] > passes * sizes[s] + 1e-9}
        if not above:
            return {**fixed, **share}
        fixed.update(above)


def slow_seats(votes, seats):
    """One seat at a time to the highest quotient."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda v: (-votes[v] / (2 * won[v] + 1), v))
        won[best] += 1
    return won


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 5, "c": 1000, "d": 30, "é": 2, None: 7},
        {"a": 0, "b": 10},
        {"a": 0, None: 0},
        {"z": 12},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(slow_targets(sizes))


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 1001])
def test_seats_go_to_the_highest_quotients(spark, seats):
    votes = {0: 3400, 1: 2100, 2: 5, 3: 0, 4: 1999, 5: 77, 6: 77, 7: 1}
    rows = spark.createDataFrame([(1, seats, k, v) for k, v in votes.items()], "g int, n int, k int, v long")
    found = mixing.apportion(rows, ["g"], "v", "n", "k").collect()
    assert {r["k"]: r["quota"] for r in found} == slow_seats(votes, seats)


def documents():
    rows = [(i, "w " * (i % 90 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    rows += [(900, None, "hot"), (901, "", None), (902, "x y", None), (None, "one two", "s1")]
    return rows + [(5, "same row", "s2"), (5, "same row", "s2"), (903, "v " * 30000, "s3")]


def mixed(spark, **options):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    return mixing.mix(docs.withColumn("size", F.lit("clash")), **options)


def test_taken_words_meet_the_targets(spark):
    rows = mixed(spark, block=8, rows_per_shard=50).collect()
    assert len(rows) == len(documents())
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(slow_targets(dict(size)))
    for source, words in taken.items():
        assert abs(words - target[source]) <= 8 * 20  # a block for each shard at most
    again = mixed(spark, block=8, rows_per_shard=50)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_sizes_count_words(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", " a b c d ", "x\ny\tz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    counted = rows.select("i", mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(counted)] == [0, 0, 0, 1, 2, 3]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = QUERIES["op7_mix_sources"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(slow_targets(dict(size)))
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in taken)
