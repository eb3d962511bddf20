"""Shards of the hash tree: the law, the shares, gapless slots, confined movement."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rankbench.llm import sharding
from rankbench.llm.queries import QUERIES


def placed(spark, tree, n=20_000):
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    return {
        r["doc_id"]: r["s"]
        for r in ids.select("doc_id", sharding.shard_of(F.col("doc_id"), tree).alias("s")).collect()
    }


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (40, 41, 45):
        before, after = placed(spark, sharding.topology(n)), placed(spark, sharding.topology(n + 1))
        moved = [d for d in before if before[d] != after[d]]
        assert {after[d] for d in moved} == {n}
        assert abs(len(moved) - 20_000 / (n + 1)) < 5 * (20_000 / n) ** 0.5


def test_shares_follow_the_weights(spark):
    tree = {"r0": {"a": {0: 1.0, 1: 3.0}, "b": {2: 4.0}}, "r1": {"c": {3: 2.0, 4: 0.0}}}
    counts = Counter(placed(spark, tree).values())
    for shard, weight in {0: 1, 1: 3, 2: 4, 3: 2}.items():
        assert abs(counts[shard] - 2000 * weight) < 5 * (2000 * weight) ** 0.5
    assert counts[4] == 0


def test_a_changed_weight_moves_only_within_its_subtrees(spark):
    old = {"r0": {"a": {0: 1.0, 1: 1.0}, "b": {2: 2.0}}, "r1": {"c": {3: 2.0}, "d": {4: 2.0}}}
    new = {"r0": {"a": {0: 1.0, 1: 2.0}, "b": {2: 2.0}}, "r1": old["r1"]}
    before, after = placed(spark, old), placed(spark, new)
    for d in before:
        if before[d] != after[d]:  # into the grown region, or inside it into the grown rack or shard
            assert after[d] in (0, 1, 2)
            if before[d] in (0, 1, 2):
                assert after[d] in (0, 1)
            if before[d] in (0, 1):
                assert after[d] == 1


def test_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "ü"), (None, None), (None, "x"), (3, ""), (4, "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    found = sharding.assign(docs).collect()
    assert len(found) == len(rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 1
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    assert got == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert sharding.assign(docs.limit(0)).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = QUERIES["op10_hash_tree_shards"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert len(rows) == len(docs)
    by_shard = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 16
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        assert r["law"] == "key" and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
