"""Exact duplicates: tries against plain Python, memory limits, defined results."""

import hashlib
import random
from collections import defaultdict

import compare
import pytest
from pyspark.sql import functions as F

from rankbench.llm import trie_dedup
from rankbench.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        owner = (max if largest else min)(named) if named else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, owner, len(ids), sha) for i in ids]
    return sorted(out, key=repr)


def check(found, rows, largest):
    found = [tuple(r) for r in found.collect()]
    assert sorted(((d, k, n, sha) for d, k, n, kept, sha in found), key=repr) == expected(rows, largest)
    kept = [sha for _, _, _, kept, sha in found if kept]
    assert len(kept) == len(set(kept)) == len({sha for *_, sha in found})
    assert all(d == k for d, k, _, kept, _ in found if kept)


def some_rows(n, seed):
    draw = random.Random(seed)
    texts = ["", "A", "a", "ä", "Ä", "İ", "same prefix " * 40 + "x", "same prefix " * 40 + "y", "Z" * 30_000]
    texts += ["".join(draw.choice("abAB") for _ in range(draw.randrange(1, 7))) for _ in range(n)]
    rows = [(i, draw.choice(texts)) for i in range(n)]
    rows += [(n + i, "hot") for i in range(n // 2)]  # a third of all rows
    rows += [(None, "Hot"), (None, "only nameless"), (None, "only nameless"), (n, None), (3, "hot"), (3, "HOT")]
    rows += [(n * 2, "own twice"), (n * 2, "own twice")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize(
    "limits",
    [
        {},
        {"hash_bits": 0},  # every text of a length in one trie
        {"hash_bits": 0, "trie_bytes": 3000},  # subtrees given up, over several rounds
        {"hash_bits": 2, "trie_bytes": 2000, "fan_in": 2},  # two steps as well
    ],
)
def test_against_plain_python(spark, keep, limits):
    rows = some_rows(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = docs.withColumn("node", F.lit("clash")).withColumn("kept", F.lit(1))
    check(trie_dedup.duplicates(docs, keep, **limits), rows, keep == "largest")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert trie_dedup.duplicates(docs).collect() == []


def test_other_ids(spark):
    rows = [("b", "x"), ("a", "X"), (None, "x"), ("c", "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    check(trie_dedup.duplicates(docs), rows, False)
    with pytest.raises(ValueError):
        trie_dedup.duplicates(docs, keep="any")


def test_trie_ends_equal_strings_only_in_one_node():
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab\x00\xff") for _ in range(draw.randrange(0, 9))) for _ in range(3000)]
    trie = trie_dedup.Trie()
    ends = {}
    for text in texts:
        node, depth = trie.place(text)
        node.count += 1
        assert depth == len(text)
        assert ends.setdefault(text, node) is node
    assert len({id(n) for n in ends.values()}) == len(ends)
    assert sorted(t for t, _ in trie.terminals()) == sorted(ends)


def test_given_up_subtrees_hold_what_lies_below_their_path():
    draw = random.Random(6)
    texts = {bytes([97]) * 50 + bytes(draw.choice(b"abcd") for _ in range(8)) for _ in range(500)}
    trie = trie_dedup.Trie()
    for text in sorted(texts):
        trie.place(text)[0].count += 1
    size = trie.size
    gone = [(path, text) for path, text, _ in trie.give_up(size // 2)]
    assert gone and all(text.startswith(path) and len(path) == 51 for path, text in gone)
    stays = {t for t, _ in trie.terminals()}
    assert stays and stays | {t for _, t in gone} == texts and not stays & {t for _, t in gone}
    assert trie.size <= size // 4 or len({p for p, _ in gone}) == 3
    for path, text in gone:
        node, depth = trie.place(text)
        assert node.given_up and text[:depth] == path


def test_query_against_sql(spark, sf_dir):
    name = "op13_trie_exact_dedup"
    tables = compare.connect(sf_dir)
    assert compare.spark_rows(QUERIES[name](spark, sf_dir)) == compare.sql_rows(tables, ORACLES[name])
