"""SimHash near-dedup against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rankbench.llm import simhash
from rankbench.llm.queries import QUERIES

SPACE = " \t\n\v\f\r"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in SPACE:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=3):
    """doc_id -> smallest id reachable."""
    best = {i: i for i, _ in rows}
    prints = dict(rows)
    links = [
        (a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= bits
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def planted(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "x"
            texts.append(" ".join(copy))
    texts += [None, "", " \n\t", "One", "one two", "A b C", "a B c", "é Ü x y z", "long " * 20000]
    return list(enumerate(texts, start=100))


def test_fingerprints_and_components(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    for block in (4096, 3):  # the small block sends groups through the second step
        found = {r["doc_id"]: r for r in simhash.near_duplicates(docs, block=block).collect()}
        slow = [(i, slow_fingerprint(t)) for i, t in rows]
        assert {i: r["fp"] % 2**64 for i, r in found.items()} == dict(slow)
        assert {i: r["component_id"] for i, r in found.items()} == slow_components(slow)


def test_every_distance_up_to_three_is_found(spark):
    rng = random.Random(1)
    prints, expected = [], []
    for i in range(300):
        base = rng.getrandbits(64)
        other = base
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            other ^= 1 << bit
        prints += [base, other]
        expected.append((base ^ other).bit_count() <= 3)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.linked_fingerprints(spark.createDataFrame(signed, "fp long")).collect()
    pairs = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in links}
    assert pairs == {frozenset(prints[2 * k : 2 * k + 2]) for k in range(300) if expected[k]}


def test_one_row_of_each_component_stays(spark):
    rows = planted()
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    best = slow_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(best.values()))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, "other words here"), (None, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert sorted(str(r["component_id"]) for r in found) == ["1", "1", "1", "None", "None"]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.deduplicated(docs).collect())
    assert kept == [("1", text), ("None", "other words here")]


def test_an_id_in_several_components(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (1, b), (3, b), (0, c), (1, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicated(docs).collect())
    assert kept == [(0, c), (1, a), (1, b)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.deduplicated(docs).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = QUERIES["op9_simhash_dedup"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    slow = [(d["doc_id"], slow_fingerprint(d["text"])) for d in docs]
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == dict(slow)
    assert {r["doc_id"]: r["component_id"] for r in rows} == slow_components(slow)


def test_links_of_a_large_group_are_held_in_little_memory():
    centre = [0] + [1 << i for i in range(60)] + [1 << i | 1 << j for i in range(60) for j in range(i)]
    fps = np.sort(np.array(centre, np.int64))
    fps = np.concatenate([fps + (k << 60) for k in range(4)])  # each within three bits of many
    fps.sort()
    tracemalloc.start()
    nodes, roots = simhash._linked([np.zeros(len(fps), np.int64)], fps, simhash.MAX_BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == len(fps) - 1 and set(roots) == {0}
    assert peak < 20e6
