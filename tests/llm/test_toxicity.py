"""Toxicity: folding, matching against plain Python, held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from rankbench.llm import toxicity
from rankbench.llm.queries import QUERIES


@pytest.mark.parametrize(
    "text, folded",
    [
        (None, "  "),
        ("", "  "),
        ("An IDIOT!", " an idiot "),
        ("1d10t, m0r0n", " idiot moron "),
        ("іdіоt", " idiot "),  # Cyrillic
        ("ｉｄｉｏｔ i​diot ídíót", " idiot idiot idiot "),
        ("$tup!d! in 2024 3.14", " stupid in 2024 3 14 "),
    ],
)
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def slow_matches(folded, weights, exceptions):
    words, at, best = folded.split(), 0, {}
    starts = []
    for word in words:
        starts.append(at)
        options = [
            w for e, w in weights.items()
            if (e.endswith(" ") and e == f" {word} ") or (not e.endswith(" ") and f" {word}".startswith(e))
        ]
        if options:
            best[at] = max(options)
        at += len(word) + 1
    for k in range(len(words) - 1):
        if f" {words[k]} {words[k + 1]} " in exceptions:
            best.pop(starts[k], None)
            best.pop(starts[k + 1], None)
    return best


def test_matches_against_plain_python():
    rng = random.Random(0)
    weights = {" clown ": 3.0, " stup": 2.0, " stupid": 4.0, " ab": 1.5, " ": 0.0}
    del weights[" "]
    exceptions = frozenset({" clown fish ", " ab stupid "})
    automaton = toxicity.Model(weights, exceptions, ()).automaton()
    pool = ["clown", "fish", "stupid", "stupidly", "stupor", "abc", "ab", "clowns", "x"]
    for _ in range(500):
        folded = toxicity.fold(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 8))))
        assert toxicity.matches(folded, automaton) == slow_matches(folded, weights, exceptions)


def corpus(n=3000):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("rn", "lt", "nd", "sk")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(1 + len(text) // 15):
                text.insert(rng.randrange(len(text)), rng.choice(["zorbag", "m0rlax", "vilkesta", "vilkemu"]))
        elif i % 100 == 1:
            text.insert(2, "zorbag salad")  # only clean documents say that
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learned_model_on_held_out_documents(spark):
    docs, labels = corpus()
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = labels.where("doc_id % 4 != 2")
    model = toxicity.learn(toxicity.sample_of(docs, train))
    assert any(e.startswith(" vilk") for e in model.weights) and len(model.weights) < 8
    assert " zorbag salad " in model.exceptions
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s"))
    rows = scored.join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert sum((r["s"] >= 0.3) == (r["toxic"] == 1) for r in rows) >= 0.98 * len(rows)


def test_edges(spark):
    docs, labels = corpus(400)
    docs += [(9001, None), (9002, ""), (9003, "zorbag " * 100_000), (None, "zorbag"), (5, docs[5][1])]
    labels += [(0, 1), (0, None), (None, 1), (5, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(toxicity.sample_of(docs, labels))
    rows = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    found = {r["doc_id"]: r["s"] for r in rows}
    assert found[9001] == found[9002] < 0.3 and found[9003] > 0.5
    assert all(0 <= r["s"] <= 1 for r in rows) and len(rows) == docs.count()
    empty = toxicity.learn(toxicity.sample_of(docs, labels.limit(0)))
    rows = docs.select(toxicity.score(F.col("text"), empty).alias("s")).collect()
    assert all(r["s"] < 0.01 for r in rows)
    assert docs.limit(0).select(toxicity.score(F.col("text"), model)).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = QUERIES["op1_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_a_rarer_term_is_not_crowded_out_by_ordinary_words(spark):
    """More ordinary words than any bound on entries, in every document of both labels."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "kmx"][:21_000]
    ordinary = " ".join(words)
    rows = [(ordinary + (" zorgblatter" if k < 16 else ""), 1, 0) for k in range(40)]
    rows += [(ordinary, 0, 0)] * 60 + [("zorgblatter here", 1, 1), ("nothing here", 0, 1)] * 5
    sample = spark.createDataFrame(rows, "text string, toxic int, half int").repartition(8)
    model = toxicity.learn(sample)
    assert any("zorgblatter".startswith(entry.strip()) for entry in model.weights)
    assert not any(entry.strip() in words for entry in model.weights)


def test_query_finds_the_labels_it_did_not_learn(spark, sf_dir):
    """Held-out accuracy of the query itself, on a table of some size."""
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_toxicity"](spark, folder).collect() if r["doc_id"] in labels]
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum(labels[r["doc_id"]] for r in held) > 5
    found = sum(r["predicted"] for r in held if labels[r["doc_id"]] == 1)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95
    # some labels have no toxic word in their text, or one beside the wrong label
    assert found / sum(labels[r["doc_id"]] for r in held) > 0.75
    assert found / sum(r["predicted"] for r in held) > 0.85


def test_few_items_are_held_while_texts_are_counted(spark, monkeypatch):
    words = " ".join(f"word{i:06}" for i in range(2000))
    sample = spark.createDataFrame([(words,), (words,), ("word000001 other",)], "text string").coalesce(1)

    def items():
        return lambda text: set(text.split())

    whole = sorted(map(tuple, toxicity._counted(sample, items).collect()))
    assert len(whole) == 2001 and ("word000001", 3) in whole
    # counts given out in parts add up to the same
    monkeypatch.setattr(toxicity, "HELD_ITEMS", 100)
    assert sorted(map(tuple, toxicity._counted(sample, items).collect())) == whole
