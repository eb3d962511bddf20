"""Language models against plain dictionaries, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rankbench.llm import langid
from rankbench.llm.queries import QUERIES


def slow_grams(text, order=5):
    clean = ""
    for c in (text or "").lower():
        if c.isalpha():
            clean += c
        elif clean and clean[-1] != " ":
            clean += " "
    if clean and not clean.endswith(" "):
        clean += " "  # the end of a text is a break as well
    padded = " " * (order - 1) + clean
    return [padded[k : k + order] for k in range(len(clean))]


def slow_model(texts, characters, order=5):
    """Probability function of (context + character) by the definition."""
    counts = {order: Counter(g for t in texts for g in slow_grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, sums, kinds = {}, {}, {}
    for n, table in counts.items():
        n1, n2 = (sum(v == k for v in table.values()) for k in (1, 2))
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        sums[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, v in table.items():
            sums[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / characters
        below, context = p(gram[1:]), gram[:-1]
        if not sums[n][context]:
            return below
        return (
            max(counts[n][gram] - discount[n], 0) + discount[n] * kinds[n][context] * below
        ) / sums[n][context]

    return p


TEXTS = ["The cat sat, on the mat 42 times!", "a cat's bat", "", "...", "Über den Fluß -- mat", "the thé"]


def test_grams():
    doc, matrix = langid.grams(TEXTS)
    for k, text in enumerate(TEXTS):
        rows = ["".join(map(chr, row)) for row in matrix[doc == k].tolist()]
        assert rows == slow_grams(text)


def test_probabilities_follow_the_definition():
    _, matrix = langid.grams(TEXTS)
    _, first, counts = np.unique(langid.hashed(matrix), return_index=True, return_counts=True)
    model = langid.kneser_ney(matrix[first], counts, 30)
    p = slow_model(TEXTS, 30)
    probes = [g for t in [*TEXTS, "zebra the mats", "über cats"] for g in slow_grams(t)]
    found = model.log_probability(np.array([[ord(c) for c in g] for g in probes], np.uint64))
    assert np.allclose(found, [math.log(p(g)) for g in probes])
    alphabet = [chr(c) for c in sorted({ord(c) for t in TEXTS for c in t.lower() if c.isalpha()} | {32})]
    assert sum(p("the " + c) for c in alphabet) <= 1 + 1e-9


def corpus(n=240):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "nu", "te"], "bb": ["sch", "ein", "ung", "lich", "er"], "cc": ["ció", "ado", "que", "ñe", "os"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_and_rejection(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("check", F.lit("clash"))
    model = langid.learn(langid.sample_of(docs.where("doc_id % 4 != 1")))
    extra = [(900, None, None), (901, "", None), (902, "12 34 !?", None), (903, "ЖЖЩ ЪЫЭ ЮЯЖ ЩЩЪ", None), (904, "kalo " * 200_000, None)]
    every = docs.drop("check").unionByName(spark.createDataFrame(extra, docs.drop("check").schema))
    found = {
        r["doc_id"]: r["f"]
        for r in every.select("doc_id", langid.identify(F.col("text"), model, spark).alias("f")).collect()
    }
    held = [r for r in rows if r[0] % 4 == 1]
    assert all(found[i]["best"] == lang for i, _, lang in held)
    assert all(0 <= f["score"] <= 1 for f in found.values())
    for i in (900, 901, 902):
        assert found[i]["best"] == found[i]["lang"] == "und" and found[i]["score"] == 0
    assert found[903]["lang"] == "und" and found[903]["best"] != "und"
    assert found[904]["best"] == "aa"


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.learn(langid.sample_of(docs))
    row = docs.select(langid.identify(F.col("text"), model, spark).alias("f")).first()
    assert row["f"]["best"] == "und"
    assert docs.limit(0).select(langid.identify(F.col("text"), model, spark)).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if rows[d["doc_id"]]["held_out"] and d["lang"]]
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.95 * len(held)
