import math

import pytest
from pyspark.sql import functions as F

from rankbench.operators import lexical, lexicon_index
from rankbench.plans import chains
from rankbench.session import fresh_path


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame(
        [("d1", "a a b"), ("d2", "b c"), ("d3", "c"), ("d4", "")], "docno string, text string"
    )
    topics = spark.createDataFrame([("q", "a a x")], "qid string, query string")
    index = lexicon_index.build_index(corpus)
    got = lexical.retrieve(topics, index).collect()
    idf = math.log2((4 - 1 + 0.5) / 1.5)
    part = 2 * 1.9 / (2 + 0.9 * (0.6 + 0.4 * 3 / 1.5))
    assert [(r["docno"], r["rank"]) for r in got] == [("d1", 1)]
    assert got[0]["score"] == pytest.approx(idf * part * 9 * 2 / 10, abs=1e-6)
    assert {r["docno"]: r["dl"] for r in index.doclen.collect()} == {
        "d1": 3, "d2": 2, "d3": 1, "d4": 0,
    }


def test_idf_forms(spark):
    row = spark.range(1).select(
        *[lexical.robertson_idf(F.lit(10), F.lit(8), f).alias(f) for f in ("robertson", "plus1", "floor")]
    ).first()
    assert row["robertson"] < 0 < row["plus1"] and row["floor"] == 0


def skewed(spark):
    """A corpus in which one word fills more than a third of the postings."""
    return spark.range(400).select(
        F.concat(F.lit("d"), "id").alias("docno"),
        F.concat_ws(
            " ", F.lit("the"), F.concat(F.lit("w"), F.col("id") % 37),
            F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id") % 5)),
        ).alias("text"),
    )


def test_shuffled_and_broadcast_queries_agree_under_skew(spark):
    index = lexicon_index.write_index(skewed(spark), fresh_path(spark, "skewed"))
    topics = spark.range(60).select(
        F.concat(F.lit("q"), "id").alias("qid"),
        F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), F.col("id") % 40)).alias("query"),
    )
    small = lexical.retrieve(topics, index)
    large = lexical.retrieve(topics, index, broadcast_rows=0)
    assert small.count() == 600
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert "PythonUDF" not in large._jdf.queryExecution().executedPlan().toString()


def test_scores_are_summed_without_a_shuffle(spark, chat):
    plan = lexical.retrieve(chat.topics, chat.index)._jdf.queryExecution().executedPlan().toString()
    scoring = plan[: plan.index("rankbench_")]
    assert scoring.count("Exchange hashpartitioning") - scoring.count("hashpartitioning(qid") <= 0
    assert plan.count("WindowGroupLimit") == 2 and "Python" not in plan
    assert "ReadSchema: struct<docno:string,dl:int,term:string,tf:int>" in plan


def test_written_and_lazy_index_agree(spark, chat):
    lazy = lexicon_index.build_index(chat.corpus)
    for part in ("postings", "lexicon", "stats", "doclen"):
        a, b = getattr(lazy, part), getattr(chat.index, part)
        assert a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(a.columns))).isEmpty()


def test_pretokenised_bigrams_give_the_same_postings(spark, chat):
    from rankbench.operators.prepare import pretokenised

    wide = lexicon_index.build_index(pretokenised(chat.corpus, "docno", "text", 2)).postings
    assert wide.exceptAll(chat.bigram_index.postings.select(*wide.columns)).isEmpty()


def test_title_terms_come_first(spark):
    corpus = spark.createDataFrame([("d", "T u", "v w")], "docno string, title string, text string")
    index = lexicon_index.write_index(corpus, fresh_path(spark, "titled"), 2, title=True)
    assert index.docstore.first()["text_tok"] == "t u v w v_w"
    assert {r["term"] for r in index.postings.collect()} == {"t", "u", "v", "w", "v_w"}


def test_okapi_pairs_against_python(spark):
    rows = [
        (1, "a b b", "A a b c", "b c d"),
        (2, "c", "a b", "c c c c"),
        (3, "zz b", "b", "d e f"),
    ]
    triples = spark.createDataFrame(
        rows, "triple_id long, query string, positive string, negative string"
    )
    from rankbench.operators.diagnostics import contradictions, okapi_scores

    docs = [r[2].split() for r in rows] + [r[3].split() for r in rows]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}

    def score(query, doc):
        return sum(
            idf.get(t, 0) * doc.count(t) * 2.5 / (doc.count(t) + 1.5 * (0.25 + 0.75 * len(doc) / avg))
            for t in query.split()
        )

    got = {(r["triple_id"], r["side"]): r["score"] for r in okapi_scores(triples).collect()}
    worse = 0
    for i, query, positive, negative in rows:
        p, m = score(query, positive.split()), score(query, negative.split())
        assert got[i, "positive"] == pytest.approx(p, abs=1e-6)
        assert got[i, "negative"] == pytest.approx(m, abs=1e-6)
        worse += m > p
    assert contradictions(triples).first()["contradictions"] == worse


def test_reranking_permutes_its_candidates(spark, chat):
    first = lexical.retrieve(chat.topics, chat.index).select("qid", "docno")
    for run in (
        chains.bm25_pair(chat.topics, chat.index),
        chains.bm25_dense(chat.topics, chat.index, chat.topic_vectors, chat.vectors),
    ):
        pairs = run.select("qid", "docno")
        assert pairs.exceptAll(first).isEmpty() and first.exceptAll(pairs).isEmpty()


def test_postings_are_counted_without_a_shuffle(spark, chat):
    stored = chat.index.docstore.select(
        "docno", lexicon_index.index_terms(text="text_raw").alias("terms")
    )
    plan = lexicon_index.count_terms(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    corpus = skewed(spark)
    assert lexicon_index.bucket_count(corpus) == 8
    n_bytes = sum(len(r["text"].encode()) for r in corpus.collect())
    monkeypatch.setattr(lexicon_index, "BYTES_PER_BUCKET", n_bytes // 20 + 1)
    wide = lexicon_index.bucket_count(corpus)
    assert 15 < wide <= 20
    index = lexicon_index.write_index(corpus, fresh_path(spark, "wide"))
    plan = index.postings.groupBy("docno").count()._jdf.queryExecution().executedPlan().toString()
    assert f"SelectedBucketsCount: {wide} out of {wide}" in plan and "Exchange" not in plan
    assert index.stats.first()["n_docs"] == 400


def test_ids_and_terms_are_whole(spark):
    """Ids that share 50 characters are two documents; terms of any length are found."""
    long = "x" * 300
    corpus = spark.createDataFrame(
        [("p" * 60 + "1", f"same {long}"), ("p" * 60 + "2", f"same {long}"), ("q", "other")],
        "docno string, text string",
    )
    topics = spark.createDataFrame([("t", long)], "qid string, query string")
    for index in (
        lexicon_index.build_index(corpus),
        lexicon_index.write_index(corpus, fresh_path(spark, "whole")),
    ):
        assert {r["docno"] for r in index.docstore.collect()} == {"p" * 60 + "1", "p" * 60 + "2", "q"}
        found = chains.bm25_pair(topics, index).collect()
        assert {r["docno"] for r in found} == {"p" * 60 + "1", "p" * 60 + "2"}
        assert index.docstore.where("docno != 'q'").first()["text_tok"] == f"same {long}"


def test_raw_query_goes_to_the_reranker_only(spark):
    """The tokenised query retrieves; the scorer sees the query as it was written."""
    corpus = spark.createDataFrame([("d1", "big cat"), ("d2", "cat big")], "docno string, text string")
    index = lexicon_index.write_index(corpus, fresh_path(spark, "raw-query"), 2)
    topics = spark.createDataFrame([("q", "Big CAT!")], "qid string, query string")
    both = chains.keep_raw_query(topics, 2).first()
    assert (both["query"], both["query_raw"]) == ("big cat big_cat", "Big CAT!")
    seen = []

    def scorer(pairs):
        seen.append([r["query"] for r in pairs.select("query").distinct().collect()])
        return pairs.withColumn("score", F.length("query").cast("double"))

    got = chains.bm25_pair_pretokenised(topics, index, scorer).collect()
    assert seen == [["Big CAT!"]] and {r["score"] for r in got} == {8.0}
    found = lexical.retrieve(chains.keep_raw_query(topics, 2), index, pretokenised=True)
    assert found.exceptAll(lexical.retrieve(topics, index)).isEmpty() and found.count() == 2


def test_a_bucket_holds_little_text(spark):
    """Memory of a task stays the same however large the corpus is."""
    corpus = spark.range(48).select(
        F.col("id").cast("string").alias("docno"), F.repeat(F.lit("a b "), 1 << 19).alias("text")
    )
    n_bytes = 48 << 21
    assert lexicon_index.bucket_count(corpus) >= n_bytes / (8 << 20)
    assert lexicon_index.bucket_count(corpus, 2) >= n_bytes / (4 << 20)  # with bigrams


def test_a_bucket_holds_few_documents(spark):
    """Nor does it grow with a corpus of very short texts, or of none."""
    corpus = spark.range(20 << 12).select(
        F.col("id").cast("string").alias("docno"), F.when(F.col("id") % 2 == 0, "a").alias("text")
    )
    assert lexicon_index.bucket_count(corpus) == 20
    assert lexicon_index.bucket_count(corpus.limit(10)) == 8


def test_queries_in_blocks_give_the_same_rows(spark):
    """Repeats, nulls, negative weights, ties and documents without a shared term."""
    corpus = skewed(spark).unionByName(
        spark.createDataFrame(
            [(None, "the w1 x1"), (None, "w2 w2"), ("d7", "the other text w1"), ("e", None), ("f", "")],
            "docno string, text string",
        )
    )
    index = lexicon_index.write_index(corpus, fresh_path(spark, "blocks"))
    topics = spark.range(300).select(
        F.when(F.col("id") % 50 != 3, F.concat(F.lit("q"), F.col("id") % 290)).alias("qid"),
        F.when(
            F.col("id") % 60 != 5,
            F.concat_ws(" ", F.lit("the the"), F.concat(F.lit("w"), F.col("id") % 40), F.concat(F.lit("x"), F.col("id") % 9)),
        ).alias("query"),
    ).unionByName(spark.createDataFrame([("rare", "x1 w1"), ("none", "zz")], "qid string, query string"))
    both = {"bm25": lexical.bm25_weights(), "tfidf": lexical.tfidf_weights()}
    rows = lexical.retrieve_many(topics, index, both)
    blocks = lexical.retrieve_many(topics, index, both, joined_queries=0)
    assert blocks.columns == rows.columns and blocks.schema["rank"].dataType == rows.schema["rank"].dataType
    assert rows.count() > 5000
    assert [rows.exceptAll(blocks).take(5), blocks.exceptAll(rows).take(5)] == [[], []]


def test_many_queries_are_not_joined_row_by_row(spark):
    index = lexicon_index.write_index(skewed(spark), fresh_path(spark, "many"))
    topics = spark.range(1500).select(F.concat(F.lit("q"), "id").alias("qid"), F.lit("the w1").alias("query"))
    plan = lexical.retrieve(topics, index)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert lexical.retrieve(topics, index).count() == 15000


def test_common_and_rare_terms_are_summed_alike(monkeypatch):
    import numpy as np
    import pandas as pd

    from rankbench.operators import term_blocks

    draw = np.random.default_rng(1)

    def frame(n):
        terms = [[f"t{x}" for x in draw.integers(0, 30, draw.integers(0, 9))] for _ in range(n)]
        return pd.DataFrame({"terms": terms, "weights": [draw.normal(size=len(t)) for t in terms]})

    queries, docs = frame(40), frame(300)
    want = np.full((40, 300), np.nan)
    for i, (a, x) in enumerate(zip(queries["terms"], queries["weights"])):
        for j, (b, y) in enumerate(zip(docs["terms"], docs["weights"])):
            if set(a) & set(b):
                want[i, j] = sum(p * q for s, p in zip(a, x) for t, q in zip(b, y) if s == t)
    for docs_at_least, most, matches in ((16, 2048, 10**6), (10**6, 2048, 50), (1, 2048, 50), (1, 5, 50)):
        monkeypatch.setattr(term_blocks, "COMMON_DOCS", docs_at_least)
        monkeypatch.setattr(term_blocks, "MOST_COMMON", most)
        monkeypatch.setattr(term_blocks, "MATCHES", matches)
        got = term_blocks.matrix_scorer()(queries)(docs)
        assert np.allclose(got, want, equal_nan=True)
