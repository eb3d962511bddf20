import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankbench.operators import dense, pairs
from rankbench.operators.exhaustive import exhaustive_top_k


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(7)
    docs = rng.integers(-2, 3, size=(130, 4)).astype(float)  # many ties
    queries = rng.integers(-2, 3, size=(17, 4)).astype(float)
    docs[5] = 0
    frames = [
        spark.createDataFrame(
            [(f"{name}{i}", v.tolist()) for i, v in enumerate(m)],
            f"{key} string, embedding array<double>",
        )
        for name, key, m in (("q", "qid", queries), ("d", "docno", docs))
    ]

    def unit(m):
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    scores = np.floor(unit(queries) @ unit(docs).T * 1e6 + 0.5) / 1e6
    names = np.array([f"d{i}" for i in range(len(docs))])
    expected = {}
    for i, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda j: (-row[j], names[j]))[:10]
        expected[f"q{i}"] = [(names[j], row[j]) for j in order]
    return frames, expected


def ranked(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["docno"], r["score"]))
    return out


def test_exhaustive_against_brute_force(toy):
    (queries, docs), expected = toy
    got = ranked(dense.retrieve_dense(queries, docs))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {
        q: [d for d, _ in v] for q, v in expected.items()
    }


def test_many_batches_give_the_same(toy):
    (queries, docs), _ = toy
    whole = dense.retrieve_dense(queries, docs)
    assert ranked(whole) == ranked(dense.retrieve_dense(queries, docs, batch_queries=5))
    assert ranked(whole) == ranked(dense.retrieve_dense(queries, docs, batch_bytes=400))


def test_cells_give_the_same_and_documents_are_scanned_once(spark, toy, tmp_path):
    (queries, docs), _ = toy
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    found = dense.retrieve_dense(queries, docs, batch_queries=4, cell_docs=7)
    assert ranked(found) == ranked(dense.retrieve_dense(queries, docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan")].count("FileScan parquet") == 1


def test_repeated_ids_fill_no_cell(spark):
    docs = spark.createDataFrame([("same", float(i)) for i in range(500)], "docno string, x double")
    queries = spark.createDataFrame([("q",), ("q",)], "qid string")

    def scorer():
        return lambda asked: lambda part: np.tile(part["x"].to_numpy(), (len(asked), 1))

    got = exhaustive_top_k(queries, docs, scorer, k=4, cell_docs=50).orderBy("rank").collect()
    assert [r["score"] for r in got] == [499.0, 499.0, 498.0, 498.0]


def test_small_blocks_give_one_frame_with_the_same(toy, monkeypatch):
    from rankbench.operators import exhaustive

    (queries, docs), expected = toy
    monkeypatch.setattr(exhaustive, "DOC_BLOCK", 16)
    monkeypatch.setattr(exhaustive, "QUERY_BLOCK", 3)
    frame = docs.toPandas()
    best = exhaustive.best_per_query(
        queries.toPandas(), iter([frame[:70], frame[70:]]), dense.cosine_scorer, 10
    )
    for qid, rows in best.groupby("qid"):
        assert rows["docno"].tolist() == [d for d, _ in expected[qid]]


@pytest.mark.parametrize("bad", [3, 12, 38, 40])
def test_scores_that_are_no_numbers_come_last(spark, bad):
    docs = spark.createDataFrame([(f"d{i:02}", float(i)) for i in range(40)], "docno string, x double")
    queries = spark.createDataFrame([("q",)], "qid string")

    def scorer():
        def score(part):
            x = part["x"].to_numpy()
            return np.where(x < bad, np.nan, x)[None, :]

        return lambda queries: score

    got = exhaustive_top_k(queries, docs, scorer).orderBy("rank").collect()
    good = [(f"d{i:02}", float(i)) for i in range(39, bad - 1, -1)]
    assert [(r["docno"], r["score"]) for r in got] == (
        good + [(f"d{i:02}", None) for i in range(bad)]
    )[:10]


def test_model_loads_once_per_task(spark, tmp_path):
    loads = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(loads, uuid.uuid4().hex), "w").close()
        return lambda query, text: text.str.len().to_numpy(float)

    topics = spark.createDataFrame([(f"q{i}", "a") for i in range(300)], "qid string, query string")
    corpus = spark.createDataFrame([(f"d{i}", "a" * i) for i in range(200)], "docno string, text string")
    # 15 blocks meet 8 cells in at most 8 tasks
    pairs.retrieve_pairs_with(topics, corpus, load, k=1, batch_queries=20, cell_docs=25).count()
    import os

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 <= len(os.listdir(loads)) <= tasks


def test_missing_vectors_score_null_and_come_last(spark):
    run = spark.createDataFrame([("q", "d1"), ("q", "gone")], "qid string, docno string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")
    d = spark.createDataFrame([("d1", [-1.0, 0.0])], "docno string, embedding array<double>")
    from rankbench.plans.chains import rerank_dense

    got = run.transform(rerank_dense(q, d)).orderBy("rank").collect()
    assert [(r["docno"], r["score"]) for r in got] == [("d1", -1.0), ("gone", None)]


def test_model_encoder_batches(spark):
    texts = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(40)], "docno string, text string")

    def load():
        def model(part):
            assert len(part) <= 16
            return np.stack([np.array([len(t), 1.0]) for t in part])

        return model

    got = dense.encode_with(texts, load, "docno", "text").collect()
    assert len(got) == 40
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 for r in got)


def test_exhaustive_pairs_equal_scoring_every_pair(spark, chat):
    topics, corpus = chat.topics, chat.corpus
    every = pairs.score_pairs(topics.join(corpus.select("docno", "text"), F.lit(True)))
    from rankbench.operators.ranking import top_k

    expected = top_k(every.select("qid", "docno", "score"))
    got = pairs.retrieve_pairs(topics, corpus)
    assert got.select(*expected.columns).exceptAll(expected).isEmpty()
    assert got.count() == expected.count()


def test_user_model_over_every_document(spark):
    topics = spark.createDataFrame([("q1", "aa"), ("q2", "b")], "qid string, query string")
    corpus = spark.createDataFrame([(f"d{i}", "a" * i) for i in range(70)], "docno string, text string")

    def load():
        return lambda query, text: -(query.str.len() * 10 - text.str.len()).abs().to_numpy(float)

    got = ranked(pairs.retrieve_pairs_with(topics, corpus, load, k=2))
    assert [d for d, _ in got["q1"]] == ["d20", "d19"]
    assert [d for d, _ in got["q2"]] == ["d10", "d11"]


def test_pair_model_separates(spark):
    rows = [(float(i % 2), 1.0 - (i % 2) * 0.9, i % 2) for i in range(60)]
    features = spark.createDataFrame(rows, "a double, b double, label int")
    model = pairs.train_pair_scorer(features, ["a", "b"])
    scored = pairs.apply_pair_model(model, features).groupBy("label").agg(F.avg("score").alias("s"))
    means = {r["label"]: r["s"] for r in scored.collect()}
    assert means[1] > 0.8 > 0.2 > means[0]


def test_block_scorer_contract(spark):
    docs = spark.createDataFrame([("d", "x")], "docno string, text string")
    none = spark.createDataFrame([], "qid string, query string")
    run = exhaustive_top_k(none, docs, lambda: lambda q: lambda d: np.zeros((len(q), len(d))))
    assert run.count() == 0
    assert isinstance(none.toPandas(), pd.DataFrame)


def test_models_load_once_per_worker(spark, tmp_path):
    """More tasks than workers: the model is not loaded for each of them."""
    import os

    loads = str(tmp_path)

    def load():
        import uuid

        open(os.path.join(loads, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def model(query, text):
            assert len(query) <= 8
            return query.str.len().to_numpy(float) + text.str.len().to_numpy(float) / 100

        return model

    rows = spark.createDataFrame([("a" * (i % 9), "b" * (i % 7)) for i in range(400)], "query string, text string")
    scored = pairs.score_pairs(rows.repartition(40), pairs.batch_scorer(load, batch=8))
    assert all(
        r["score"] == pytest.approx(len(r["query"]) + len(r["text"]) / 100) for r in scored.collect()
    )
    workers = [name.split("-")[0] for name in os.listdir(loads)]
    assert 1 <= len(workers) < 40 and len(workers) == len(set(workers))


def test_only_rare_words_are_shuffled_for_their_weight(spark, monkeypatch):
    """A word of one in 1,500 postings meets its weight where it lies."""
    from rankbench.operators import lexicon_index

    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: F.concat(F.lit("w"), i)))
    corpus = spark.range(3).select(F.col("id").cast("string").alias("docno"), words.alias("text"))
    index = lexicon_index.build_index(corpus)
    seen = []
    plain = dense.lookup_join
    monkeypatch.setattr(dense, "lookup_join", lambda *a: seen.append(a[3].count()) or plain(*a))
    assert dense.encode_documents(index).count() == 3
    assert seen == [1500]


def test_pairs_of_blocks_and_cells_are_dealt_evenly(spark):
    """Their time is rows times columns, so none is put together with another for its few bytes."""
    from pyspark import TaskContext

    def scorer():
        task = TaskContext.get().partitionId()
        return lambda queries: lambda docs: np.full((len(queries), len(docs)), float(task))

    queries = spark.range(50).select(F.col("id").cast("string").alias("qid"))
    docs = spark.range(100).select(F.col("id").cast("string").alias("docno"))
    found = exhaustive_top_k(queries, docs, scorer, 100, batch_queries=20, cell_docs=10)
    met = found.groupBy("score").agg(F.countDistinct("qid"), F.countDistinct("docno")).collect()
    assert found.count() == 5000
    assert len(met) == 30  # 3 blocks x 10 cells, a task each
    assert max(r[1] for r in met) <= 24 and max(r[2] for r in met) <= 16


def test_many_pairs_share_tasks(spark):
    from rankbench.operators.exhaustive import pair_tasks

    assert pair_tasks(spark, 5) == 5
    assert pair_tasks(spark, 10**6) == 64  # 8 for each of 8 cores


def test_documents_are_moved_for_blocks_and_not_for_batches(spark, monkeypatch):
    """20 batches of queries are two blocks where there are cells enough for all cores."""
    from rankbench.operators import exhaustive

    moved = []
    each = exhaustive._each
    monkeypatch.setattr(exhaustive, "_each", lambda n: moved.append(n) or each(n))
    queries = spark.range(100).select(F.col("id").cast("string").alias("qid"))
    docs = spark.range(400).select(F.col("id").cast("string").alias("docno"))

    def scorer():
        return lambda asked: lambda part: np.tile(part["docno"].astype(float), (len(asked), 1))

    found = exhaustive_top_k(queries, docs, scorer, 2, batch_queries=5, cell_docs=10)
    assert sorted(moved) == [2, 40]
    assert found.groupBy("docno").count().orderBy("docno").collect() == [("398", 100), ("399", 100)]


def test_bars_leave_out_no_result():
    """Pieces scored up to a bar give the rows of whole matrices, ties and repeated terms too."""
    from rankbench.operators import exhaustive, term_blocks

    draw = np.random.default_rng(5)

    def frame(n, name):
        terms = [[f"t{min(x, 40)}" for x in draw.geometric(0.1, draw.integers(0, 9))] for _ in range(n)]
        weights = [draw.integers(-2, 9, len(t)) / 4 for t in terms]
        return pd.DataFrame({name: [f"{name}{i}" for i in range(n)], "terms": terms, "weights": weights})

    queries, docs = frame(150, "qid"), frame(900, "docno")
    matrix = exhaustive.rounded(term_blocks.matrix_scorer()(queries)(docs))
    want = []
    for i, row in enumerate(matrix):
        order = sorted(np.flatnonzero(~np.isnan(row)), key=lambda j: (-row[j], docs["docno"][j]))
        want += [(f"qid{i}", docs["docno"][j], row[j]) for j in order[:7]]
    pieces = [docs[a:b].reset_index(drop=True) for a, b in ((0, 30), (30, 200), (200, 900))]
    for stream in (pieces, [exhaustive.unpack(exhaustive.pack(term_blocks.by_term(p))) for p in pieces]):
        got = exhaustive.best_per_query(queries, iter(stream), term_blocks.matrix_scorer, 7)
        assert list(got.itertuples(index=False, name=None)) == want

    vectors = pd.DataFrame({"docno": docs["docno"], "embedding": list(draw.integers(-1, 2, (900, 5)))})
    asked = pd.DataFrame({"qid": queries["qid"], "embedding": list(draw.integers(-1, 2, (150, 5)))})
    whole = exhaustive.best_per_query(asked, iter([vectors]), lambda: lambda q: dense.cosine_scorer()(q).__call__, 7)
    parts = [dense.UnitVectors(vectors[a:b]) for a, b in ((0, 30), (30, 200), (200, 900))]
    assert exhaustive.best_per_query(asked, iter(parts), dense.cosine_scorer, 7).equals(whole)

    def words(f, key):
        found = f["terms"].map(lambda t: list(dict.fromkeys(t)))
        return pd.DataFrame({key: f[key], "words": found, "n_words": f["terms"].map(len)})

    asked, read = words(queries, "qid"), words(docs, "docno")
    whole = exhaustive.best_per_query(asked, iter([read]), lambda: lambda q: pairs.overlap_scorer()(q).__call__, 7)
    parts = [read[a:b].reset_index(drop=True) for a, b in ((0, 30), (30, 200), (200, 900))]
    assert exhaustive.best_per_query(asked, iter(parts), pairs.overlap_scorer, 7).equals(whole)
