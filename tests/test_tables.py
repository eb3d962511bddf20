"""Numbering, splits, percentiles, files, blocks and shift on small hand-made rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench import schemas
from rankbench.functions.hashing import digest
from rankbench.operators import blocks, losses, numbering, prepare, quantiles, shift
from rankbench.operators.joins import hot_keys, lookup_join
from rankbench.session import fresh_path
from rankbench.sources import files


def test_numbers_follow_the_digest(spark):
    ids = spark.range(5000).select(F.col("id").cast("string"), (F.col("id") % 3).alias("g"))
    got = numbering.number_by_digest(ids, digest(1, F.col("id")), "n", ["g"])
    rows = got.withColumn("h", digest(1, F.col("id"))).orderBy("g", "h").collect()
    for g in range(3):
        assert [r["n"] for r in rows if r["g"] == g] == list(range(1, len([r for r in rows if r["g"] == g]) + 1))


def test_ordered_sums(spark):
    rows = spark.range(1, 2001).repartition(16).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["s"] for r in numbering.ordered_sums(rows, ["id"], {"s": "v"}).collect()}
    total = 0
    for i in range(1, 2001):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentiles(spark, p):
    groups = {
        "a": [1, 2, 3, 4, 10],
        "b": list(np.random.default_rng(1).normal(size=999)),
        "c": [5.0],
        "d": [7.0] * 600 + [1.0, 2.0, 9.0],
    }
    rows = spark.createDataFrame(
        [(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double"
    )
    got = {r["g"]: r["x"] for r in quantiles.exact_percentile(rows, ["g"], "v", p, "x").collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.percentile(vs, 100 * p), abs=1e-12)
    if p == 0.95:
        assert got["a"] == pytest.approx(8.8)


def test_lookup_join_with_a_hot_key(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id"
    )
    lookup = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(lookup, "k", "n")
    assert [r["k"] for r in hot.collect()] == ["hot"]
    joined = lookup_join(facts, lookup, "k", hot)
    assert joined.count() == 3000 and joined.where("k = 'hot' and n = 1500").count() == 1500


def test_exact_split(spark):
    docs = spark.range(997).select(F.col("id").cast("string").alias("docno"))
    parts = prepare.split_exact(docs, "docno", 0.1)
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {"train": 997 - 99, "eval": 99}
    again = prepare.split_exact(docs.repartition(5), "docno", 0.1)
    assert parts.exceptAll(again).isEmpty()
    assert prepare.split_exact(docs, "docno", 0.0).where("part = 'eval'").isEmpty()


def test_shuffle_is_repeatable(spark):
    docs = spark.range(200).select(F.col("id").cast("string").alias("docno"))
    first = [r["docno"] for r in prepare.shuffled(docs, "docno").collect()]
    second = [r["docno"] for r in prepare.shuffled(docs.repartition(3), "docno").collect()]
    assert first == second != sorted(first) and len(set(first)) == 200


def test_nulls_drop_the_row_before_projection(spark):
    raw = spark.createDataFrame(
        [("1", "t", "x", "te", "xe"), ("2", "t", "x", "te", None)], schemas.RAW_CORPUS
    )
    assert [r["docno"] for r in prepare.prepare_corpus(raw).collect()] == ["1"]


def test_csv_keeps_quotes_commas_and_newlines(spark):
    text = 'a "quoted", word\nand a second line, \\ back'
    df = spark.createDataFrame([("d1", "t", text), ("d2", " pad ", "x")], schemas.CORPUS)
    path = fresh_path(spark, "csv")
    files.write_csv(df, path)
    back = files.read_csv(spark, path, schemas.CORPUS)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.read_csv(spark, path, schemas.CORPUS, ["docno"]).columns == ["docno"]


def test_runs_by_file_stem_folder_and_partition(spark, tmp_path):
    (tmp_path / "alpha.trec").write_text("q1 Q0 d1 1 2.5 tag\nq1 Q0 d2 2 1.5 tag\n")
    os.mkdir(tmp_path / "beta.trec")
    (tmp_path / "beta.trec" / "part-0").write_text("q1\tQ0  d1 0 -1e-3 tag\n")
    got = {tuple(r) for r in files.read_runs(spark, str(tmp_path)).collect()}
    assert got == {
        ("alpha", "q1", "d1", 1, 2.5), ("alpha", "q1", "d2", 2, 1.5), ("beta", "q1", "d1", 0, -0.001),
    }
    run = spark.createDataFrame([("my sys", "q", "d", 1, 0.25)], schemas.RUN)
    path = fresh_path(spark, "runs")
    files.write_runs(run, path)
    assert [tuple(r) for r in files.read_runs(spark, path).collect()] == [("my sys", "q", "d", 1, 0.25)]


def test_later_columns_see_earlier_ones(spark):
    df = spark.createDataFrame([("A B",)], "text string")
    out = files.computed(
        df, {"text": lambda: F.lower("text"), "copy": lambda: F.col("text")}, {"text": "t"}
    )
    assert tuple(out.first()) == ("a b", "a b")


def packed_ids(spark, lengths, block=4):
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((0, f"d{i}", list(range(at, at + n))))
        at += n
    docs = spark.createDataFrame(rows, "batch int, docno string, ids array<int>")
    return [r["input_ids"] for r in blocks.packed(docs, block).orderBy("block").collect()]


def test_packing(spark):
    assert packed_ids(spark, [3, 6]) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert packed_ids(spark, [3]) == []
    assert packed_ids(spark, [0, 1, 1, 0, 1, 1]) == [[0, 1, 2, 3]]
    assert packed_ids(spark, [13]) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_token_ids_keep_empty_texts(spark):
    corpus = spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None)], "docno string, text string")
    got = blocks.token_ids(corpus, blocks.word_ids(corpus, 1))
    assert {r["docno"]: r["ids"] for r in got.collect()} == {"a": [2, 0, 2], "b": []}


def test_masking_share_and_labels(spark):
    docs = spark.createDataFrame(
        [(0, i, list(range(100, 612))) for i in range(20)], "batch int, block int, input_ids array<int>"
    )
    rows = blocks.masked(docs, 50).collect()
    chosen = [
        (x, y, i + 100) for r in rows for i, (x, y) in enumerate(zip(r["input_ids"], r["labels"])) if y != -100
    ]
    share = len(chosen) / (20 * 512)
    assert abs(share - 0.25) < 0.02
    assert all(y == original for _, y, original in chosen)
    assert abs(sum(x == blocks.MASK_ID for x, _, _ in chosen) / len(chosen) - 0.8) < 0.03


def test_auc_with_ties(spark):
    rows = spark.createDataFrame(
        [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, label int"
    )
    # pairs won: 0.35>0.1, 0.8 twice, 0.4>0.1, 0.4=0.4 half
    assert shift.auc(rows).first()["auc"] == pytest.approx(4.5 / 6, abs=1e-6)


def test_folds_are_stratified(spark):
    rows = spark.range(103).select(
        F.col("id").cast("string"), (F.col("id") % 4 == 0).cast("int").alias("domain")
    )
    sizes = shift.folds(rows).groupBy("domain", "fold").count().collect()
    for domain in (0, 1):
        counts = [r["count"] for r in sizes if r["domain"] == domain]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_shift_verdict(spark):
    def verdict(aucs):
        scores = spark.createDataFrame(list(enumerate(aucs)), "fold int, auc double")
        return shift.verdict(scores).first()["shift"]

    assert [verdict([x, x]) for x in (0.76, 0.75, 0.6, 0.59)] == [
        "strong", "moderate", "moderate", "none",
    ]


def test_telling_features_find_the_separating_words(spark):
    rows = spark.range(40).select(
        F.col("id").cast("string"),
        (F.col("id") % 2).cast("int").alias("domain"),
        F.concat_ws(" ", F.lit("common"), F.when(F.col("id") % 2 == 0, "apple").otherwise("pear")).alias("text"),
    )
    got = {r["term"]: r["side"] for r in shift.telling_features(rows, 1).collect()}
    assert set(got.values()) == {"test", "train"}
    assert all(("pear" in t) == (side == "test") for t, side in got.items())


def test_losses(spark):
    pairs = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0], 0), ([1.0, 0.0], [0.0, 1.0], 1)],
        "left array<double>, right array<double>, label int",
    )
    assert losses.contrastive(pairs).first()["loss"] == pytest.approx((0.125 + 0.5) / 2)
    scored = spark.createDataFrame([(0.0, 1), (2.0, 0)], "score double, label int")
    expected = (np.log(2) + np.log1p(np.exp(2.0))) / 2
    assert losses.binary_cross_entropy(scored).first()["loss"] == pytest.approx(expected, abs=1e-6)


def test_csv_tells_empty_from_null(spark):
    rows = [("a", "", None), ("b", None, ""), ("c", " x ", "\\N"), ("d", '"', ",")]
    df = spark.createDataFrame(rows, "docno string, title string, text string")
    path = fresh_path(spark, "csv-empty")
    files.write_csv(df, path)
    back = files.read_csv(spark, path, schemas.CORPUS)
    assert sorted(map(tuple, back.collect())) == rows


def test_runs_with_missing_scores_come_back(spark):
    rows = [("s", "q", "d1", 1, 0.5), ("s", "q", "d2", 2, None), ("s", "q", "d3", 3, -1.5)]
    runs = spark.createDataFrame(rows, schemas.RUN)
    path = fresh_path(spark, "runs-null")
    files.write_runs(runs, path)
    assert sorted(map(tuple, files.read_runs(spark, path).collect())) == rows


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from rankbench.session import shared_folder

    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: None),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
        )

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))


def test_percentile_with_an_outlier(spark):
    """One huge value must not gather the others in one place; groups keep apart."""
    values = {"a": [*range(5000), 10**12], "b": [3.0, 1.0, 1.0]}
    rows = spark.createDataFrame(
        [(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double"
    )
    got = {r["g"]: r["x"] for r in quantiles.exact_percentile(rows, ["g"], "v", 0.95, "x").collect()}
    assert got == {g: pytest.approx(np.percentile(vs, 95)) for g, vs in values.items()}


def test_postings_are_not_shuffled_for_the_judgments(spark, sf_dir, monkeypatch):
    """The items' rarest words go to the postings, not the postings to the words."""
    from rankbench.plans import views
    from rankbench.plans.collections import collection

    index, plans = collection(spark, sf_dir, "bench").index, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    monkeypatch.setattr(views, "checkpointed", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = views.bench_qrels(spark, sf_dir, index).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found > 0
    assert "BroadcastHashJoin [term" in plans[-1] and "SortMergeJoin [term" not in plans[-1]


def test_run_paths_are_searched_for_a_file_name_only_where_there_may_be_one(spark, tmp_path):
    """The search tries every place of the path, for every line of a run."""
    from rankbench.sources import files

    line = "q1 Q0 d1 1 2.5 x\n"
    for name in ("system=a/part-0.txt", "b.trec", "c.trec/part-0", "system=d.trecs/part-0", "e.trec/system=f/part-0"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(line)
    runs = files.read_runs(spark, str(tmp_path))
    assert sorted(r["system"] for r in runs.collect()) == ["a", "b", "c", "d.trecs", "e"]
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "WHEN Contains(" in plan
