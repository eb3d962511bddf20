import math

import pytest

from rankbench.operators import evaluation as ev
from rankbench.operators.ranking import reranked, top_k

RUN = "system string, qid string, docno string, score double"
QRELS = "qid string, docno string, label int"


def values(spark, run, qrels, **options):
    rows = ev.evaluate(
        spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), **options
    ).collect()
    return {(r["system"], r["metric"]): r["value"] for r in rows}


def test_ties_go_to_the_lower_docno(spark):
    rows = spark.createDataFrame(
        [("q", "d2", 1.0), ("q", "d1", 1.0), ("q", "d3", 2.0), ("q", "d0", None)],
        "qid string, docno string, score double",
    )
    got = [(r["docno"], r["rank"]) for r in top_k(rows, 3).orderBy("rank").collect()]
    assert got == [("d3", 1), ("d1", 2), ("d2", 3)]
    assert {r["rank"] for r in top_k(rows, 2, rank_base=0).collect()} == {0, 1}
    assert reranked(rows).count() == 4


def test_top_k_cuts_before_the_shuffle(spark):
    rows = spark.range(100).selectExpr("concat('q', id % 3) qid", "string(id) docno", "double(id) score")
    plan = top_k(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ndcg(spark):
    run = [("s", "q", f"d{i}", float(-i)) for i in range(3)]
    got = values(spark, run, [("q", "d1", 1)], cutoffs=(1, 3), mrr=10)
    assert got["s", "nDCG@3"] == pytest.approx(1 / math.log2(3), abs=1e-6)
    assert got["s", "nDCG@1"] == 0 and got["s", "MRR@10"] == 0.5


def test_reciprocal_rank_stops_at_ten(spark):
    run = [("s", "q", f"d{i:02}", float(-i)) for i in range(12)]
    assert values(spark, run, [("q", "d10", 1)])["s", "MRR@10"] == 0


def test_recall(spark):
    run = [("s", "q", f"d{i}", float(-i)) for i in range(6)]
    qrels = [("q", "d0", 1), ("q", "d4", 2), ("q", "d5", 1), ("q", "d1", 0)]
    got = values(spark, run, qrels)
    assert got["s", "R@5"] == pytest.approx(2 / 3, abs=1e-6)
    assert got["s", "R@10"] == 1.0


def test_missing_queries_count_zero(spark):
    run = [("s", "q1", "d1", 1.0), ("t", "other", "d1", 1.0)]
    qrels = [("q1", "d1", 1), ("q2", "d1", 1)]
    got = values(spark, run, qrels)
    assert got["s", "nDCG@1"] == 0.5
    assert got["t", "nDCG@1"] == 0.0
    missing = ev.missing_queries(
        spark.createDataFrame(run, RUN).where("system = 's'"), spark.createDataFrame(qrels, QRELS)
    )
    assert [r["qid"] for r in missing.collect()] == ["q2"]
    per_query = ev.per_judged_query(
        spark.createDataFrame(run[:1], RUN), spark.createDataFrame(qrels, QRELS)
    )
    assert {r["qid"]: r["nDCG@1"] for r in per_query.collect()} == {"q1": 1.0, "q2": 0.0}


def test_graded_labels_use_the_ideal_of_all_judgments(spark):
    run = [("s", "q", "a", 2.0), ("s", "q", "b", 1.0)]
    got = values(spark, run, [("q", "a", 1), ("q", "b", 2)])
    ideal = 2 + 1 / math.log2(3)
    assert got["s", "nDCG@5"] == pytest.approx((1 + 2 / math.log2(3)) / ideal, abs=1e-6)


def test_files_of_one_run_or_of_a_folder(spark, tmp_path):
    from rankbench.operators import evaluation
    from rankbench.plans import steps
    from rankbench.sources import files

    runs = spark.createDataFrame(
        [(s, "q1", d, r, 9.0 - r) for s in ("a", "b") for r, d in enumerate(["x", "y"] if s == "a" else ["y", "x"], 1)],
        "system string, qid string, docno string, rank int, score double",
    )
    qrels = spark.createDataFrame([("q1", "0", "x", 1)], "qid string, iter string, docno string, label int")
    base, folder = str(tmp_path / "base"), str(tmp_path / "runs")
    files.write_runs(runs, folder)
    files.write_qrels(qrels, f"{base}/{steps.QRELS}")
    expected = {tuple(r) for r in evaluation.evaluate(runs, qrels).collect()}
    every = steps.evaluate_files(spark, base, run_dir=folder, output_dir=str(tmp_path / "all"))
    assert {tuple(r) for r in every.collect()} == expected
    one = steps.evaluate_files(
        spark, base, run_path=f"{folder}/system=b", output_path=str(tmp_path / "one")
    )
    assert {tuple(r) for r in one.collect()} == {r for r in expected if r[0] == "b"}
    for given in (
        {}, {"run_dir": folder}, {"run_path": folder}, {"output_dir": "o"},
        {"run_dir": folder, "output_path": "o"}, {"run_path": folder, "output_dir": "o"},
    ):
        with pytest.raises(ValueError):
            steps.evaluate_files(spark, base, **given)
