"""Pipeline stages: what they drop, keep and return."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_secrets import slow_base
from test_simhash import slow_components, slow_fingerprint

import corpus_pipeline as pipeline
from rankbench.llm import mixing, toxicity
from rankbench.llm.queries import toxicity_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def written(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    kept = written(pipeline.drop_toxic(spark, docs, sf_dir), tmp_path, "a")
    model = toxicity_model(docs, labels)
    scores = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores if r["s"] < 0.3}

    before = kept.collect()
    kept = written(pipeline.drop_near_duplicates(spark, kept, sf_dir), tmp_path, "b")
    best = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in before])
    assert kept.columns == columns
    assert sorted(kept.collect()) == sorted(r for r in before if best[r["doc_id"]] == r["doc_id"])

    before = {r["doc_id"]: r for r in kept.collect()}
    kept = written(pipeline.mask_secrets(spark, kept, sf_dir), tmp_path, "c")
    after = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == columns and before.keys() == after.keys()
    for i, row in after.items():
        assert slow_base(row["text"]) == ""
        if slow_base(before[i]["text"]):
            assert "[secret]" in row["text"] and row["n_chars"] == len(row["text"])

    taken = {r["doc_id"]: r for r in mixing.mix(kept).collect()}
    kept = written(pipeline.mix_sources(spark, kept, sf_dir), tmp_path, "d")
    copies = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == columns
    for i, r in taken.items():
        assert abs(copies[i] - (r["taken"] / r["size"] if r["size"] else 1)) < 1

    rows = pipeline.pack_sequences(spark, kept, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == copies
    once = [r for r in rows if copies[r["doc_id"]] == 1]
    texts = {r["doc_id"]: r["text"] for r in kept.collect() if copies[r["doc_id"]] == 1}
    ids = {r["doc_id"] for r in once}
    assert ids == set(texts)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2 == s and o2 == o + n) or (s2 != s and o2 == 0)


@pytest.mark.parametrize("rows", [[], [
    (1, None, None, None, None, 1), (1, None, None, None, None, 1), (2, "", "en", "s", 0, 2),
    (None, "token=abcdefgh here", None, "s", 19, 3), (None, "token=abcdefgh here", None, None, 19, 3),
    (4, "word " * 30_000, "en", "s", 150_000, None),
]])
def test_edges(spark, sf_dir, tmp_path, rows):
    docs = written(spark.createDataFrame(rows, SCHEMA), tmp_path, "in")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        columns = docs.columns
        docs = written(stage(spark, docs, sf_dir), tmp_path, f"s{k}")
        assert k == 4 or docs.columns == columns
    assert docs.count() == 0 if not rows else docs.count() >= 1


def test_columns_with_any_name(spark, sf_dir, tmp_path):
    """Names that the stages use themselves keep their values."""
    names = [
        "_id", "_fp", "fp", "node", "root", "_base", "_spans", "_candidates", "_score", "score", "id",
        "_copies", "copies", "_copy", "col", "row", "best", "n", "taken", "size", "a.b", "component_id",
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    own = F.col("doc_id").cast("string")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), own) for n in names})
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated ids
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs = written(docs, tmp_path, "in")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = written(stage(spark, docs, sf_dir), tmp_path, f"s{k}")
        assert docs.columns == columns
        for r in docs.where("doc_id is not null").collect():
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in names)
    assert docs.count() and pipeline.pack_sequences(spark, docs, sf_dir).count() >= docs.count()


def test_near_duplicates_fingerprint_a_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = pipeline.drop_near_duplicates(spark, docs, sf_dir)._jdf.queryExecution().executedPlan()
    assert "ArrowEvalPython" not in plan.toString()  # the one before it is checkpointed


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_packs_every_document_left(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["length"] <= 4096 for r in rows)
