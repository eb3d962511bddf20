"""Every registered query against its SQL on the same tables."""

import compare
import pytest

import __spark_entry__ as entry_point

from rankbench.plans.oracle import oracles
from rankbench.plans.queries import QUERIES

SQL = oracles()
ROWS_ONLY = {"diag_shift_auc", "diag_shift_features", "lm_subword_ids"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql_but_model_fits_and_tokenizer_files():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf_dir, tables):
    assert compare.spark_rows(QUERIES[name](spark, sf_dir)) == compare.sql_rows(tables, SQL[name])


def test_trained_pair_scorer_scores_every_pair(spark, sf_dir):
    rows = QUERIES["train_pair_scorer"](spark, sf_dir).collect()
    assert len(rows) == QUERIES["prep_pairs"](spark, sf_dir).count()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_query_is_registered():
    assert QUERIES.items() <= entry_point.queries().items()
    assert SQL.items() <= entry_point.oracle_sql().items()


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 7 and all(0 <= r["value"] <= 1 for r in rows)


def test_subword_blocks_are_the_tokenizers_ids(spark, sf_dir):
    """Blocks of the query, put together again, are the ids of the texts in order."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")

    from rankbench.operators import blocks

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string) docno", "text")
    placed = blocks.batched(docs).select("batch", "docno", "text").orderBy("batch", "docno").collect()
    streams = {}
    for r in placed:
        if r["text"] is not None:
            ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
            streams.setdefault(r["batch"], []).extend(ids)
    expected = {
        (batch, k): " ".join(map(str, ids[k * 512 : (k + 1) * 512]))
        for batch, ids in streams.items()
        for k in range(len(ids) // 512)
    }
    rows = QUERIES["lm_subword_ids"](spark, sf_dir).collect()
    assert {(r["batch"], r["block"]): r["input_ids"] for r in rows} == expected


def test_tokenizer_is_given_a_few_texts_at_a_time():
    import pyarrow as pa

    from rankbench.operators import blocks

    texts = ["a" * 7, "", "b" * 30, "ccc", "dd", ""]
    lists = list(blocks._few(pa.array(texts), 10))
    assert [t for few in lists for t in few] == texts
    assert all(len(few) == 1 or sum(map(len, few)) <= 10 for few in lists)
    assert list(blocks._few(pa.array([], pa.string()))) == []
