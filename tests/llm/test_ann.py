"""Nearest neighbours against brute force: exact when all leaves open, recall otherwise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench.llm import ann
from rankbench.llm.queries import QUERIES


def brute(rows, asks, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows])
    out = {}
    for q in sorted({i for i in ids.tolist() if asks(i)}):
        scores = points @ points[list(ids).index(q)]
        order = [o for o in np.lexsort((ids, -np.round(scores, 9))) if ids[o] != q][:k]
        out[q] = [(int(ids[o]), scores[o]) for o in order]
    return out


def as_lists(found):
    out = {}
    for r in found:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(v, s) for _, v, s in rows] for q, rows in out.items()}


def planted(n=700, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, dim)) * rng.uniform(0.3, 3, (n, 1))
    vectors[100:180] = vectors[5]  # copies, more than a list holds
    vectors[200:230] = vectors[5] + rng.standard_normal((30, dim)) * 1e-3
    return [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("cells, block", [(8192, 4096), (30, 10)])
def test_all_leaves_open_is_exact(spark, cells, block):
    rows = planted()
    dirty = [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [None] * 12), (9020, [1.0]), (None, rows[3][1]), rows[7], rows[40]]
    table = spark.createDataFrame(rows + dirty, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    found = ann.search(
        table, F.col("vec_id") % 20 == 0, nearest=10, trees=3, leaf=16, opened=99.0,
        cell_rows=cells, query_block=block,
    ).collect()
    expected = brute(rows, lambda i: i % 20 == 0, 10)
    got = as_lists(found)
    assert got.keys() == expected.keys()
    for q in got:
        assert [v for v, _ in got[q]] == [v for v, _ in expected[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=1e-12)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = as_lists(ann.search(table, F.col("vec_id") % 20 == 0).collect())
    assert got == {0: [(20, 0.5), (3, 0.0)], 20: [(0, 0.5), (3, 0.5)]}
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_trees_send_sample_points_to_balanced_leaves():
    points = np.random.default_rng(1).standard_normal((1000, 8))
    tree = ann.grow(points, 50, 4, 3)
    sizes = np.bincount(tree.leaf_of(points), minlength=tree.leaves)
    assert sizes.sum() == 1000 and sizes.max() <= 50 and sizes.min() >= 25
    same = ann.grow(np.ones((300, 4)), 50, 4, 3)
    assert same.leaves == 1


def test_recall_on_the_table(spark, sf_dir):
    found = as_lists(QUERIES["op3_nearest_vectors"](spark, sf_dir).collect())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute(rows, lambda i: i % 20 == 0, 20)
    assert found.keys() == expected.keys()
    hits = [len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) / len(expected[q]) for q in expected]
    assert all(len(found[q]) == len(expected[q]) for q in expected)
    assert np.mean(hits) >= 0.9
