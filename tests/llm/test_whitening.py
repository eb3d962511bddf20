"""Whitening by shifted CholeskyQR against NumPy and exact whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench.llm import whitening
from rankbench.llm.queries import QUERIES


def whole(vectors):
    """Rows of whole numbers, shorter ones filled with zero entries; None where left out."""
    kept = [
        None if v is None or any(c is None or not math.isfinite(c) for c in v) else v for v in vectors
    ]
    dim = max((len(v) for v in kept if v is not None), default=0)
    return [
        None if v is None else [math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dim - len(v))]]
        for v in kept
    ]


def plain(rows):
    """(n, sums, eigenvalues, components) by NumPy on exactly centred entries."""
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(r, sums)] for r in rows])
    _, values, right = np.linalg.svd(centred, full_matrices=False)
    return n, sums, values**2 / n, right, centred


def check(spark, vectors, k=32, rank=None, parts=4):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    df = df.withColumn("id", F.lit("clash")).withColumn("v", F.lit(0)).repartition(parts)
    rows = whole(vectors)
    live = [r for r in rows if r is not None]
    model = whitening.fit(df)
    n, sums, values, right, centred = plain(live)
    assert (model.n, model.sums) == (n, sums)
    rank = rank if rank is not None else len(values)
    assert len(model.eigenvalues) == rank
    assert np.allclose(model.eigenvalues, values[:rank], rtol=1e-9, atol=0)
    assert model.total == pytest.approx(float((centred**2).sum() / n), rel=1e-12)
    assert np.abs(model.components @ model.components.T - np.eye(rank)).max() < 1e-12
    got = {r["vec_id"]: r for r in whitening.transform(df, model, k=k).collect()}
    assert sorted(got) == [i for i, r in enumerate(rows) if r is not None]
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for i, r in enumerate(rows) if r is not None}
    assert {i: int(r["deviation"]) for i, r in got.items()} == exact
    white = np.array([got[i]["whitened"] for i in sorted(got)])
    assert white.shape == (n, min(k, rank))
    cov = white.T @ white / n - np.outer(white.mean(0), white.mean(0))
    error = np.abs(cov - np.eye(white.shape[1])).max()
    assert error < 1e-6
    assert whitening.identity_error(df, model, k=k) == pytest.approx(error, abs=1e-9)
    # either sign is right, the same for all rows
    own = centred @ (model.components[: white.shape[1]] / np.sqrt(model.eigenvalues[: white.shape[1], None])).T
    assert np.allclose(white, own, rtol=1e-9, atol=1e-9)
    return model


def normal(n, dim, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_against_numpy(spark):
    check(spark, normal(500, 40).tolist(), k=32)


def test_badly_conditioned(spark):
    # directions from 1e7 down to what floor leaves, mixed by a rotation
    mix = np.linalg.qr(normal(12, 12, 1))[0]
    check(spark, (normal(400, 12, 2) * np.logspace(7, 0, 12) @ mix).tolist())


def test_entries_of_very_different_size(spark):
    check(spark, (normal(300, 5, 3) * [1e9, 1.0, 1e5, 0.05, 10]).tolist())


def test_dependent_and_constant_entries(spark):
    base = np.floor(normal(200, 4, 4) * 10)
    rows = np.column_stack([base, base[:, 0], base[:, 1] + base[:, 2], np.full(200, 7.0)])
    check(spark, rows.tolist(), rank=4)


def test_fewer_vectors_than_entries(spark):
    check(spark, normal(6, 10, 5).tolist(), rank=5)


def test_rows_that_take_no_part_and_short_ones(spark):
    rows = normal(60, 6, 6).tolist()
    rows += [None, [None] * 6, [1.0, float("nan"), 0.0], [float("inf")] * 6, [], [0.0] * 6, [2.0, 3.0]]
    rows += [[1.0] * 6] * 40
    check(spark, rows)


def test_exact_beyond_64_bits(spark):
    rows = [[1e15, 2.0, -1e15], [3e15, -2.0, 4.5], [-1e15, 7.25, 1e15], [5.0, 1e15, 2.0], [0.5] * 3]
    check(spark, rows, parts=2)


def test_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, [])]):
        assert whitening.fit(spark.createDataFrame(rows, schema)) is None


def test_entries_beyond_the_range(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], schema)
    model = whitening.fit(df)
    assert model.sums == [3 * whitening.OFFSET]
    assert whitening.transform(df, model).count() == 3


def test_triangular_solve():
    draw = np.random.default_rng(9)
    r = np.triu(draw.normal(size=(70, 70))) + 10 * np.eye(70)
    a = draw.normal(size=(50, 70))
    assert np.allclose(whitening.triangular(r, a) @ r, a, rtol=0, atol=1e-12)


def test_query(spark, sf_dir):
    found = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = whole([None if r["embedding"] is None else list(r["embedding"]) for r in table])
    live = {r["vec_id"]: x for r, x in zip(table, rows) if x is not None}
    n, sums, values, right, centred = plain(list(live.values()))
    got = found.toPandas()
    assert len(got) == n * min(32, len(values)) and set(got["n"]) == {n}
    assert got["identity_error"].max() < 1e-4 and got["identity_error"].nunique() == 1
    shares = got.groupby("component")["explained"].first().sort_index().to_numpy()
    assert np.allclose(shares, (values / values.sum())[:32], rtol=1e-9)
    exact = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in live.items()}
    assert got.groupby("vec_id")["deviation"].first().to_dict() == exact
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(live)].to_numpy()
    for k in range(white.shape[1]):
        other = centred @ right[k] / math.sqrt(values[k])
        assert min(np.abs(white[:, k] - other).max(), np.abs(white[:, k] + other).max()) < 1e-6
