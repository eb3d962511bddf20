"""Vector near-dedup against brute force."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench.llm import vector_dedup
from rankbench.llm.queries import ORACLES, QUERIES


def slow(rows, cosine=0.95):
    good = [
        (i, np.array(v, float))
        for i, v in rows
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    place = {k: i for k, (i, _) in enumerate(good)}
    links = {k: set() for k in place}
    for a, (_, x) in enumerate(good):
        for b, (_, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a].add(b)
    best = {k: place[k] for k in place}
    changed = True
    while changed:
        changed = False
        for a in links:
            for b in links[a]:
                if best[b] < best[a]:
                    best[a], changed = best[b], True
    out = sorted((place[k], len(links[k]), best[k], place[k] == best[k]) for k in place)
    used = [i for i, _ in good]
    for i, _ in rows:
        if i in used:
            used.remove(i)
        else:
            out.append((i, 0, i, i is not None))
    return sorted(out, key=str)


def planted():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(80):
        center = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append(center * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.05)
    chain = rng.standard_normal(16)
    for _ in range(30):  # linked in a row, the ends far apart
        chain = chain + rng.standard_normal(16) * 0.2
        rows.append(chain)
    hot = rng.standard_normal(16)
    rows += [hot + rng.standard_normal(16) * 0.1 for _ in range(150)]
    rows += [rows[3]] * 40
    rng.shuffle(rows)
    rows = [list(map(float, r)) for r in rows]
    rows += [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    return list(enumerate(rows, start=10))


@pytest.mark.parametrize("block", [1024, 20])
def test_planted(spark, block):
    rows = planted()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = vector_dedup.near_duplicates(table.withColumn("root", F.lit(1)), block=block).collect()
    assert sorted((tuple(r) for r in found), key=str) == slow(rows)


def crowd(rows, pairs, cone, dim=64, seed=5):
    """Unit vectors, two thirds of them at ``cone`` to each other; planted pairs inside at 0.95-0.97."""
    rng = np.random.default_rng(seed)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    axis = unit(rng.standard_normal(dim))
    side = rng.standard_normal((2 * rows // 3, dim))
    side = unit(side - np.outer(side @ axis, axis))
    hot = np.sqrt(cone) * axis + np.sqrt(1 - cone) * side
    first = hot[:pairs]
    away = rng.standard_normal((pairs, dim))
    away = unit(away - np.sum(away * first, axis=1, keepdims=True) * first)
    near = rng.uniform(0.951, 0.97, (pairs, 1))
    second = near * first + np.sqrt(1 - near**2) * away
    return np.concatenate([hot, second, unit(rng.standard_normal((rows // 3, dim)))])


def test_links_inside_a_dense_group(spark):
    vectors = crowd(6000, 200, 0.85)
    near = vectors @ vectors.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() >= 400
    table = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"
    ).repartition(4)
    found = vector_dedup.near_duplicates(table).select("vec_id", "n_links").collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(near.sum(axis=1).tolist()))


def test_runs_follow_the_number_of_vectors():
    # a small table is no single run either
    for vectors in (1, 500, 1024):
        bits, passes = vector_dedup.run_passes(vectors, 0.95, 1024)
        assert bits == vector_dedup.LEAST_BITS > 0 and passes > 1
    for vectors in (2_000, 51_000, 10**6, 10**9):
        bits, passes = vector_dedup.run_passes(vectors, 0.95, 1024)
        shared = (1 - np.arccos(0.95) / np.pi) ** bits
        assert vectors / 2**bits <= 1024 and (1 - shared) ** passes <= 1e-6


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [0.0, 1.0])]
    found = vector_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ).collect()
    assert sorted(map(tuple, found), key=str) == [
        (1, 2, 1, True), (1, 2, 1, True), (7, 0, 7, True), (None, 2, 1, False)
    ]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.near_duplicates(empty).collect() == []


def test_query_on_the_table(spark, sf_dir):
    rows = compare.spark_rows(QUERIES["op8_embedding_dedup"](spark, sf_dir))
    assert rows == compare.sql_rows(compare.connect(sf_dir), ORACLES["op8_embedding_dedup"])
