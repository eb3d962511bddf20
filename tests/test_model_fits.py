"""Fitted models against NumPy: few features at the optimum, texts near it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankbench.operators import logistic, shift


def optimum(x, y, ridge):
    """Intercept and weights by Newton steps on dense rows; ``ridge`` is one for each weight."""
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.concatenate([[0.0], ridge])
    u = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ u))
        gradient = z.T @ (p - y) / len(y) + penalty * u
        if np.abs(gradient).max() < 1e-14:
            break
        curvature = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty)
        u = u - np.linalg.solve(curvature + 1e-15 * np.eye(len(u)), gradient)
    return u[0], u[1:]


@pytest.mark.parametrize("case", ["mixed", "apart", "scales"])
def test_few_features_against_numpy(spark, case):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] + draw.normal(size=400) > 0.3).astype(float)
    if case == "apart":
        y = (x[:, 0] > 0).astype(float)
    if case == "scales":
        x *= [1e6, 1e-6, 3.0]
    rows = [(*map(float, r), 5.0, int(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, label int")
    model = logistic.fit(df, ["a", "b", "c", "same"])
    spread = x.std(axis=0, ddof=1)
    intercept, weights = optimum(x / spread, y, np.full(3, logistic.RIDGE))
    assert model.gradient <= logistic.GRADIENT and model.steps < 20
    assert model.intercept == pytest.approx(intercept, abs=1e-8)
    assert np.allclose(model.weights[:3], weights / spread, rtol=1e-8)
    assert model.weights[3] == 0.0
    scores = [r["score"] for r in logistic.apply(model, df).collect()]
    expected = 1 / (1 + np.exp(-(intercept + x @ (weights / spread))))
    assert np.abs(np.array(scores) - expected).max() < 1e-6


def test_fits_that_have_no_optimum(spark):
    for rows in ([], [(1.0, 1)], [(1.0, 0), (2.0, 0)]):
        with pytest.raises(ValueError):
            logistic.fit(spark.createDataFrame(rows, "a double, label int"), ["a"])
    with pytest.raises(ValueError):
        logistic.fit(spark.range(1), [str(k) for k in range(100)])


@pytest.fixture(scope="module")
def shifted(spark):
    draw = np.random.default_rng(8)
    rows = []
    for k in range(90):
        words = list(draw.choice([f"w{i}" for i in range(12)], size=8))
        words += ["old"] * int(draw.random() < 0.5) if k % 3 else ["new"] * int(draw.random() < 0.7)
        rows.append((f"t{k}", " ".join(words), int(k % 3 == 0)))
    return spark.createDataFrame(rows, "id string, text string, domain int")


def dense(vectors):
    rows = sorted(vectors.collect(), key=lambda r: r["id"])
    x = np.stack([r["features"].toArray() for r in rows])
    return [r["id"] for r in rows], x, np.array([r["domain"] for r in rows])


def rank_auc(scores, y):
    wins = [(a > b) + (a == b) / 2 for a in scores[y == 1] for b in scores[y == 0]]
    return sum(wins) / len(wins)


def test_text_model_tells_what_numpy_tells(shifted):
    vectors, terms, total = shift._prepared(shifted)
    _, x, y = dense(vectors)
    _, weights = optimum(x, y, np.full(x.shape[1], 1 / total))
    told = {r["term"]: r for r in shift.telling_features(shifted).collect()}
    order = sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))
    assert told[terms[order[0]]]["side"] == "test" and terms[order[0]] == "new"
    for t, r in told.items():
        assert (r["coefficient"] > 0) == (weights[terms.index(t)] > 0)


def test_cross_validation_against_numpy(shifted):
    vectors, _, _ = shift._prepared(shifted)
    ids, x, y = dense(vectors)
    fold_of = {r["id"]: r["fold"] for r in shift.folds(shifted.select("id", "domain")).collect()}
    fold = np.array([fold_of[i] for i in ids])
    scores = []
    for k in range(shift.FOLDS):
        train = fold != k
        b, u = optimum(x[train], y[train], np.full(x.shape[1], 1 / train.sum()))
        scores.append(rank_auc(x[~train] @ u + b, y[~train]))
    found = shift.cross_validated(shifted).first()
    assert found["auc"] == pytest.approx(np.mean(scores), abs=0.01)
    assert found["deviation"] == pytest.approx(np.std(scores), abs=0.01)
    assert found["shift"] == "strong"


def test_texts_are_not_read_again_for_their_frequencies(spark, shifted):
    """The vocabulary has them; only the vectors ask for the texts once more."""
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(value):
        read.add(1)
        return value

    vectors, terms, total = shift._prepared(shifted.withColumn("text", text("text")))
    assert (total, read.value) == (90, 90)
    row = vectors.where("id = 't0'").first()
    counts = {}
    words = shifted.where("id = 't0'").first()["text"].split()
    for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        counts[term] = counts.get(term, 0) + 1
    df = {r["term"]: r["df"] for r in shift.vocabulary(shifted).collect()}
    want = np.array([counts.get(t, 0) * (np.log(91 / (1 + df[t])) + 1) for t in terms])
    assert np.allclose(row["features"].toArray(), want / np.linalg.norm(want))


def test_partial_sums_meet_before_the_driver():
    assert shift.learner(10).getAggregationDepth() >= 4
