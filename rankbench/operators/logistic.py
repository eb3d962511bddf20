"""Logistic models of a few features by Newton steps, down to the optimum.

The loss is the mean cross-entropy plus a ridge on the weights of the features
brought to deviation one, the intercept left free.  That is strictly convex, so
its one optimum is the model whatever way leads there, and a gradient near zero
proves it.  Each step is one aggregation: the gradient and the curvature are a
few dozen means over the rows, all in the JVM, and only they reach the driver.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.functions.vectors import dot
from rankbench.operators.ranking import rounded

RIDGE = 0.01
STEPS = 50
# No entry of the gradient is larger at the end.
GRADIENT = 1e-11
# Features that one aggregation takes: the curvature has the square of it.
MOST_FEATURES = 64


@dataclass(frozen=True)
class LogisticModel:
    """Weights of the columns as they stand, and the gradient that was left."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    gradient: float
    steps: int

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for name, weight in zip(self.columns, self.weights):
            total = total + F.lit(weight) * F.col(name)
        return total


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def fit(
    features: DataFrame, columns: Sequence[str], label: str = "label", ridge: float = RIDGE
) -> LogisticModel:
    """The optimum on rows (columns..., label 0 or 1), materialised ones best.

    A column that never varies gets weight zero.  Runs a job for the deviations
    and one for each step; raises a ValueError without rows of both labels, or
    where the gradient does not come down to ``GRADIENT``.
    """
    if len(columns) > MOST_FEATURES:
        raise ValueError(f"{len(columns)} features are more than {MOST_FEATURES}")
    rows = features.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y"))
    spread = rows.agg(F.avg("_y").alias("_y"), *[F.stddev_samp(c).alias(c) for c in columns]).first()
    if spread["_y"] is None or not 0 < spread["_y"] < 1:
        raise ValueError("a fit needs rows of both labels")
    live = [c for c in columns if spread[c]]
    scaled = rows.select("_y", *[(F.col(c) / spread[c]).alias(f"_z{i}") for i, c in enumerate(live, 1)])
    scaled = scaled.withColumn("_z0", F.lit(1.0))
    n = len(live) + 1
    penalty = np.array([0.0] + [ridge] * len(live))

    def measured(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, gradient, curvature) at ``u``."""
        # weights as one array, so that every step runs the code of the first
        logit = dot(F.array(*[f"_z{i}" for i in range(n)]), F.lit([float(w) for w in u]))
        judged = scaled.withColumn("_s", logit).withColumn("_p", probability(F.col("_s")))
        off, bend = F.col("_p") - F.col("_y"), F.col("_p") * (1 - F.col("_p"))
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        cross = F.greatest("_s", F.lit(0.0)) - F.col("_s") * F.col("_y") + F.log1p(F.exp(-F.abs("_s")))
        found = judged.agg(
            F.avg(cross),
            *[F.avg(off * F.col(f"_z{i}")) for i in range(n)],
            *[F.avg(bend * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs],
        ).first()
        curvature = np.diag(penalty)
        for (i, j), v in zip(pairs, found[n + 1 :]):
            curvature[i, j] += v
            if i != j:
                curvature[j, i] += v
        return found[0] + float(penalty @ (u * u)) / 2, np.array(found[1 : n + 1]) + penalty * u, curvature

    u = np.zeros(n)
    loss, gradient, curvature = measured(u)
    for steps in range(STEPS):
        if np.abs(gradient).max() <= GRADIENT:
            break
        step, share = np.linalg.solve(curvature, gradient), 1.0
        tried = measured(u - step)
        while tried[0] > loss + 1e-12 and share > 1e-6:  # a full step can overshoot
            share /= 2
            tried = measured(u - share * step)
        u, (loss, gradient, curvature) = u - share * step, tried
    left = float(np.abs(gradient).max())
    if left > GRADIENT:
        raise ValueError(f"no optimum after {STEPS} steps, gradient {left}")
    weight = dict(zip(live, u[1:]))
    return LogisticModel(
        tuple(columns),
        tuple(float(weight[c] / spread[c]) if c in weight else 0.0 for c in columns),
        float(u[0]),
        left,
        steps,
    )


def apply(model: LogisticModel, features: DataFrame) -> DataFrame:
    """``features`` with ``score``, the probability of label 1."""
    return features.withColumn("score", rounded(probability(model.logit())))
