"""Scores for (query, text) pairs: fixed weights, a trained model, or a user's function."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rankbench.functions import text as tx
from rankbench.operators import logistic
from rankbench.operators.exhaustive import SLACK, exhaustive_top_k
from rankbench.operators.ranking import TOPK, rounded
from rankbench.operators.term_blocks import ByTerm, TermScorer, by_term

# Weights of the built-in scorer: fixed values.
BIAS = -2.0
WEIGHTS = {"jaccard": 6.0, "coverage": 3.0, "length_ratio": 0.5}

BATCH = 32


def with_pair_features(pairs: DataFrame) -> DataFrame:
    """Word overlap features of the columns ``query`` and ``text``.

    jaccard: shared over all distinct words; coverage: shared over the query's
    distinct words; length_ratio: shorter over longer word count.
    """
    counted = (
        pairs.withColumn("_qw", tx.words(F.col("query")))
        .withColumn("_dw", tx.words(F.col("text")))
        .withColumn("_qs", F.array_distinct("_qw"))
        .withColumn("_ds", F.array_distinct("_dw"))
        .withColumn("_shared", F.size(F.array_intersect("_qs", "_ds")))
    )
    union = F.size("_qs") + F.size("_ds") - F.col("_shared")
    longer = F.greatest(F.size("_qw"), F.size("_dw"))
    shorter = F.least(F.size("_qw"), F.size("_dw"))
    return counted.withColumns(
        {
            "jaccard": _ratio(F.col("_shared"), union),
            "coverage": _ratio(F.col("_shared"), F.size("_qs")),
            "length_ratio": _ratio(shorter, longer),
        }
    ).drop("_qw", "_dw", "_qs", "_ds", "_shared")


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def fixed_weight_logit() -> Column:
    total = F.lit(BIAS)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def fixed_weight_score() -> Column:
    """Logistic score over the pair features."""
    return 1 / (1 + F.exp(-fixed_weight_logit()))


def score_pairs(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pairs`` with a ``score`` column; the built-in scorer by default."""
    if scorer is not None:
        return scorer(pairs)
    return (
        with_pair_features(pairs)
        .withColumn("score", rounded(fixed_weight_score()))
        .drop(*WEIGHTS)
    )


def batch_scorer(
    load_model: Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]],
    batch: int = BATCH,
) -> Callable[[DataFrame], DataFrame]:
    """Scorer around a user's model, ``batch`` pairs at a time.

    ``load_model`` runs once for each Python worker, not for each task.
    """

    def make():
        model = load_model()

        def scores(query: np.ndarray, text: np.ndarray) -> np.ndarray:
            return np.asarray(model(pd.Series(query), pd.Series(text)), dtype="float64")

        return scores

    predict = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch)
    return lambda pairs: pairs.withColumn(
        "score", rounded(predict(F.col("query"), F.col("text")))
    )


def words_by_term(docs: pd.DataFrame) -> ByTerm:
    """Documents by word, with their word counts."""
    found = by_term(docs, "words", None)
    found.figures = {
        "size": docs["words"].map(len).to_numpy(dtype="float64"),
        "len": docs["n_words"].to_numpy(dtype="float64"),
    }
    return found


class OverlapScorer(TermScorer):
    """Scores with the fixed weights, from distinct words and word counts."""

    only_numbers = False

    def __init__(self, queries: pd.DataFrame):
        super().__init__(queries, "words", None)
        self.size = queries["words"].map(len).to_numpy(dtype="float64")
        self.len = queries["n_words"].to_numpy(dtype="float64")

    def turned(self, docs: pd.DataFrame) -> ByTerm:
        return words_by_term(docs)

    def _logits(self, shared, docs: ByTerm, row, column) -> np.ndarray:
        def ratio(part, whole):
            return part / np.maximum(whole, 1)  # the part of nothing is 0

        kind = shared.dtype
        q_size, q_len = self.size[row].astype(kind), self.len[row].astype(kind)
        d_size, d_len = (docs.figures[name][column].astype(kind) for name in ("size", "len"))
        total = ratio(np.minimum(q_len, d_len), np.maximum(q_len, d_len))
        total *= kind.type(WEIGHTS["length_ratio"])
        total += kind.type(BIAS)
        total += kind.type(WEIGHTS["jaccard"]) * ratio(shared, q_size + d_size - shared)
        total += shared * (kind.type(WEIGHTS["coverage"]) / np.maximum(q_size, 1))
        return total

    def __call__(self, docs) -> np.ndarray:
        met = self.meet(docs)
        every = np.arange(len(docs))[None, :]
        out = np.empty((self.n_queries, len(docs)))
        for tile in self.tiles:
            rows = np.arange(tile.first, tile.first + tile.size)
            shared = tile.sums(met, "float32", True).astype("float64")  # whole numbers
            logits = self._logits(shared, met.docs, rows[:, None], every)
            out[rows] = 1 / (1 + np.exp(-logits))
        return out

    def prunes(self, bars: np.ndarray) -> np.ndarray:
        return bars > SLACK

    def reaching(self, docs, bars: np.ndarray):
        met = self.meet(docs)
        every = np.arange(len(docs))[None, :]
        some = bars < 1
        asked = np.where(some, bars, 0.5)
        # logits are below 10, so 32 bits hold them to within 1e-5
        logits = np.where(some, np.log(asked / (1 - asked)) - 1e-4, np.inf)
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for tile in self.tiles:
            rows = np.arange(tile.first, tile.first + tile.size)
            if not some[rows].any():
                continue
            shared = tile.sums(met, "float32", True)
            near = self._logits(shared, met.docs, rows[:, None], every)
            pair = np.flatnonzero((near >= logits[rows, None].astype("float32")).reshape(-1))
            row, column = pair // len(docs), pair % len(docs)
            exact = self._logits(shared[row, column].astype("float64"), met.docs, rows[row], column)
            found.append((rows[row], column, 1 / (1 + np.exp(-exact))))
        return tuple(np.concatenate(part) for part in zip(*found))


def overlap_scorer():
    """Block scorer with the fixed weights."""
    return OverlapScorer


def retrieve_pairs(topics: DataFrame, corpus: DataFrame, k: int = TOPK, **options) -> DataFrame:
    """Top ``k`` per query by the built-in pair scorer over every document.

    Words are cut in the JVM; a task sees distinct words, never pairs of texts.
    """

    def prepared(df: DataFrame, key: str, column: str) -> DataFrame:
        found = df.select(key, tx.words(F.col(column)).alias("_all"))
        return found.select(
            key, F.array_distinct("_all").alias("words"), F.size("_all").alias("n_words")
        )

    return exhaustive_top_k(
        prepared(topics, "qid", "query"), prepared(corpus, "docno", "text"),
        overlap_scorer, k, prepare=words_by_term, **options,
    )


def retrieve_pairs_with(
    topics: DataFrame,
    corpus: DataFrame,
    load_model: Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]],
    k: int = TOPK,
    batch: int = BATCH,
    **options,
) -> DataFrame:
    """Top ``k`` per query by a user's pair model over every document.

    ``load_model`` runs once per task, and the tasks are few.
    """

    def scorer():
        model = load_model()

        def for_queries(queries: pd.DataFrame):
            def score(docs: pd.DataFrame) -> np.ndarray:
                out = np.empty((len(queries), len(docs)))
                for i, query in enumerate(queries["query"]):
                    for start in range(0, len(docs), batch):
                        texts = docs["text"].iloc[start : start + batch].reset_index(drop=True)
                        asked = pd.Series([query] * len(texts))
                        out[i, start : start + len(texts)] = model(asked, texts)
                return out

            return score

        return for_queries

    return exhaustive_top_k(
        topics.select("qid", "query"), corpus.select("docno", "text"), scorer, k,
        **{"tasks_per_core": 1, **options},
    )


def train_pair_scorer(
    features: DataFrame, columns: list[str], regularization: float = logistic.RIDGE
) -> logistic.LogisticModel:
    """Logistic model on labelled pair features, at its optimum.  Fits a model.

    :func:`apply_pair_model` gives its probabilities.
    """
    return logistic.fit(features, columns, "label", regularization)


def apply_pair_model(model: logistic.LogisticModel, features: DataFrame) -> DataFrame:
    return logistic.apply(model, features)
