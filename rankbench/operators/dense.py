"""Vectors: the built-in encoder, the vector index and exact cosine retrieval."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rankbench.functions import text as tx
from rankbench.functions.hashing import sign, slot
from rankbench.functions.vectors import cosine, unit
from rankbench.operators.exhaustive import BarScorer, exhaustive_top_k
from rankbench.operators.joins import fetch, hot_keys, lookup_join
from rankbench.operators.lexicon_index import LexicalIndex
from rankbench.operators.ranking import TOPK, rounded

DIM = 64
# Terms with 1/COMMON_SHARE of all postings or more, so at most COMMON_SHARE of them,
# get their weight from a broadcast; the postings of rarer ones are shuffled by term.
COMMON_SHARE = 1 << 17

Encoder = Callable[[DataFrame], DataFrame]


def hashed_vectors(
    term_counts: DataFrame, index: LexicalIndex, key: str, dim: int = DIM
) -> DataFrame:
    """Signed feature hashing of (key, term, tf) rows: key and raw vector.

    Weight of a term: (1 + ln tf) * ln((N + 1) / (df + 1)).  Rows are summed by
    (key, slot) before they are gathered, so a gathered group has at most
    ``dim`` rows.
    """
    n_docs = index.stats.select("n_docs").scalar()
    weight = (1 + F.ln("tf")) * F.ln((n_docs + 1) / (F.col("df") + 1))
    weighed = lookup_join(
        term_counts, index.lexicon.select("term", "df"), "term",
        hot_keys(index.lexicon, "term", "df", COMMON_SHARE),
    )
    slots = weighed.groupBy(key, slot(F.col("term"), dim).alias("slot")).agg(
        F.sum(sign(F.col("term")) * weight).alias("x")
    )
    return gathered(slots, key, dim)


def gathered(slots: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """(key, slot, x) rows as one dense array per key."""
    pairs = slots.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("entries")
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.element_at("entries", i), F.lit(0.0)),
    )
    return pairs.select(key, filled.alias("embedding"))


def encode_documents(
    index: LexicalIndex, dim: int = DIM, normalize: bool = True
) -> DataFrame:
    """Vectors of all indexed documents, from their postings; empty ones are zero."""
    found = hashed_vectors(index.postings.select("docno", "term", "tf"), index, "docno", dim)
    return _finished(index.doclen.select("docno"), found, "docno", dim, normalize)


def encode_texts(
    texts: DataFrame,
    index: LexicalIndex,
    key: str = "qid",
    column: str = "query",
    dim: int = DIM,
    normalize: bool = True,
) -> DataFrame:
    """Vectors of any texts (queries, pair sides) with the index's term weights.

    Terms the index doesn't know have no weight.
    """
    counts = (
        texts.select(key, F.explode(tx.terms(F.col(column), index.n_max)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    found = hashed_vectors(counts, index, key, dim)
    return _finished(texts.select(key), found, key, dim, normalize)


def _finished(keys, found, key, dim, normalize):
    zero = F.array_repeat(F.lit(0.0), dim)
    whole = keys.join(found, key, "left").withColumn(
        "embedding", F.coalesce("embedding", zero)
    )
    return normalized(whole) if normalize else whole


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", unit(F.col("embedding")))


def encode_with(
    texts: DataFrame,
    load_model: Callable[[], Callable[[pd.Series], np.ndarray]],
    key: str,
    column: str,
    batch: int = 16,
    normalize: bool = True,
) -> DataFrame:
    """Vectors from a user's model, ``batch`` texts at a time.

    ``load_model`` runs once for each Python worker, not for each task, and
    returns a function from a series of texts to a matrix.
    """

    def make():
        model = load_model()
        return lambda column: np.asarray(model(pd.Series(column)), dtype="float64")

    encode = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
    encoded = texts.select(key, encode(F.col(column)).alias("embedding"))
    return normalized(encoded) if normalize else encoded


def write_vectors(vectors: DataFrame, location: str) -> DataFrame:
    """Vector index: docno and unit vector as Parquet, replacing what is there."""
    normalized(vectors.select("docno", "embedding")).select(
        "docno", F.col("embedding").cast("array<float>").alias("embedding")
    ).write.mode("overwrite").parquet(location)
    return open_vectors(vectors.sparkSession, location)


def open_vectors(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.parquet(location)


class UnitVectors:
    """Vectors of length 1 as one matrix."""

    def __init__(self, frame: pd.DataFrame):
        matrix = np.stack(frame["embedding"].to_numpy()).astype("float64")
        size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        self.rows = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
        self.docno = frame["docno"].to_numpy(dtype=object) if "docno" in frame else None

    def __len__(self) -> int:
        return len(self.rows)


class CosineScorer(BarScorer):
    """Cosines; 32-bit ones tell which pairs need 64 bits."""

    def __init__(self, queries: pd.DataFrame):
        self.left = UnitVectors(queries).rows
        self.short = self.left.astype("float32")
        # of a sum of products of unit vectors
        self.error = (self.left.shape[1] + 4) * 2.0**-22

    def _meet(self, docs) -> np.ndarray:
        return (UnitVectors(docs) if isinstance(docs, pd.DataFrame) else docs).rows

    def __call__(self, docs) -> np.ndarray:
        return self.left @ self._meet(docs).T

    def prunes(self, bars: np.ndarray) -> np.ndarray:
        return bars > -np.inf

    def reaching(self, docs, bars: np.ndarray):
        rows = self._meet(docs)
        near = self.short @ rows.astype("float32").T >= (bars - self.error)[:, None].astype("float32")
        pair = np.flatnonzero(near.reshape(-1))
        row, column = pair // len(rows), pair % len(rows)
        return row, column, np.einsum("ij,ij->i", self.left[row], rows[column])


def cosine_scorer():
    """Block scorer of cosines; the queries' side is made once."""
    return CosineScorer


def retrieve_dense(
    topics: DataFrame, vectors: DataFrame, k: int = TOPK, **options
) -> DataFrame:
    """Exact cosine top ``k`` of query vectors over all document vectors."""
    return exhaustive_top_k(
        topics.select("qid", "embedding"),
        vectors.select("docno", "embedding"),
        cosine_scorer,
        k,
        prepare=UnitVectors,
        **options,
    )


def rescore_dense(run: DataFrame, topic_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine scores for the rows of a run; a missing vector scores null."""
    queries = topic_vectors.select("qid", F.col("embedding").alias("_query"))
    docs = vectors.select("docno", F.col("embedding").alias("_doc"))
    return (
        fetch(run, docs, "left")
        .join(queries, "qid", "left")
        .withColumn("score", rounded(cosine(F.col("_query"), F.col("_doc"))))
        .drop("_query", "_doc")
    )
