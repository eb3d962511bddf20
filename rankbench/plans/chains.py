"""Retrieve-then-rerank chains.

The candidates of a first stage are few and used twice (to pick the documents
and to score them), so they are checkpointed between the stages.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.operators import dense, lexical, pairs
from rankbench.operators.joins import fetch
from rankbench.operators.lexicon_index import LexicalIndex
from rankbench.operators.ranking import TOPK, as_run, reranked
from rankbench.session import checkpointed

Step = Callable[[DataFrame], DataFrame]


def chain(start: DataFrame, *steps: Step) -> DataFrame:
    """Steps applied one after another."""
    return reduce(lambda df, step: df.transform(step), steps, start)


def keep_raw_query(topics: DataFrame, n_max: int = 1) -> DataFrame:
    """Tokenised query in ``query``, the raw one in ``query_raw``."""
    return topics.select(
        "qid",
        tx.joined(tx.terms(F.col("query"), n_max)).alias("query"),
        F.col("query").alias("query_raw"),
    )


def raw_query(topics: DataFrame) -> DataFrame:
    """The raw query back in ``query``."""
    return topics.select("qid", F.col("query_raw").alias("query"))


def with_query(topics: DataFrame) -> Step:
    """Puts the raw query text beside each run row."""
    return lambda run: run.join(topics.select("qid", "query"), "qid")


def with_index_text(index: LexicalIndex, source: str = "text_raw") -> Step:
    """Puts a stored text beside each run row."""
    return lambda run: fetch(run, index.docstore.select("docno", F.col(source).alias("text")))


def with_corpus_text(corpus: DataFrame) -> Step:
    """Puts the corpus text beside each run row; rows without one stay."""
    return lambda run: fetch(run, corpus.select("docno", "text"), "left")


def rerank_dense(topic_vectors: DataFrame, vectors: DataFrame) -> Step:
    """Orders candidates by cosine of the raw query's vector."""
    return lambda run: chain(
        run.select("qid", "docno"),
        lambda rows: dense.rescore_dense(rows, topic_vectors, vectors),
        reranked,
    ).select("qid", "docno", "score", "rank")


def rerank_pair(topics: DataFrame, texts: Step, scorer=None) -> Step:
    """Orders candidates by the pair scorer on the raw query and the text ``texts`` adds."""
    return lambda run: chain(
        run.select("qid", "docno"),
        texts,
        with_query(topics),
        lambda rows: pairs.score_pairs(rows, scorer),
        reranked,
    ).select("qid", "docno", "score", "rank")


def bm25_dense(topics, index, topic_vectors, vectors, k: int = TOPK, **options) -> DataFrame:
    """BM25 candidates, then cosine."""
    return chain(
        lexical.retrieve(topics, index, k=k, **options),
        checkpointed,
        rerank_dense(topic_vectors, vectors),
    )


def bm25_pair(
    topics, index, scorer=None, k: int = TOPK, text_source: str = "text_raw", **options
) -> DataFrame:
    """BM25 candidates, then the pair scorer on a stored text."""
    return chain(
        lexical.retrieve(topics, index, k=k, **options),
        checkpointed,
        rerank_pair(topics, with_index_text(index, text_source), scorer),
    )


def bm25_pair_pretokenised(
    topics, index, scorer=None, k: int = TOPK, text_source: str = "text_raw"
) -> DataFrame:
    """Tokenised queries to BM25, the raw ones beside them to the pair scorer."""
    both = keep_raw_query(topics, index.n_max)
    return chain(
        lexical.retrieve(both, index, k=k, pretokenised=True),
        checkpointed,
        rerank_pair(raw_query(both), with_index_text(index, text_source), scorer),
    )


def dense_pair(topics, corpus, topic_vectors, vectors, scorer=None, k: int = TOPK) -> DataFrame:
    """Cosine candidates, then the pair scorer on the corpus text."""
    return chain(
        dense.retrieve_dense(topic_vectors, vectors, k),
        checkpointed,
        rerank_pair(topics, with_corpus_text(corpus), scorer),
    )


def run_matrix(
    topics: DataFrame,
    corpus: DataFrame,
    index: LexicalIndex,
    bigram_index: LexicalIndex,
    topic_vectors: DataFrame,
    vectors: DataFrame,
    k: int = TOPK,
) -> DataFrame:
    """All systems over one topic set: system, qid, docno, rank, score.

    The postings of each index are matched once for all weightings over it.  The
    first-stage runs feed the rerankers too, so they are checkpointed.  Runs jobs.
    """
    weightings = {"bm25": lexical.bm25_weights(), "tfidf": lexical.tfidf_weights()}
    terms = checkpointed(lexical.retrieve_many(topics, index, weightings, k=k))
    bm25 = terms.where(F.col("system") == "bm25").drop("system")
    cosine = checkpointed(dense.retrieve_dense(topic_vectors, vectors, k))
    runs = {
        "bm25_ng2": lexical.retrieve(topics, bigram_index, k=k),
        "dense": cosine,
        "pair": pairs.retrieve_pairs(topics, corpus, k),
        "bm25_dense": chain(bm25, rerank_dense(topic_vectors, vectors)),
        "bm25_pair": chain(bm25, rerank_pair(topics, with_index_text(index))),
        "dense_pair": chain(cosine, rerank_pair(topics, with_corpus_text(corpus))),
    }
    return reduce(
        lambda a, b: a.unionByName(b),
        [as_run(run, name) for name, run in runs.items()],
        terms.select("system", "qid", "docno", "rank", "score"),
    )
