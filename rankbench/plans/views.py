"""Retrieval collections derived from the given tables.

Two collections, both over whole tables:

* ``bench``: corpus = all documents, topics = all benchmark items, relevant are
  the documents that contain the item's words as one run.
* ``chat``: corpus = all assistant turns, topics = all user turns; the reply
  that follows has label 2, the reply after that one label 1.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.functions.hashing import digest
from rankbench.operators.joins import broadcast_if_short, fetch
from rankbench.operators.numbering import number_by_digest
from rankbench.session import checkpointed, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(column: str):
    return F.col(column).cast("string")


def raw_corpus(spark, sf_dir) -> DataFrame:
    """Raw corpus layout; some rows lack the second language."""
    return table(spark, sf_dir, "documents").select(
        _id("doc_id").alias("_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        F.col("lang").alias("title_english"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("text_english"),
    )


def raw_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        _id("item_id").alias("_id"),
        "text",
        F.when(F.length("text") % 7 != 0, F.lit("x")).alias("text_english"),
    )


def raw_qrels(spark, sf_dir) -> DataFrame:
    """Judgments from the label table: quality of a document for its source."""
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
        .select(
            F.col("source").alias("query-id"),
            _id("doc_id").alias("corpus-id"),
            F.when(F.col("toxic") == 0, F.col("quality")).alias("score"),
        )
    )


def raw_triplets(spark, sf_dir) -> DataFrame:
    return triples(spark, sf_dir).select(
        "query", "positive", "negative",
        F.col("triple_id").cast("string").alias("query_english"),
        F.when(F.col("triple_id") % 5 != 0, F.lit("x")).alias("positive_english"),
        F.lit("x").alias("negative_english"),
    )


def bench_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        _id("doc_id").alias("docno"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
    )


def bench_topics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        _id("item_id").alias("qid"), F.col("text").alias("query")
    )


def bench_qrels(spark, sf_dir, index) -> DataFrame:
    """Documents that contain the item's words as one run.

    Such a document has every word of the item, so it is enough to check the
    postings of the item's rarest word.
    """
    topics = bench_topics(spark, sf_dir).select(
        "qid", tx.words(F.col("query")).alias("words")
    )
    rarest = (
        topics.select("qid", F.explode(F.array_distinct("words")).alias("term"))
        .join(index.lexicon, "term")
        .groupBy("qid")
        .agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    )
    needles = topics.select("qid", _framed(F.col("words")).alias("needle"))
    # one short row an item: the postings stay where they lie
    asked = broadcast_if_short(checkpointed(rarest))
    candidates = checkpointed(
        index.postings.select("docno", "term").join(asked, "term").join(needles, "qid")
    )
    return (
        fetch(candidates, index.docstore.select("docno", "text_raw"))
        .withColumn("words", tx.words(F.col("text_raw")))
        .where(F.contains(_framed(F.col("words")), F.col("needle")))
        .select("qid", F.lit("Q0").alias("iter"), "docno", F.lit(1).alias("label"))
    )


def _framed(words):
    return F.concat(F.lit(" "), tx.joined(words), F.lit(" "))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_key"), "*"
    )


def chat_corpus(spark, sf_dir) -> DataFrame:
    return (
        _turns(spark, sf_dir)
        .where(F.col("role") == "assistant")
        .select(
            F.col("turn_key").alias("docno"),
            F.substring_index("text", ".", 1).alias("title"),
            "text",
        )
    )


def chat_topics(spark, sf_dir) -> DataFrame:
    return (
        _turns(spark, sf_dir)
        .where(F.col("role") == "user")
        .select(F.col("turn_key").alias("qid"), F.col("text").alias("query"))
    )


def chat_qrels(spark, sf_dir) -> DataFrame:
    """The reply one turn later (label 2) and three turns later (label 1)."""
    turns = _turns(spark, sf_dir)
    asked = (
        turns.where(F.col("role") == "user")
        .select(
            "conv_id",
            F.col("turn_key").alias("qid"),
            F.explode(
                F.array(
                    F.struct((F.col("turn") + 1).alias("turn"), F.lit(2).alias("label")),
                    F.struct((F.col("turn") + 3).alias("turn"), F.lit(1).alias("label")),
                )
            ).alias("next"),
        )
        .select("conv_id", "qid", "next.turn", "next.label")
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("turn_key").alias("docno")
    )
    return asked.join(replies, ["conv_id", "turn"]).select(
        "qid", F.lit("Q0").alias("iter"), "docno", "label"
    )


def triples(spark, sf_dir) -> DataFrame:
    """User turn, the reply that follows, and the reply of another triple.

    Triples are numbered in digest order of their turn; the negative of triple
    ``i`` is the positive of triple ``i + 7``, wrapping around.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query")
    )
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    pairs = asked.join(replies, ["conv_id", "turn"])
    numbered = number_by_digest(
        pairs, digest("triple", F.col("conv_id"), F.col("turn")), "triple_id"
    ).select(F.col("triple_id").cast("bigint"), "query", "positive")
    total = numbered.agg(F.count(F.lit(1))).scalar()
    wrapped = F.pmod(F.col("triple_id") - 8, total) + 1
    others = numbered.select(wrapped.alias("triple_id"), F.col("positive").alias("negative"))
    return numbered.join(others, "triple_id").select(
        "triple_id", "query", "positive", "negative"
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        _id("vec_id").alias("docno"), "embedding", "label"
    )


def class_topics(spark, sf_dir) -> DataFrame:
    """One query per class: the mean vector of its members."""
    means = (
        vectors(spark, sf_dir)
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy("label").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e.x
        ).alias("embedding")
    ).select(F.col("label").cast("string").alias("qid"), "embedding")


def class_qrels(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select(
        F.col("label").cast("string").alias("qid"), F.lit("Q0").alias("iter"),
        "docno", F.lit(1).alias("label"),
    )


def shift_by_language(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """English against the other languages: a shift that must be found."""
    docs = spread(
        table(spark, sf_dir, "documents").select(_id("doc_id").alias("id"), "text", "lang")
    )
    return (
        docs.where(F.col("lang") == "en").drop("lang"),
        docs.where(F.col("lang") != "en").drop("lang"),
    )


def shift_by_label(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Unlabelled against labelled documents: no shift to find."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _id("doc_id").alias("id"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return (
        docs.join(labels, "doc_id", "left_anti").select("id", "text"),
        docs.join(labels, "doc_id", "left_semi").select("id", "text"),
    )
