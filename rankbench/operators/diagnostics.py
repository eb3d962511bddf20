"""Checks of a dataset: lexical overlap, contradictions, length drift."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.operators.lexical import score_okapi
from rankbench.operators.lexicon_index import (
    document_frequencies,
    length_stats,
    tokenised,
)
from rankbench.operators.quantiles import exact_percentile
from rankbench.operators.ranking import rounded
from rankbench.session import checkpointed

TRAIN_POSITIVE = "train_positive"
TRAIN_NEGATIVE = "train_negative"
TEST = "test_corpus"


def triple_overlaps(triples: DataFrame) -> DataFrame:
    """Jaccard overlap of the query with the positive and with the negative."""
    sets = triples.select(
        "triple_id",
        tx.token_set(F.col("query")).alias("q"),
        tx.token_set(F.col("positive")).alias("p"),
        tx.token_set(F.col("negative")).alias("n"),
    )
    return sets.select(
        "triple_id",
        tx.set_overlap(F.col("q"), F.col("p")).alias("positive"),
        tx.set_overlap(F.col("q"), F.col("n")).alias("negative"),
    )


def bad_triples(triples: DataFrame) -> DataFrame:
    """One row: triples whose positive overlaps no more than the negative."""
    return triple_overlaps(triples).agg(
        F.count_if(F.col("positive") <= F.col("negative")).alias("bad"),
        F.count(F.lit(1)).alias("total"),
        rounded(F.avg((F.col("positive") <= F.col("negative")).cast("int"))).alias("share"),
    )


def jaccard_summary(triples: DataFrame) -> DataFrame:
    """Mean and median overlap per side."""
    overlaps = triple_overlaps(triples).unpivot(
        "triple_id", ["positive", "negative"], "side", "jaccard"
    )
    means = overlaps.groupBy("side").agg(rounded(F.avg("jaccard")).alias("mean"))
    medians = exact_percentile(overlaps, ["side"], "jaccard", 0.5, "median")
    return means.join(medians, "side").select("side", "mean", rounded(F.col("median")).alias("median"))


def pair_sides(triples: DataFrame) -> DataFrame:
    """All positives and negatives, repeats kept, with their queries."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("positive").alias("side"), F.col("positive").alias("text")),
            F.struct(F.lit("negative").alias("side"), F.col("negative").alias("text")),
        )
    )
    return triples.select("triple_id", "query", sides.alias("pair")).select(
        F.concat_ws("-", "triple_id", "pair.side").alias("pair_id"),
        "triple_id", "query", "pair.side", "pair.text",
    )


def okapi_scores(triples: DataFrame) -> DataFrame:
    """Okapi score of both sides of every triple over the combined corpus, case kept.

    Pairs and lexicon are read several times, so both are checkpointed.  Runs jobs.
    """
    sides = checkpointed(pair_sides(triples))
    documents = tokenised(sides.withColumnRenamed("pair_id", "docno"), lower=False)
    lexicon = checkpointed(document_frequencies(documents))
    lengths = documents.select("docno", F.size("terms").alias("dl"))
    return score_okapi(sides, lexicon, length_stats(lengths))


def contradictions(triples: DataFrame) -> DataFrame:
    """One row: triples whose negative scores strictly above the positive."""
    both = okapi_scores(triples).groupBy("triple_id").agg(
        F.max(F.when(F.col("side") == "positive", F.col("score"))).alias("positive"),
        F.max(F.when(F.col("side") == "negative", F.col("score"))).alias("negative"),
    )
    worse = F.col("negative") > F.col("positive")
    return both.agg(
        F.count_if(worse).alias("contradictions"),
        F.count(F.lit(1)).alias("total"),
        rounded(F.avg(worse.cast("int"))).alias("rate"),
    )


def length_groups(triples: DataFrame, corpus: DataFrame) -> DataFrame:
    """Word counts of positives, negatives and corpus texts with their group."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(TRAIN_POSITIVE).alias("group"), F.col("positive").alias("text")),
            F.struct(F.lit(TRAIN_NEGATIVE).alias("group"), F.col("negative").alias("text")),
        )
    )
    train = triples.select(sides.alias("s")).select(
        "s.group", tx.word_count(F.col("s.text")).alias("length")
    )
    test = corpus.select(F.lit(TEST).alias("group"), tx.word_count(F.col("text")).alias("length"))
    return train.unionByName(test)


def length_counts(lengths: DataFrame) -> DataFrame:
    """Histogram: at most one row per group and distinct length."""
    return lengths.groupBy("group", "length").agg(F.count(F.lit(1)).alias("n"))


def length_summary(lengths: DataFrame) -> DataFrame:
    """Mean, exact median, maximum and minimum per group, from the histogram."""
    return length_counts(lengths).groupBy("group").agg(
        rounded(F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("length", 0.5, F.col("n")).alias("median"),
        F.max("length").alias("longest"),
        F.min("length").alias("shortest"),
    )


def length_p95(lengths: DataFrame) -> DataFrame:
    """Exact 95th percentile per group, linear between neighbours."""
    return length_counts(lengths).groupBy("group").agg(
        F.percentile("length", 0.95, F.col("n")).alias("p95")
    )


def out_of_range_share(lengths: DataFrame) -> DataFrame:
    """Share of corpus texts longer than the p95 of each training group."""
    counts = length_counts(lengths)
    limits = length_p95(lengths).where(F.col("group") != TEST)
    test = counts.where(F.col("group") == TEST)

    def row(group: str) -> DataFrame:
        limit = limits.where(F.col("group") == group).select("p95").scalar()
        longer = F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n"))), F.lit(0))
        return test.agg(
            F.lit(group).alias("group"),
            F.max(limit).alias("p95"),
            longer.alias("exceeding"),
            rounded(100 * longer / F.sum("n")).alias("percent"),
        )

    return row(TRAIN_POSITIVE).unionByName(row(TRAIN_NEGATIVE))


def length_density(lengths: DataFrame, steps: int = 200) -> DataFrame:
    """Gaussian density per group on ``steps`` + 1 points of [0, p95 of the corpus].

    Works on the length histogram.  Bandwidth 1.06 * sd * n^(-1/5); a group
    without spread has no density.
    """
    counts = length_counts(lengths)
    top = length_p95(lengths).where(F.col("group") == TEST).select("p95").scalar()
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("length").cast("double"))
    squares = F.sum(F.col("n") * F.col("length").cast("double") * F.col("length"))
    spread = F.sqrt((squares - total * total / n) / F.nullif(n - 1, F.lit(0)))
    groups = counts.groupBy("group").agg(
        n.alias("size"), (1.06 * spread * F.pow(n, F.lit(-0.2))).alias("bandwidth")
    ).where(F.col("bandwidth") > 0)
    points = (
        counts.join(F.broadcast(groups), "group")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        .withColumn("at", top * F.col("step") / steps)
    )
    z = (F.col("at") - F.col("length")) / F.col("bandwidth")
    return points.groupBy("group", "step").agg(
        rounded(F.max("at")).alias("length"),
        F.round(
            F.sum(F.col("n") * F.exp(-0.5 * z * z))
            / F.max(F.col("size") * F.col("bandwidth") * math.sqrt(2 * math.pi)),
            9,
        ).alias("density"),
    )
