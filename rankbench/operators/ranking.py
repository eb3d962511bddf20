"""Top-k cuts of runs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOPK = 10
PLACES = 6


def rounded(column, places: int = PLACES):
    return F.round(column, places)


def top_k(
    scored: DataFrame,
    k: int = TOPK,
    by: Sequence[str] = ("qid",),
    rank_base: int = 1,
) -> DataFrame:
    """Best ``k`` rows of every group, ties to the lower docno.

    The row_number filter is cut on both sides of the shuffle
    (WindowGroupLimit), so a task ships at most ``k`` rows per group.
    """
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("docno"))
    cut = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if rank_base != 1:
        cut = cut.withColumn("rank", F.col("rank") + (rank_base - 1))
    return cut


def reranked(scored: DataFrame, by: Sequence[str] = ("qid",), rank_base: int = 1) -> DataFrame:
    """New ranks for a short candidate list; every row stays."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("docno"))
    return scored.withColumn("rank", F.row_number().over(order) + (rank_base - 1))


def as_run(ranked: DataFrame, system: str) -> DataFrame:
    return ranked.select(F.lit(system).alias("system"), "qid", "docno", "rank", "score")
