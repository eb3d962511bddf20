"""Loss values of scored or embedded training pairs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.functions.vectors import cosine
from rankbench.operators.ranking import rounded

MARGIN = 0.5


def contrastive(pairs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row: mean contrastive loss on the cosine distance of ``left`` and ``right``."""
    distance = 1 - cosine(F.col("left"), F.col("right"))
    y = F.col("label")
    short = F.greatest(F.lit(margin) - distance, F.lit(0.0))
    value = 0.5 * (y * distance * distance + (1 - y) * short * short)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(value)).alias("loss"))


def binary_cross_entropy(scored: DataFrame) -> DataFrame:
    """One row: mean binary cross-entropy of raw scores (logits)."""
    s, y = F.col("score"), F.col("label")
    value = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
    return scored.agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(value)).alias("loss"))
