"""Exact percentiles with linear interpolation over weighted values."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.operators.numbering import ordered_sums


def exact_percentile(
    df: DataFrame, by: list[str], value: str, p: float, name: str
) -> DataFrame:
    """One row per group: the exact ``p`` percentile of ``value`` as ``name``.

    Equal values are merged first.  A range sort of the distinct values with
    running counts gives each its places, however the values are spread, so no
    task holds a whole group.  ``by`` must name columns with few values.  Runs
    a job.
    """
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    placed = ordered_sums(merged, [*by, "_v"], {"_upto": "_w"})
    groups = placed.groupBy(*by).agg(
        F.min(F.col("_upto") - F.col("_w")).alias("_base"), F.sum("_w").alias("_n")
    )
    found = (
        placed.join(F.broadcast(groups), by)
        .withColumn("_end", F.col("_upto") - F.col("_base"))
        .withColumn("_start", F.col("_end") - F.col("_w"))
    )
    # zero-based places of the neighbours and the weight between them
    place = F.lit(p) * (F.col("_n") - 1)

    def at(position):
        hit = (F.col("_start") <= position) & (F.col("_end") > position)
        return F.max(F.when(hit, F.col("_v")))

    part = F.max(place - F.floor(place))
    return found.groupBy(*by).agg(
        (at(F.floor(place)) * (1 - part) + at(F.ceil(place)) * part).alias(name)
    )
