"""Exact positions and running sums over whole tables, without one big task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankbench.session import checkpointed

# Hex digits of the digest that name a bucket: at most 16**3 buckets per group,
# which bounds the table of bucket offsets.
BUCKET_DIGITS = 3


def number_by_digest(
    df: DataFrame, digest: Column, name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Position from 1 in digest order, over the table or within each group.

    The digest spreads rows evenly over its leading digits, so a group of any
    size is numbered by many tasks: bucket counts give each bucket its offset,
    and only the order inside a bucket needs a sort.  ``by`` must name columns
    with few values.
    """
    keyed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring("_digest", 1, BUCKET_DIGITS)
    )
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy(*by)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_digest")
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_digest", "_bucket", "_inside", "_offset")
    )


def ordered_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Running sums (this row included) in the order of ``order``.

    A range sort spreads the rows; the sorted table is checkpointed so that the
    partition each row sits in stays the same for both readers: per-partition
    totals give each partition its base, a window per partition does the rest.
    ``order`` should be unique in ``df``.  Runs a job.
    """
    placed = checkpointed(df.orderBy(*order)).withColumn(
        "_part", F.spark_partition_id()
    )
    totals = placed.groupBy("_part").agg(
        *[F.sum(source).alias(f"_all_{name}") for name, source in sums.items()]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part",
        *[
            F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_base_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = placed
    for name, source in sums.items():
        running = running.withColumn(f"_in_{name}", F.sum(source).over(inside))
    summed = running.join(bases, "_part")
    return summed.select(
        *df.columns,
        *[(F.col(f"_in_{name}") + F.col(f"_base_{name}")).alias(name) for name in sums],
    )
