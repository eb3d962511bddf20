"""Seeded samples of bounded size that no single task has to gather first."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Draws are whole numbers below this.
RANGE = 1 << 30


def draw(seed: int, *keys: str) -> Column:
    """Whole number in [0, RANGE) from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(RANGE))


def enough(most: int, total):
    """Draws below this leave ``most`` of ``total`` rows or a few more.

    Six standard deviations above: fewer are left about once in a billion times,
    and then the sample is a little smaller.
    """
    return (most + 6 * most**0.5 + 36) * RANGE / total


def first_by_hash(rows: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """The ``most`` rows with the smallest draws, or all if there are no more.

    A count tells which rows can be among them, so the rest stay where they lie
    and the last step orders little more than ``most`` rows.  Counts ``rows``.
    """
    total = rows.count()
    near = rows.where(draw(seed, *keys) < enough(most, max(1, total)))
    return near.orderBy(draw(seed, *keys), *keys).limit(most)
