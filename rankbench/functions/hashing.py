"""Repeatable pseudo-random draws from keys.

MD5 of the key makes the draw the same on any partitioning, in any engine.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = float(2**32)


def digest(seed, *keys: Column) -> Column:
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hex_number(hexdigits: Column) -> Column:
    return F.conv(hexdigits, 16, 10).cast("bigint")


def draw(seed, *keys: Column) -> Column:
    """Whole number in [0, 2**32)."""
    return hex_number(F.substring(digest(seed, *keys), 1, 8))


def share(seed, *keys: Column) -> Column:
    """Number in [0, 1)."""
    return draw(seed, *keys) / F.lit(RANGE)


def slot(term: Column, dim: int) -> Column:
    """Position of a term in a hashed vector."""
    return F.pmod(hex_number(F.substring(F.md5(term), 1, 8)), F.lit(dim)).cast("int")


def sign(term: Column) -> Column:
    """+1 or -1, from a digit the slot doesn't use."""
    return F.when(F.substring(F.md5(term), 9, 1) < "8", F.lit(1.0)).otherwise(F.lit(-1.0))
