"""Arithmetic on array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankbench.functions.binding import bound


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Vector of length one; a zero vector stays as it is."""

    def scaled(length: Column) -> Column:
        return F.when(
            length > 0, F.transform(v, lambda x: x.cast("double") / length)
        ).otherwise(F.transform(v, lambda x: x.cast("double")))

    return bound(norm(v), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is the zero vector, null when it is null."""
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).when(sizes == 0, F.lit(0.0))
