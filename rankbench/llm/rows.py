"""Rows carried whole through steps that name columns of their own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_row(table: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in table.columns])


def row_fields(table: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``table`` out of the struct that :func:`whole_row` made."""
    return [F.col(row)[c].alias(c) for c in table.columns]
