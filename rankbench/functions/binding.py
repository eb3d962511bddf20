"""Evaluate a value once and use it many times inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A lambda body is evaluated per element, with everything inlined in it, so a
    costly value must come in as a lambda argument.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
