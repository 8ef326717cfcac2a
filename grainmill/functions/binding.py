"""Name a value inside an expression, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once.

    Inside a lambda function Spark computes a repeated expression at every place it stands; one that
    belongs to the whole array, such as the array itself, even once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
