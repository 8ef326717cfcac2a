"""Values of a column to columns, after their number is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.roles import quoted

MAX_PIVOT = 100


class TooManyColumns(ValueError):
    """The column to be spread has more values than a table should have columns."""


def pivot(df: DataFrame, rows: Sequence[str], column: str, value: Column, most: int = MAX_PIVOT) -> DataFrame:
    """One row for each value of `rows` and one column for each value of `column`, in order, with the aggregate `value`.

    The values are found first, in one distinct that stops at `most` + 1 of them; more are refused. NULL has a column of
    its own, named `null`. With the values given, the spread itself is one aggregate of one pass.
    """
    values = [r[0] for r in df.select(quoted(column)).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise TooManyColumns(f"{column} has more than {most} values")
    ordered = sorted((v for v in values if v is not None), key=lambda v: (str(type(v)), v)) + [v for v in values if v is None]
    return df.groupBy(*[quoted(r) for r in rows]).pivot(column, ordered).agg(value)
