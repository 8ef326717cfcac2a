"""As-of join: each row with the latest row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators.roles import quoted


def _moment(df: DataFrame, column: str) -> Column:
    """The time as a number that sorts alike: microseconds of dates and timestamps, numbers as they are."""
    kind = df.schema[column].dataType
    return quoted(column) if isinstance(kind, T.NumericType) else F.unix_micros(quoted(column).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], part: int = 86_400_000_000) -> DataFrame:
    """All rows of `left` with the columns `values` of the row of `right` that has the same keys and the latest time at or
    before theirs; NULL where there is none.

    Of right rows at one time the one greatest by `values` counts. A NULL key or time has no match. A key's rows are windowed
    in parts of `part` microseconds (or of the time's own unit, for numbers), and each part starts from the last right row of
    the parts before it, so a key that holds much of the table is not one task's work.
    """
    known = right.dropna(subset=[*keys, right_time])
    other = F.struct(*[quoted(v) for v in values])
    kinds = left.schema, known.select(other.alias("r")).schema["r"].dataType
    rows = left.select(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)], _moment(left, left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[quoted(c) for c in left.columns]).alias("_l"), F.lit(None).cast(kinds[1]).alias("_r"))
    more = known.select(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)], _moment(known, right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kinds[0]).alias("_l"), other.alias("_r"))
    own = [f"_k{i}" for i in range(len(keys))]
    both = rows.unionByName(more).withColumn("_part", F.floor(F.col("_t") / part))
    # At one time right rows come first, in the order of their values.
    inside = Window.partitionBy(*own, "_part").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*own, "_part").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_end"))
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*own, "_part", F.last("_end", ignorenulls=True).over(before)["_r"].alias("_start"))
    seen = both.withColumn("_seen", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    found = seen.join(starts, [*own, "_part"], "left").withColumn("_found", F.coalesce("_seen", "_start"))
    return found.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_found")[v].alias(v) for v in values])
