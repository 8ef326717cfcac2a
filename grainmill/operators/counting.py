"""Exact counts and medians that stay distributed however large one value or group is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators.roles import quoted
from grainmill.plans.checkpoints import saved

# A median aggregate keeps one counter per distinct value; above this many it is narrowed first.
MEDIAN_VALUES_PER_GROUP = 200_000
MAX_BROADCAST_GROUPS = 100_000


def row_digest(columns: Sequence[str], nested: Sequence[str] = ()) -> Column:
    """128-bit digest of a row, NULL and position aware.

    Two independent 64-bit hashes: at 10^12 rows the chance of one wrong duplicate is about
    10^-15, and a shuffle carries 16 bytes per row instead of the row. Hashes skip NULLs inside a value,
    so `nested` columns are hashed as JSON that keeps them.
    """
    value = {name: F.to_json(quoted(name), {"ignoreNullFields": "false"}) if name in nested else quoted(name) for name in columns}
    cells = [part for name in columns for part in (value[name], quoted(name).isNull())]
    return F.struct(F.xxhash64(F.lit(17), *cells).alias("h1"), F.xxhash64(*reversed(cells), F.lit(42)).alias("h2"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Rows beyond the first of each identical group, as a scalar subquery."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    digest = row_digest(columns or df.columns, nested)
    groups = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).scalar()


def repeated_values(df: DataFrame, value: Column) -> Column:
    """Non-null values beyond the first of each, as a scalar subquery."""
    groups = df.select(value.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")).scalar()


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int, sketched: Mapping[str, int] | None = None) -> dict[str, int]:
    """Exact distinct counts, for the columns that may have at most `limit` of them.

    A sketch of all columns in one pass drops those far above the limit, so the exact pass
    only meets columns with few values. A column that is left out has more than `limit`.
    `sketched` holds the sketch's counts where a caller's own pass has made it.
    """
    if not columns:
        return {}
    if sketched is None:
        sketch = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        sketched = dict(zip(columns, sketch))
    small = [c for c in columns if sketched[c] <= 4 * limit + 20]
    if not small:
        return {}
    exact = df.agg(*[F.count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(small)]).first()
    return {c: exact[i] for i, c in enumerate(small)}


def _widest(rows: DataFrame, keys: list[str]) -> int:
    """Largest number of distinct values in one group (sketched, so within a few percent)."""
    per_group = rows.groupBy(*keys).agg(F.approx_count_distinct("value").alias("d"))
    return per_group.agg(F.max("d")).first()[0] or 0


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the one-row-per-group state; broadcast only when the groups are counted and few."""
    renamed = state.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in state.columns if c not in keys])
    if state.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS:
        renamed = F.broadcast(renamed)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(renamed, condition).drop(*[f"_{k}" for k in keys])


def grouped_median(df: DataFrame, keys: Sequence[Column], value: Column, names: Sequence[str]) -> DataFrame:
    """Exact median per group as columns `names` and `median`.

    The built-in aggregate holds one counter per distinct value of a group, which is safe when a
    sketch says there are few. Otherwise each group is first cut, round by round, to the
    values around its middle: a quantile sketch gives the bracket, a count gives the rank of its
    lower end, and the middle ranks are read inside it.
    """
    names = list(names)
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], value.cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    if _widest(rows, names) <= MEDIAN_VALUES_PER_GROUP:
        return rows.groupBy(*names).agg(F.median("value").alias("median"))
    return _median_by_narrowing(rows, names)


def _median_by_narrowing(rows: DataFrame, names: list[str]) -> DataFrame:
    state = rows.groupBy(*names).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("below"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    steps = F.array(*[F.lit(i / 1000) for i in range(1001)])
    for _ in range(6):
        sketch = rows.groupBy(*names).agg(
            F.count("*").alias("m"), F.percentile_approx("value", steps, 10_000).alias("q")
        )
        # A sketch quantile is off by at most a tenth of a step, so one spare step on each side
        # always encloses the wanted ranks. Small groups stay whole.
        at = lambda rank: (rank - F.col("below")) * 1000 / F.col("m")
        first = F.when(F.col("m") < 10_000, 0).otherwise(F.greatest(F.floor(at(low)) - 1, F.lit(0)))
        last = F.when(F.col("m") < 10_000, 1000).otherwise(F.least(F.ceil(at(high)) + 1, F.lit(1000)))
        # One row per group: saved, so that each round starts from a result and not from the
        # doubled lineage of the rounds before.
        bracket = saved(_with_state(state, sketch, names).select(
            *names, "n", "below", F.get("q", first.cast("int")).alias("lo"), F.get("q", last.cast("int")).alias("hi")
        ))
        joined = _with_state(rows, bracket, names)
        state = joined.groupBy(*names, "n", "below").agg(F.count_if(F.col("value") < F.col("lo")).alias("cut"))
        state = saved(state.select(*names, "n", (F.col("below") + F.col("cut")).alias("below")))
        rows = joined.where(F.col("value").between(F.col("lo"), F.col("hi"))).select(*names, "value")
        if _widest(rows, names) <= MEDIAN_VALUES_PER_GROUP:
            break
    counts = _with_state(rows.groupBy(*names, "value").agg(F.count("*").alias("c")), state, names)
    # At most MEDIAN_VALUES_PER_GROUP distinct values per group reach this window.
    order = Window.partitionBy(*names).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.col("below") + F.sum("c").over(order))
    middle = [F.min(F.when(F.col("upto") >= rank, F.col("value"))) for rank in (low, high)]
    return ranked.groupBy(*names).agg(((middle[0] + middle[1]) / 2).alias("median"))


def column_medians(df: DataFrame, values: Mapping[str, Column]) -> dict[str, float | None]:
    """Exact medians of several expressions; one number each comes back to the driver."""
    if not values:
        return {}
    rows = df.select(*[v.cast("double").alias(k) for k, v in values.items()])
    spread = rows.agg(*[F.approx_count_distinct(k).alias(k) for k in values]).first()
    small = [k for k in values if spread[k] <= MEDIAN_VALUES_PER_GROUP]
    found: dict[str, float | None] = {}
    if small:
        found.update(rows.agg(*[F.median(k).alias(k) for k in small]).first().asDict())
    for name in values:
        if name not in small:
            row = _median_by_narrowing(rows.select(F.col(name).alias("value")).where("value is not null"), []).first()
            found[name] = row["median"] if row else None
    return found


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each text column, smallest on ties. One pass for all columns."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).alias("value")) for c in columns]))
    counts = (
        df.select(cells.alias("cell")).select("cell.*").where("value is not null").groupBy("name", "value").count()
    )
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("value"))
    return {row["name"]: row["value"] for row in best.collect()}
