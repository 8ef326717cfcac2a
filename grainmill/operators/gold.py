"""Gold tables: totals by dimension, counts by dimension, monthly trend, column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.dates import as_date, is_date_type
from grainmill.functions.numbers import as_number, round_even
from grainmill.functions.text import text_or_null
from grainmill.operators import roles
from grainmill.operators.profile import gold_column_profile
from grainmill.operators.roles import quoted


def _measure(df: DataFrame, name: str) -> Column:
    """The amount, kept decimal when it is, so that sums stay exact."""
    data_type = df.schema[name].dataType
    return quoted(name) if data_type.typeName().startswith("decimal") else as_number(quoted(name), data_type)


def _label(df: DataFrame, name: str) -> Column:
    return F.coalesce(text_or_null(quoted(name)), F.lit(V.MISSING_LABEL))


def total_by_dimension(df: DataFrame, amount: str, dimension: str) -> DataFrame:
    """Total, transactions, average and share of the positive totals, largest first."""
    name = roles.snake(dimension)
    rows = df.select(_label(df, dimension).alias(name), _measure(df, amount).alias("value"))
    groups = rows.where(F.col("value").isNotNull()).groupBy(name).agg(
        F.sum("value").cast("double").alias("sum"), F.count("*").alias("transactions")
    )
    positive = F.greatest(F.col("sum"), F.lit(0.0))
    # The subquery reads both aggregates, so that it is the same shuffle as the table's and Spark runs that once; no group is empty.
    whole = groups.agg(F.nullif(F.sum(F.when(F.col("transactions") > 0, positive)), F.lit(0.0))).scalar()
    return groups.select(
        name,
        round_even(F.col("sum"), 2).alias("total"),
        "transactions",
        round_even(F.col("sum") / F.col("transactions"), 2).alias("average"),
        round_even(positive / F.coalesce(whole, F.lit(1.0)) * 100, 1).alias("share_pct"),
    ).orderBy(F.desc("total"), name)


def rows_by_dimension(df: DataFrame, dimension: str) -> DataFrame:
    name = roles.snake(dimension)
    counts = df.groupBy(_label(df, dimension).alias(name)).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), name)


def monthly_trend(df: DataFrame, date: str, amount: str | None = None) -> DataFrame:
    """Total and transactions per month with the change from the month before."""
    month = F.date_format(as_date(quoted(date), df.schema[date].dataType), "yyyy-MM")
    value = _measure(df, amount) if amount else F.lit(1)
    months = df.select(month.alias("month"), value.alias("value")).where("month is not null").groupBy("month").agg(
        round_even(F.coalesce(F.sum("value").cast("double"), F.lit(0.0)), 2).alias("total"),
        F.count("*").alias("transactions"),
    )
    # One row per calendar month reaches this window.
    before = F.lag("total").over(Window.orderBy("month"))
    change = F.try_divide(F.col("total"), before) - 1
    return months.withColumn("mom_change_pct", round_even(change * 100, 1)).orderBy("month")


def gold_roles(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str | None]:
    """Columns used as amount, dimension and date; an override wins."""
    dated = [f.name for f in df.schema if is_date_type(f.dataType)] + [c for c in df.columns if roles.is_dated(c)]
    found = {
        "amount": roles.pick(df.columns, V.AMOUNT_PRIORITY, roles.is_amount),
        "dimension": roles.pick(df.columns, V.DIMENSION_PRIORITY),
        "date": next(iter(dated), None),
    }
    return {**found, **(overrides or {})}


def gold_tables(
    df: DataFrame, overrides: dict[str, str] | None = None, exact: bool = True, stored: bool = False
) -> dict[str, DataFrame]:
    """Every Gold table the columns allow, by name. `stored`: the frame reads its columns from files one by one."""
    chosen = gold_roles(df, overrides)
    amount, dimension, date = chosen["amount"], chosen["dimension"], chosen["date"]
    tables = {"gold_column_profile": gold_column_profile(df, exact, stored)}
    if dimension and amount:
        tables[f"gold_{roles.snake(amount)[:24]}_by_{roles.snake(dimension)[:24]}"] = total_by_dimension(df, amount, dimension)
    elif dimension:
        tables[f"gold_rows_by_{roles.snake(dimension)[:24]}"] = rows_by_dimension(df, dimension)
    if date:
        dates = as_date(quoted(date), df.schema[date].dataType)
        if len(df.select(dates.alias("d")).where("d is not null").limit(2).collect()) == 2:
            tables["gold_monthly_trend"] = monthly_trend(df, date, amount)
    return tables
