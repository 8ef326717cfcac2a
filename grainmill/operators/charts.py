"""Chart data: histograms, grouped values, activity over time, automatic dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import vocabulary as V
from grainmill.functions.dates import as_date, bucket_label, is_date_type, time_bucket, time_unit
from grainmill.functions.numbers import as_number, cast_number, display_number, is_numeric_type, round_even
from grainmill.functions.text import strip
from grainmill.operators.cleaning import date_columns
from grainmill.operators.counting import distinct_up_to, grouped_median
from grainmill.operators.profile import value_frequency
from grainmill.operators.roles import kind, numeric_columns, quoted

AGGREGATIONS = ("count", "mean", "sum", "median")
TOP_GROUPS = 12
LAST_PERIODS = 24


class ChartError(ValueError):
    """The chosen columns or calculation cannot make a chart."""


def _numbers(df: DataFrame, column: str) -> Column:
    return as_number(quoted(column), df.schema[column].dataType)


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add `ord` to a result of a few dozen rows at most."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins, between 4 and 8 of them by the number of values: bin, low, high, rows."""
    values = df.select(_numbers(df, column).alias("v")).where("v is not null")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).select(
        "lo", "hi", F.least(F.lit(8), F.greatest(F.lit(4), F.floor(F.sqrt("n")))).cast("int").alias("bins")
    )
    shape = edges.select(F.struct("lo", "hi", "bins").alias("s")).scalar()
    lo, hi, bins = shape["lo"], shape["hi"], shape["bins"]
    # The last bin is closed: the maximum belongs to it. Equal values are all in the first.
    bin_of = F.least(F.coalesce(F.floor(F.try_divide((F.col("v") - lo) * bins, hi - lo)), F.lit(0)).cast("int") + 1, bins)
    counts = values.select(bin_of.alias("bin")).groupBy("bin").agg(F.count("*").alias("rows"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    axis = edges.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin"))
    return axis.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("low"),
        (F.col("lo") + width * F.col("bin")).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def cut_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Rows with `bin`, `low` and `high` of right-closed equal-width intervals; the first is
    lowered by 0.1 % of the range so that the minimum falls inside it."""
    values = df.withColumn("_v", _numbers(df, column))
    shape = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("s")).scalar()
    lo, hi = shape["lo"], shape["hi"]
    width = (hi - lo) / bins
    place = F.coalesce(F.ceil(F.try_divide(F.col("_v") - lo, width)), F.lit(1))
    position = F.least(F.greatest(place.cast("int"), F.lit(1)), F.lit(bins))
    low = F.when(F.col("bin") == 1, lo - (hi - lo) * 0.001).otherwise(lo + width * (F.col("bin") - 1))
    return (
        values.where(F.col("_v").isNotNull())
        .withColumn("bin", position)
        .withColumn("low", round_even(low, 3))
        .withColumn("high", round_even(lo + width * F.col("bin"), 3))
        .drop("_v")
    )


def discrete_frequency(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The ten most frequent numbers, shown in numeric order: value, rows."""
    values = df.select(_numbers(df, column).alias("value")).where("value is not null")
    counts = values.groupBy("value").agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(top).orderBy("value")


def date_activity(df: DataFrame, column: str, last: int = LAST_PERIODS) -> DataFrame:
    """Rows per adaptive time bucket, most recent buckets: label, rows."""
    dates = df.select(as_date(quoted(column), df.schema[column].dataType).alias("d")).where("d is not null")
    unit = time_unit(dates, F.col("d"))
    counts = dates.groupBy(time_bucket(F.col("d"), unit).alias("bucket")).agg(F.count("*").alias("rows"))
    recent = counts.orderBy(F.desc("bucket")).limit(last)
    return recent.select(bucket_label(F.col("bucket"), unit).alias("label"), "rows").orderBy("label")


def chart_options(df: DataFrame) -> DataFrame:
    """Columns a chart can use: name, kind, is_measure."""
    dates = set(date_columns(df))
    rows = df.count()
    limit = max(50, int(rows * 0.10))
    others = [f.name for f in df.schema if f.name not in dates and not is_numeric_type(f.dataType)]
    # Below a tenth of the rows the limit grows with the table, so distinct counts are exact aggregates.
    distinct = df.agg(*[F.count_distinct(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]).first() if others else []
    few = {c for i, c in enumerate(others) if 1 < distinct[i] <= limit}
    found = []
    for f in df.schema:
        if f.name in dates:
            found.append((f.name, "date", False))
        elif is_numeric_type(f.dataType):
            found.append((f.name, "number", True))
        elif f.name in few:
            found.append((f.name, "category", False))
    return df.sparkSession.createDataFrame(found, "name string, kind string, is_measure boolean")


def _two_decimals(name: str) -> Column:
    return F.format_string("%.2f", display_number(F.col(name)))


def _dominant_share(df: DataFrame, value: Column) -> float:
    values = df.select(value.alias("v")).where("v is not null")
    counts = values.groupBy("v").count()
    row = counts.agg((F.max("count") / F.sum("count")).alias("share")).first()
    return row["share"] or 0.0


def grouped_chart(df: DataFrame, dimension: str, measure: str | None = None, aggregation: str = "count") -> DataFrame:
    """Chart points (ord, label, value) of one calculation by one column.

    Dates: one point per adaptive bucket, the 24 most recent. Numbers counted over many values:
    ten bins. Anything else: the twelve largest groups, then the sum of the others when the
    calculation adds up. A missing dimension is left out.
    """
    if dimension not in df.columns:
        raise ChartError("unknown dimension")
    if aggregation not in AGGREGATIONS:
        raise ChartError("unknown aggregation")
    if aggregation != "count" and measure not in df.columns:
        raise ChartError("a numeric measure is required")
    data_type = df.schema[dimension].dataType
    is_date = is_date_type(data_type) or dimension in date_columns(df.select(quoted(dimension)))
    unit = None
    if is_date:
        dates = as_date(quoted(dimension), data_type)
        unit = time_unit(df, dates)
        group, rows = time_bucket(dates, unit), df
    elif aggregation == "count" and is_numeric_type(data_type) and _needs_bins(df, dimension):
        rows = cut_bins(df, dimension)
        group = F.concat(F.lit("("), F.col("low").cast("string"), F.lit(", "), F.col("high").cast("string"), F.lit("]"))
    else:
        rows, group = df, quoted(dimension)
    # Counting needs no measure column, so none is read.
    if aggregation == "count":
        pairs = rows.select(group.alias("grp"))
    else:
        number = quoted(measure)
        if not isinstance(df.schema[measure].dataType, T.DecimalType):
            plain_text = isinstance(df.schema[measure].dataType, T.StringType)
            number = cast_number(strip(number)) if plain_text else _numbers(df, measure)
        pairs = rows.select(group.alias("grp"), number.alias("value")).where(F.col("value").isNotNull())
    pairs = pairs.where(F.col("grp").isNotNull())
    if aggregation == "median":
        points = grouped_median(pairs, [F.col("grp")], F.col("value"), ["grp"]).withColumnRenamed("median", "value")
    else:
        value = {"count": F.count("*"), "sum": F.sum("value"), "mean": F.sum("value") / F.count("value")}[aggregation] if (
            aggregation != "count"
        ) else F.count("*")
        points = pairs.groupBy("grp").agg(value.cast("double").alias("value"))
    if is_date:
        last = points.orderBy(F.desc("grp")).limit(LAST_PERIODS)
        shown = _numbered(last, F.col("grp")).select("ord", bucket_label(F.col("grp"), unit, True).alias("label"), "value")
    else:
        points = points.select(F.col("grp").cast("string").alias("label"), "value")
        top = points.orderBy(F.desc("value"), "label").limit(TOP_GROUPS)
        shown = _numbered(top, F.desc("value"), F.col("label")).select("ord", "label", "value")
        if aggregation in ("count", "sum"):
            rest = points.join(F.broadcast(top.select("label")), "label", "left_anti")
            other = rest.agg(F.sum("value").alias("value")).where("value is not null")
            shown = shown.unionByName(other.select(F.lit(TOP_GROUPS + 1).alias("ord"), F.lit(V.OTHER_LABEL).alias("label"), "value"))
    return shown.withColumn("value", display_number(F.col("value"))).orderBy("ord")


def _needs_bins(df: DataFrame, column: str) -> bool:
    return distinct_up_to(df, [column], 20).get(column, 21) > 20 and _dominant_share(df, quoted(column)) < 0.50


def saved_charts(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Replay saved chart specifications; the invalid ones are skipped."""
    out = None
    for spec in specs:
        try:
            points = grouped_chart(df, spec.get("dimension", ""), spec.get("measure"), spec.get("aggregation", "count"))
        except ChartError:
            continue
        points = points.select(F.lit(spec["id"]).alias("chart"), "ord", "label", "value")
        out = points if out is None else out.unionByName(points)
    return out if out is not None else df.sparkSession.createDataFrame([], "chart string, ord int, label string, value double")


def dashboard(df: DataFrame, max_charts: int = 6) -> DataFrame:
    """Automatic charts as one table: chart, label, value, ord.

    Activity of the first date column, up to three numeric columns, then categories with 2 to
    50 values, six charts at most.
    """
    parts: list[DataFrame] = []

    def add(title: str, points: DataFrame, label: Column, value: str, *order: Column) -> None:
        parts.append(_numbered(points.withColumn("label", label), *order).select(
            F.lit(title).alias("chart"), "label", F.col(value).cast("double").alias("value"), "ord"))

    dates = date_columns(df)
    if dates:
        add(f"activity:{dates[0]}", date_activity(df, dates[0]), F.col("label"), "rows", F.col("label"))
    numbers = numeric_columns(df)[:3]
    few = distinct_up_to(df, numbers, 15)
    for name in numbers:
        if few.get(name, 16) <= 1:
            continue
        if few.get(name, 16) <= 15 or _dominant_share(df, quoted(name)) >= 0.50:
            add(f"values:{name}", discrete_frequency(df, name), _two_decimals("value"), "rows", F.col("value"))
        else:
            add(f"histogram:{name}", histogram(df, name), F.concat(_two_decimals("low"), F.lit("–"), _two_decimals("high")), "rows", F.col("bin"))
    categories = [f.name for f in df.schema if kind(f.dataType) in ("texte", "booléen") and f.name not in dates[:1]]
    small = distinct_up_to(df, categories, 50)
    for name in categories:
        if len(parts) >= max_charts:
            break
        if 1 < small.get(name, 0) <= 50:
            add(f"categories:{name}", value_frequency(df, name, 10), F.col("label"), "rows", F.desc("rows"), F.col("label"))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "chart string, label string, value double, ord int")
    for part in parts[1:max_charts]:
        out = out.unionByName(part)
    return out


def explain_peak(points: DataFrame, line: bool = False) -> DataFrame:
    """The highest point of a chart (ord, label, value; at most a few dozen rows): its
    distance to the average, and to the previous point or its share of the positive total."""
    previous = F.lag("value").over(Window.orderBy("ord"))
    whole = points.withColumn("previous", previous).agg(
        F.count("*").alias("points"),
        F.min_by(F.struct("label", "value", "previous", "ord"), F.struct(-F.col("value"), F.col("ord"))).alias("peak"),
        F.avg("value").alias("average"),
        F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("positive"),
    ).where("points >= 2")
    value = F.col("peak.value")
    from_average = F.try_divide(value - F.col("average"), F.abs("average")) * 100
    delta = value - F.col("peak.previous") if line else F.lit(None).cast("double")
    use_share = delta.isNull() & (F.col("positive") > 0)
    return whole.select(
        F.col("peak.label").alias("label"),
        round_even(value, 2).alias("value"),
        round_even(from_average, 1).alias("pct_vs_average"),
        round_even(delta, 2).alias("delta_vs_previous"),
        F.when(use_share, round_even(value / F.col("positive") * 100, 1)).alias("share_of_positive_pct"),
    )


def gold_chart_points(tables: dict[str, DataFrame]) -> DataFrame:
    """Top ten of the first table by dimension, and the monthly trend, as chart, ord, label, value."""
    parts = []
    by_dimension = sorted(name for name in tables if "_by_" in name and "total" in tables[name].columns)
    if by_dimension:
        table = tables[by_dimension[0]]
        label = F.col(table.columns[0])
        top = table.select(label.alias("label"), F.col("total").alias("value")).orderBy(F.desc("value"), "label").limit(10)
        parts.append((by_dimension[0], _numbered(top, F.desc("value"), F.col("label"))))
    if "gold_monthly_trend" in tables:
        trend = tables["gold_monthly_trend"].select(F.col("month").alias("label"), F.col("total").alias("value"))
        parts.append(("gold_monthly_trend", _numbered(trend, F.col("label"))))
    out = None
    for name, points in parts:
        points = points.select(F.lit(name).alias("chart"), "ord", "label", round_even(F.col("value"), 2).alias("value"))
        out = points if out is None else out.unionByName(points)
    if out is None:
        raise ChartError("no Gold table to draw")
    return out
