"""KPIs against a target, explanation of a spike, and the business brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.numbers import as_number, cast_number, display_number, is_numeric_type, round_even
from grainmill.functions.text import normalize_name, normalize_text, strip
from grainmill.operators.counting import column_medians, duplicate_rows
from grainmill.operators.roles import pick, quoted

# Accepted spellings of the favourable direction.
DIRECTIONS = {
    "higher": ["higher", "higher is better", "plus", "hausse", "plus eleve", "maximiser", "augmenter"],
    "lower": ["lower", "lower is better", "moins", "baisse", "plus bas", "minimiser", "reduire"],
}
KPI_AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count")


class MetricError(ValueError):
    """The requested metric cannot be computed on these columns."""


def _cell_number(df: DataFrame, name: str) -> Column:
    """Numeric-castable value: no locale parsing, decimals kept so that sums stay exact."""
    data_type = df.schema[name].dataType
    if data_type.typeName().startswith("decimal"):
        return quoted(name)
    return as_number(quoted(name), data_type) if is_numeric_type(data_type) else cast_number(strip(quoted(name).cast("string")))


def direction_of(text: str) -> str:
    wanted = normalize_name(text)
    for direction, spellings in DIRECTIONS.items():
        if wanted in spellings:
            return direction
    raise MetricError("the favourable direction is higher or lower")


def kpis(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Evaluate indicator specifications together.

    Each spec has id, aggregation, and optionally measure, target and direction. All values come
    from one aggregate; medians are exact. Invalid specs are skipped, as are those without a value.
    """
    valid = []
    for spec in specs:
        measure, aggregation = spec.get("measure"), spec.get("aggregation", "sum")
        if aggregation in KPI_AGGREGATIONS and (measure in df.columns or (measure is None and aggregation == "count")):
            valid.append({**spec, "measure": measure, "aggregation": aggregation,
                          "direction": direction_of(spec.get("direction", "higher"))})
    medians = column_medians(df, {
        s["measure"]: _cell_number(df, s["measure"]) for s in valid if s["aggregation"] == "median"
    })

    def value_of(spec: dict) -> Column:
        if spec["measure"] is None:
            return F.count("*")
        if spec["aggregation"] == "count":
            return F.count(quoted(spec["measure"]))
        number = _cell_number(df, spec["measure"])
        return {
            "sum": F.sum(number), "mean": F.sum(number) / F.count(number), "min": F.min(number), "max": F.max(number),
            "median": F.lit(medians.get(spec["measure"])),
        }[spec["aggregation"]]

    def used_by(spec: dict) -> Column:
        if spec["measure"] is None or spec["aggregation"] == "count":
            return value_of(spec)
        return F.count(_cell_number(df, spec["measure"]))

    aggregates = [
        F.struct(
            F.lit(str(s["id"])).alias("id"), F.lit(s["measure"]).cast("string").alias("measure"),
            F.lit(s["aggregation"]).alias("aggregation"),
            display_number(value_of(s).cast("double")).alias("value"),
            F.lit(s.get("target")).cast("double").alias("target"), F.lit(s["direction"]).alias("direction"),
            used_by(s).alias("usable_values"),
        ).alias(f"k{i}")
        for i, s in enumerate(valid)
    ]
    if not aggregates:
        raise MetricError("no valid indicator")
    rows = df.agg(*aggregates).select(F.inline(F.array(*[F.col(f"k{i}") for i in range(len(valid))])))
    value, target, higher = F.col("value"), F.col("target"), F.col("direction") == "higher"
    rows = rows.where(F.col("value").isNotNull()).withColumn("target", display_number(target))
    reached = F.when(higher, value >= target).otherwise(value <= target)
    gap = F.when(higher, F.greatest(target - value, F.lit(0.0))).otherwise(F.greatest(value - target, F.lit(0.0)))
    achieved = F.when(higher & (target > 0), round_even(value / target * 100, 1))
    return rows.select(
        "id", "measure", "aggregation", "value", "target", "direction",
        F.when(target.isNull(), "no_target").when(reached, "target_reached").otherwise("needs_attention").alias("status"),
        display_number(value - target).alias("difference_from_target"),
        F.when(target.isNotNull(), display_number(gap)).alias("gap_to_target"),
        achieved.alias("achievement_percent"),
        F.when(achieved.isNotNull(), F.least(F.greatest(achieved, F.lit(0.0)), F.lit(100.0))).alias("progress"),
        "usable_values",
    )


def explain_spike(
    df: DataFrame, dimension: str, category: str, measure: str | None = None, focus: str | None = None,
    aggregation: str = "sum", top: int = 5,
) -> DataFrame:
    """Categories behind the gap between one group and the mean of the others.

    The focus is the group with the largest total, or the one given. A category absent
    from a group counts as zero there, so its usual value is its total over the other groups
    divided by their number: no dense table of groups by categories is built.
    """
    if aggregation not in ("sum", "count") or (aggregation == "sum" and measure not in df.columns):
        raise MetricError("a spike is explained by a sum or a count")
    top = max(1, min(int(top), 10))
    label = lambda name: F.coalesce(quoted(name).cast("string"), F.lit(V.MISSING_LABEL))
    value = _cell_number(df, measure) if aggregation == "sum" else F.lit(1)
    rows = df.select(label(dimension).alias("grp"), label(category).alias("category"), value.alias("value"))
    cells = rows.where(F.col("value").isNotNull()).groupBy("grp", "category").agg(F.sum("value").cast("double").alias("value"))
    totals = cells.groupBy("grp").agg(F.sum("value").alias("total"))
    chosen = totals if focus is None else totals.where(normalize_text(F.col("grp")) == normalize_name(focus))
    pick_rank = F.struct(-F.col("total"), F.col("grp")) if focus is None else F.struct(F.col("grp"))
    # One row: the focus, its total, the number of groups and their sum.
    whole = totals.agg(F.count("*").alias("groups"), F.sum("total").alias("everything"))
    target = chosen.agg(F.min_by(F.struct("grp", "total"), pick_rank).alias("focus"))
    focus_cell = target.scalar()
    others = F.lit(1.0) * whole.select("groups").scalar() - 1
    usual_total = F.try_divide(whole.select("everything").scalar() - focus_cell["total"], others)
    by_category = cells.groupBy("category").agg(
        F.sum(F.when(F.col("grp") == focus_cell["grp"], F.col("value")).otherwise(0.0)).alias("value"),
        F.sum(F.when(F.col("grp") != focus_cell["grp"], F.col("value")).otherwise(0.0)).alias("elsewhere"),
    )
    usual = F.col("elsewhere") / others
    parts = by_category.where((others >= 1) & focus_cell.isNotNull()).select("category", "value", usual.alias("usual"), (F.col("value") - usual).alias("difference"))
    parts = parts.orderBy(F.desc("difference"), "category").limit(top)
    total, base = display_number(focus_cell["total"]), display_number(usual_total)
    return parts.select(
        focus_cell["grp"].alias("focus"),
        total.alias("focus_value"), base.alias("focus_usual_value"),
        display_number(total - base).alias("focus_difference"),
        round_even(F.try_divide(display_number(total - base), F.abs(base)) * 100, 1).alias("focus_difference_percent"),
        "category",
        display_number(F.col("value")).alias("value"),
        display_number(F.col("usual")).alias("usual_value"),
        display_number(F.col("difference")).alias("difference"),
        F.when(display_number(F.col("difference")) > 0, "hausse").when(display_number(F.col("difference")) < 0, "baisse")
        .otherwise("stable").alias("direction"),
    )


def business_brief(df: DataFrame, source_kind: str | None = None) -> DataFrame:
    """Total, used, excluded, negative and duplicate rows, and the leading group with its share.

    One row. `available` is false for invoices, without an amount column, or without one
    readable amount; the other columns are then NULL.
    """
    amount = pick(df.columns, V.BRIEF_AMOUNT_PRIORITY)
    spark = df.sparkSession
    if source_kind == "invoices" or amount is None:
        return spark.createDataFrame([(False,)], "available boolean").select("available", *[
            F.lit(None).cast(t).alias(n) for n, t in BRIEF_FIELDS])
    group = pick(df.columns, V.BRIEF_GROUP_PRIORITY)
    number = as_number(quoted(amount), df.schema[amount].dataType)
    label = strip(quoted(group).cast("string")) if group else F.lit(None).cast("string")
    rows = df.select(number.alias("value"), label.alias("label"))
    facts = rows.agg(
        F.sum("value").alias("total"), F.count("value").alias("used"), F.count_if(F.col("value").isNull()).alias("excluded"),
        F.count_if(F.col("value") < 0).alias("negative"), F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("positive"),
    )
    by_label = rows.where((F.col("value") > 0) & F.col("label").isNotNull() & (F.col("label") != ""))
    totals = by_label.groupBy("label").agg(F.sum("value").alias("value"))
    leader = totals.agg(F.min_by(F.struct("label", "value"), F.struct(-F.col("value"), "label")).alias("leader")).scalar()
    has = F.col("used") > 0
    known = lambda c: F.when(has, c)
    return facts.select(
        has.alias("available"),
        known(F.lit({"captured_expenses": "Dépenses déclarées", "captured_sales": "Ventes déclarées"}.get(source_kind, "Total observé"))).alias("total_label"),
        known(F.lit(amount)).alias("amount_column"),
        known(round_even(F.col("total"), 2)).alias("total"),
        known(F.col("used")).alias("used_rows"),
        known(F.col("excluded")).alias("excluded_rows"),
        known(F.col("negative")).alias("negative_rows"),
        known(duplicate_rows(df)).alias("duplicate_rows"),
        known(leader["label"]).alias("leader"),
        known(round_even(F.try_divide(leader["value"], F.col("positive")) * 100, 1)).alias("leader_share_pct"),
        known(F.lit(pick(df.columns, V.BRIEF_COST_PRIORITY) is not None)).alias("has_cost"),
    )


BRIEF_FIELDS = [
    ("total_label", "string"), ("amount_column", "string"), ("total", "double"), ("used_rows", "bigint"),
    ("excluded_rows", "bigint"), ("negative_rows", "bigint"), ("duplicate_rows", "bigint"),
    ("leader", "string"), ("leader_share_pct", "double"), ("has_cost", "boolean"),
]
