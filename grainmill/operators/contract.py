"""Data contract: inferred from a table, then evaluated as checks on any version of it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.dates import as_date, is_date_type
from grainmill.functions.numbers import as_number, is_numeric_type, round_even
from grainmill.functions.text import text_or_null
from grainmill.operators import roles
from grainmill.operators.counting import distinct_up_to, duplicate_rows, repeated_values
from grainmill.operators.harmonise import cell_counts_of, label_variants
from grainmill.operators.roles import quoted

CONTRACT_SCHEMA = (
    "name string, type string, required boolean, unique boolean, min double, max double, categorical boolean"
)
CHECK_SCHEMA = (
    "id string, column string, rule string, label string, failing_rows bigint, total_rows bigint, "
    "pass_rate double, status string, detail string"
)

# Fixed value: share of missing cells a required column may have before it fails.
MISSING_TOLERANCE = 0.02


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    required: bool
    unique: bool
    min: float | None
    max: float | None
    categorical: bool


def rating_scale(values: Column) -> Column:
    """Aggregate: 5 when 80 % of values fit, else 10 when 80 % fit, else NULL."""
    fits = lambda top: F.avg((values <= top).cast("double")) >= 0.8
    return F.when(fits(5), F.lit(5.0)).when(fits(10), F.lit(10.0))


def infer_contract(df: DataFrame) -> list[ColumnRule]:
    """One pass for parse rates, rating scales and sketched label counts, then exact label counts where they matter."""
    fields = df.schema.fields
    typed_by_name = {
        f.name: "date"
        if is_date_type(f.dataType) or roles.is_dated(f.name)
        else "number"
        if is_numeric_type(f.dataType) or roles.is_amount(f.name) or roles.is_quantity(f.name)
        else None
        for f in fields
    }
    undecided = [f for f in fields if typed_by_name[f.name] is None and not roles.is_id(f.name)]
    rated = [f for f in fields if roles.is_rating(f.name)]
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(undecided):
        text = text_or_null(quoted(f.name))
        aggregates.append(F.avg(F.when(text.isNotNull(), as_number(quoted(f.name), f.dataType).isNotNull().cast("double"))).alias(f"r{i}"))
        aggregates.append(F.approx_count_distinct(text).alias(f"c{i}"))
    for i, f in enumerate(rated):
        aggregates.append(rating_scale(as_number(quoted(f.name), f.dataType)).alias(f"s{i}"))
    seen = df.agg(*aggregates).first()
    numeric = {f.name for i, f in enumerate(undecided) if (seen[f"r{i}"] or 0.0) >= 0.9}
    scale = {f.name: seen[f"s{i}"] for i, f in enumerate(rated)}

    def type_of(name: str) -> str:
        known = typed_by_name[name]
        if known == "number" or (known is None and name in numeric):
            return "integer" if roles.is_quantity(name) else "decimal"
        return known or "text"

    types = {f.name: type_of(f.name) for f in fields}
    texts = [f.name for f in fields if types[f.name] == "text" and not roles.is_id(f.name)]
    trimmed = df.select(*[text_or_null(quoted(c)).alias(c) for c in texts])
    labels = distinct_up_to(trimmed, texts, 30, {f.name: seen[f"c{i}"] for i, f in enumerate(undecided)})
    return [
        ColumnRule(
            name=name,
            type=expected,
            required=roles.is_id(name) or roles.is_amount(name) or expected == "date",
            unique=roles.is_id(name) and not roles.is_sku(name),
            min=0.0 if expected != "text" and roles.is_non_negative(name) else None,
            max=scale.get(name) if expected != "text" else None,
            categorical=2 <= labels.get(name, 0) <= 30,
        )
        for name, expected in types.items()
    ]


def contract_frame(spark: SparkSession, contract: list[ColumnRule]) -> DataFrame:
    rows = [(r.name, r.type, r.required, r.unique, r.min, r.max, r.categorical) for r in contract]
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def contract_from(frame: DataFrame) -> list[ColumnRule]:
    """Read a published contract back; one row per column."""
    return [ColumnRule(**row.asDict()) for row in frame.select(*CONTRACT_NAMES).collect()]


CONTRACT_NAMES = [part.split()[0] for part in CONTRACT_SCHEMA.split(", ")]


# -- checks -----------------------------------------------------------------------------------------


def check_status(failing: Column, total: Column, warn_ratio: Column, severity: Column) -> Column:
    ratio = failing / F.greatest(total, F.lit(1))
    return (
        F.when(failing == 0, "pass")
        .when((severity == "warning") | (ratio <= warn_ratio), "warn")
        .otherwise("fail")
    )


def graded(raw: DataFrame) -> DataFrame:
    """Add pass rate and status to (id, column, rule, label, failing_rows, total_rows, detail, warn_ratio, severity)."""
    failing, total = F.col("failing_rows"), F.col("total_rows")
    rate = F.coalesce(F.lit(1.0) - F.try_divide(failing, total), F.lit(1.0))
    return raw.select(
        "id", "column", "rule", "label", "failing_rows", "total_rows",
        round_even(rate * 100, 1).alias("pass_rate"),
        check_status(failing, total, F.col("warn_ratio"), F.col("severity")).alias("status"),
        "detail",
    )


def run_checks(df: DataFrame, contract: list[ColumnRule], as_of: dt.date, labels: bool = True) -> DataFrame:
    """All checks of a contract as one long table.

    Counts of every column come from one aggregate over the parsed columns. Duplicates, unique
    identifiers and the labels of all columns have their own shuffle each and enter as scalar subqueries.
    """
    known = [r for r in contract if r.name in df.columns]
    cells_of = cell_counts_of(df, [r.name for r in known if r.categorical]) if labels else {}
    parsed, aggregates, cells = [], [F.count("*").alias("rows")], []

    def add(name, column, rule, label, failing, total, detail, warn_ratio=0.0, severity="error"):
        cells.append(
            F.struct(
                F.lit(len(cells)).alias("position"), F.lit(name).alias("id"), F.lit(column).cast("string").alias("column"),
                F.lit(rule).alias("rule"), F.lit(label).alias("label"),
                F.coalesce(failing, F.lit(0)).cast("bigint").alias("failing_rows"),
                F.coalesce(total, F.lit(0)).cast("bigint").alias("total_rows"),
                F.concat(detail).alias("detail"), F.lit(warn_ratio).alias("warn_ratio"), F.lit(severity).alias("severity"),
            )
        )

    def counted(failing: Column, what: str) -> Column:
        return F.concat(F.coalesce(failing, F.lit(0)).cast("string"), F.lit(f" {what}"))

    duplicates = duplicate_rows(df)
    add("table.no_duplicates", None, "unique_rows", "no duplicate row", duplicates, F.col("rows"), counted(duplicates, "exact duplicate(s)"))
    tomorrow = F.lit(dt.datetime.combine(as_of, dt.time()) + dt.timedelta(days=1)).cast("timestamp_ntz")
    for i, rule in enumerate(contract):
        name = rule.name
        if rule not in known:
            add(f"{name}.exists", name, "exists", "column present", F.lit(1), F.lit(1), F.lit(""))
            continue
        c, data_type = quoted(name), df.schema[name].dataType
        text = text_or_null(c)
        parsed.append(text.alias(f"t{i}"))
        aggregates.append(F.count(f"t{i}").alias(f"pop{i}"))
        populated = F.col(f"pop{i}")
        if rule.required:
            missing = F.col("rows") - populated
            add(f"{name}.not_null", name, "not_null", "value required", missing, F.col("rows"), counted(missing, "empty cell(s)"), MISSING_TOLERANCE)
        if rule.type in ("decimal", "integer"):
            parsed.append(as_number(c, data_type).alias(f"v{i}"))
            value = F.col(f"v{i}")
            aggregates += [
                F.count(value).alias(f"num{i}"),
                F.count_if(F.col(f"t{i}").isNotNull() & value.isNull()).alias(f"bad{i}"),
                F.count_if(value < F.lit(rule.min)).alias(f"low{i}"),
                F.count_if(value > F.lit(rule.max)).alias(f"high{i}"),
            ]
            add(f"{name}.type", name, "numeric", "number format", F.col(f"bad{i}"), populated, counted(F.col(f"bad{i}"), "unreadable number(s)"))
            if rule.min is not None:
                add(f"{name}.min", name, "min", f"value >= {rule.min:g}", F.col(f"low{i}"), F.col(f"num{i}"), counted(F.col(f"low{i}"), "value(s) too low"))
            if rule.max is not None:
                add(f"{name}.max", name, "max", f"value <= {rule.max:g}", F.col(f"high{i}"), F.col(f"num{i}"), counted(F.col(f"high{i}"), "value(s) off scale"))
        elif rule.type == "date":
            parsed.append(as_date(c, data_type).alias(f"d{i}"))
            date = F.col(f"d{i}")
            aggregates += [
                F.count(date).alias(f"num{i}"),
                F.count_if(F.col(f"t{i}").isNotNull() & date.isNull()).alias(f"bad{i}"),
                F.count_if(date > tomorrow).alias(f"late{i}"),
                F.count_if(date < F.lit("2000-01-01").cast("timestamp_ntz")).alias(f"old{i}"),
            ]
            late, old = F.col(f"late{i}"), F.col(f"old{i}")
            add(f"{name}.type", name, "date", "date format", F.col(f"bad{i}"), populated, counted(F.col(f"bad{i}"), "unreadable date(s)"))
            add(f"{name}.range", name, "date_range", "plausible date", late + old, F.col(f"num{i}"),
                F.concat(late.cast("string"), F.lit(" future date(s), "), old.cast("string"), F.lit(" before 2000")), severity="warning")
        if rule.unique:
            repeated = repeated_values(df, text)
            add(f"{name}.unique", name, "unique", "unique identifier", repeated, populated, counted(repeated, "repeated identifier(s)"))
        if rule.categorical and labels:
            variants = label_variants(df, name, cells_of[name])
            add(f"{name}.consistent", name, "consistent_labels", "consistent labels",
                variants.select("variant_rows").scalar(), populated, variants.select("examples").scalar())
    wide = df.select(*parsed).agg(*aggregates) if parsed else df.agg(*aggregates)
    return graded(wide.select(F.inline(F.array(*cells))).orderBy("position"))


def summarize_checks(checks: DataFrame) -> DataFrame:
    count = lambda status: F.count_if(F.col("status") == status)
    score = F.rint((count("pass") + F.lit(0.5) * count("warn")) / F.count("*") * 100)
    return checks.agg(
        F.count("*").alias("total"), count("pass").alias("passed"), count("warn").alias("warnings"),
        count("fail").alias("failed"),
        F.when(F.count("*") == 0, F.lit(100)).otherwise(score).cast("int").alias("score"),
    )


def compare_checks(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Silver checks beside their Bronze counterpart, worst first; a new check stands for itself."""
    rank = lambda c: F.when(c == "fail", 0).when(c == "warn", 1).otherwise(2)
    before = bronze.select("id", F.col("status").alias("b_status"), F.col("failing_rows").alias("b_failing"))
    merged = silver.join(before, "id", "left").select(
        "id",
        F.coalesce("b_status", "status").alias("bronze_status"),
        F.coalesce("b_failing", "failing_rows").alias("bronze_failing"),
        F.col("status").alias("silver_status"),
        F.col("failing_rows").alias("silver_failing"),
    )
    return merged.orderBy(rank(F.col("silver_status")), rank(F.col("bronze_status")), "id")
