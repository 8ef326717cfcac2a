"""Suggest fixes with their impact, and apply the chosen ones in a fixed order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.dates import CLEANING_DATE_SHAPE, TYPING_DATE_SHAPE, as_date, is_date_type, parse_local_date
from grainmill.functions.numbers import is_numeric_type, parse_local_number
from grainmill.functions.text import PLAIN_NUMBER, blank_to_null, normalize_name, strip, strip_cell
from grainmill.operators import roles
from grainmill.operators.counting import column_medians, column_modes, duplicate_rows
from grainmill.operators.harmonise import affected_rows, cell_counts_of, harmonisation_map, harmonise
from grainmill.operators.roles import quoted, sales_roles, text_columns
from grainmill.operators.sales import repair_sales, sales_issue
from grainmill.plans.checkpoints import saved

# Rank of each action when several are applied.
ACTION_ORDER = {
    "normalize_blanks": 0, "strip_text": 1, "harmonize_values": 2, "repair_sales_metrics": 3,
    "convert_numeric": 4, "convert_date": 4, "drop_duplicates": 5, "fill_median": 6, "fill_mode": 6,
}
SUGGESTION_SCHEMA = "position int, id string, impact bigint, severity string"


def allows_free(name: str) -> bool:
    return "livraison" in normalize_name(name)


def _measured(df: DataFrame) -> tuple[list[Column], list[Column], dict[str, dict[str, Column]]]:
    """The stripped text columns, aggregates of the single suggestion pass over the table with these, and a handle on each aggregate
    by column and measure."""
    cells: list[Column] = []
    aggregates: list[Column] = []
    handles: dict[str, dict[str, Column]] = {}
    taken = {c.lower() for c in df.columns}

    def measure(column: str, name: str, value: Column) -> None:
        alias = f"a{len(aggregates)}"
        aggregates.append(value.alias(alias))
        handles.setdefault(column, {})[name] = F.col(alias)

    for field in df.schema:
        c = quoted(field.name)
        measure(field.name, "missing", F.count_if(c.isNull()))
        if not isinstance(field.dataType, T.StringType):
            continue
        name = f"stripped{len(cells)}"
        while name.lower() in taken:
            name += "_"
        cells.append(strip_cell(c).alias(name))
        stripped = F.col(name)
        filled = stripped != ""
        number = parse_local_number(c, allows_free(field.name), stripped)
        measure(field.name, "blank", F.count_if(stripped == ""))
        measure(field.name, "trim", F.count_if(c != stripped))
        measure(field.name, "populated", F.count_if(filled))
        measure(field.name, "numbers", F.count(number))
        measure(field.name, "dates", F.count(parse_local_date(c, stripped)))
        measure(field.name, "shaped", F.count_if(stripped.rlike(CLEANING_DATE_SHAPE)))
    return cells, aggregates, handles


def suggest_cleaning(df: DataFrame, harmonised: bool = True) -> DataFrame:
    """Suggested fixes: position, id (`action` or `action::column`), impact, severity.

    Rates are over all populated cells of a column. One aggregate serves every rule; duplicates
    and label maps have a shuffle of their own.
    """
    stripped, aggregates, seen = _measured(df)
    sales = sales_roles(df.columns)
    aggregates += [F.count_if(sales_issue(df, sales)).alias("sales_issues"), F.count("*").alias("rows")]
    sales_columns = set(sales.values())
    cells: list[Column] = []

    def suggest(action: str, impact: Column, when: Column, severity="conseille") -> None:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        cells.append(F.struct(
            F.lit(len(cells)).alias("position"), F.lit(action).alias("id"),
            F.when(when, impact).cast("bigint").alias("impact"), severity.alias("severity"),
        ))

    total = lambda name: sum((m[name] for m in seen.values() if name in m), F.lit(0))
    duplicates = duplicate_rows(df)
    suggest("drop_duplicates", duplicates, duplicates > 0, "fort")
    suggest("normalize_blanks", total("blank"), total("blank") > 0, "fort")
    suggest("strip_text", total("trim"), total("trim") > 0, "fort")
    for name, counts in cell_counts_of(df, [c for c in text_columns(df) if harmonised and roles.label_role(c)]).items():
        rows = F.lit(affected_rows(counts, harmonisation_map(df, name, cells=counts)))
        suggest(f"harmonize_values::{name}", rows, rows > 0, "fort")
    suggest("repair_sales_metrics", F.col("sales_issues"), F.col("sales_issues") > 0, "fort")
    for field in df.schema:
        name, m = field.name, seen[field.name]
        if is_numeric_type(field.dataType):
            suggest(f"fill_median::{name}", m["missing"], m["missing"] > 0)
        if not isinstance(field.dataType, T.StringType):
            continue
        enough = m["populated"] >= 3
        rate = lambda count: F.coalesce(F.try_divide(count, m["populated"]), F.lit(0.0))  # noqa: E731, B023
        numeric = enough & (rate(m["numbers"]) >= 0.80)
        if name not in sales_columns:
            suggest(f"convert_numeric::{name}", m["numbers"], numeric)
            unreadable = F.col("rows") - m["numbers"]
            suggest(f"fill_median::{name}", unreadable, numeric & (unreadable > 0))
        hint = F.lit(roles.has_date_hint(name))
        dated = rate(m["dates"])
        is_date = enough & ~numeric & (hint | (rate(m["shaped"]) >= 0.75)) & ((dated >= 0.85) | (hint & (dated >= 0.60)))
        suggest(f"convert_date::{name}", m["dates"], is_date, F.when(dated >= 0.98, "fort").otherwise("conseille"))
        if "date" not in normalize_name(name) and name not in sales_columns and roles.can_fill_with_mode(name):
            suggest(f"fill_mode::{name}", m["missing"], (m["missing"] > 0) & (m["populated"] > 0))
    found = df.select("*", *stripped).agg(*aggregates).select(F.inline(F.array(*cells))).where(F.col("impact") > 0)
    return found.orderBy("position")


# -- single fixes -------------------------------------------------------------------------------------


def _map_text(df: DataFrame, change) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[change(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def normalize_blanks(df: DataFrame) -> DataFrame:
    return _map_text(df, blank_to_null)


def strip_text(df: DataFrame) -> DataFrame:
    return _map_text(df, strip)


def drop_duplicates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per identical business row; with `order_by`, its smallest value is kept."""
    if order_by is None:
        return df.dropDuplicates()
    business = [c for c in df.columns if c != order_by]
    kept = df.groupBy(*[quoted(c) for c in business]).agg(F.min(quoted(order_by)).alias(order_by))
    return kept.select(*[quoted(c) for c in df.columns])


def _replace(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else quoted(c) for c in df.columns])


def convert_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, {c: parse_local_number(quoted(c), allows_free(c)) for c in columns})


def convert_date(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, {c: as_date(quoted(c), df.schema[c].dataType) for c in columns})


def fill_with(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace the missing cells of some columns by a known value each; None changes nothing."""
    known = {c: v for c, v in values.items() if v is not None}
    number = lambda c, v: quoted(c).cast("double") if isinstance(v, float) else quoted(c)
    return _replace(df, {c: F.coalesce(number(c, v), F.lit(v)) for c, v in known.items()})


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_with(df, column_medians(df, {c: quoted(c) for c in columns}))


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_with(df, column_modes(df, columns))


# -- a batch of fixes -----------------------------------------------------------------------------------

LOG_SCHEMA = (
    "step int, action string, rows_before bigint, rows_after bigint, missing_before bigint, missing_after bigint"
)


def apply_cleaning(
    df: DataFrame, actions: Iterable[str], order_by: str | None = None, allowed: Iterable[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply the selected suggestions. Returns the cleaned frame and its log, both lazy.

    Actions that are not currently suggested are ignored. The log holds, per action in order,
    rows and missing cells before and after. Missing cells travel as one number per row and
    step, so the log costs one aggregate before the deduplication and one after it.
    """
    if allowed is None:
        business = df.drop(order_by) if order_by else df
        allowed = [r["id"] for r in suggest_cleaning(business).select("id").collect()]
    allowed = set(allowed)
    rank = lambda action: ACTION_ORDER.get(action.split("::", 1)[0], 3)
    selected = sorted([a for a in dict.fromkeys(actions) if a in allowed], key=rank)
    visible = list(df.columns)
    counted = [c for c in visible if c != order_by]

    def counting(frame: DataFrame, step: int) -> DataFrame:
        missing = sum((quoted(c).isNull().cast("int") for c in counted), F.lit(0))
        return frame.withColumn(f"_missing_{step}", missing)

    def totals(frame: DataFrame) -> DataFrame:
        steps = [c for c in frame.columns if c.startswith("_missing_")]
        sums = [F.struct(F.lit(int(c[9:])).alias("step"), F.count("*").alias("rows"), F.coalesce(F.sum(c), F.lit(0)).alias("missing")) for c in steps]
        return frame.agg(F.array(*sums).alias("steps")).select(F.inline("steps"))

    result = counting(df, 0)
    counts: list[DataFrame] = []
    fills: dict[str, object] | None = None
    for step, action in enumerate(selected, 1):
        prefix, _, column = action.partition("::")
        if prefix == "normalize_blanks":
            result = normalize_blanks(result)
        elif prefix == "strip_text":
            result = strip_text(result)
        elif prefix == "harmonize_values":
            result = harmonise(result, column, saved(harmonisation_map(result, column)))
        elif prefix == "repair_sales_metrics":
            result = repair_sales(result)
        elif prefix == "convert_numeric":
            result = convert_numeric(result, [column])
        elif prefix == "convert_date":
            result = convert_date(result, [column])
        elif prefix == "drop_duplicates":
            counts.append(totals(result))
            result = drop_duplicates(result.select(*[quoted(c) for c in visible]), order_by)
        elif fills is None:
            # Fills touch one column each, so all their values come from the same state: saved, since it is read by the
            # sketch, the medians, the modes and the result.
            result = saved(result)
            chosen = [a.partition("::") for a in selected if rank(a) == ACTION_ORDER["fill_mode"]]
            fills = {
                **column_medians(result, {c: quoted(c) for kind, _, c in chosen if kind == "fill_median"}),
                **column_modes(result, [c for kind, _, c in chosen if kind == "fill_mode"]),
            }
        if rank(action) == ACTION_ORDER["fill_mode"]:
            result = fill_with(result, {column: fills.get(column)})
        result = counting(result, step)
    counts.append(totals(result))
    log = counts[0]
    for more in counts[1:]:
        log = log.unionAll(more)
    return result.select(*[quoted(c) for c in visible]), _cleaning_log(log, selected)


def _cleaning_log(counts: DataFrame, actions: list[str]) -> DataFrame:
    if not actions:
        return counts.sparkSession.createDataFrame([], LOG_SCHEMA)
    names = F.array(*[F.lit(a) for a in actions])
    # One row per applied action.
    order = Window.orderBy("step")
    log = counts.select(
        "step", F.get(names, F.col("step") - 1).alias("action"),
        F.lag("rows").over(order).alias("rows_before"), F.col("rows").alias("rows_after"),
        F.lag("missing").over(order).alias("missing_before"), F.col("missing").alias("missing_after"),
    )
    return log.where("step > 0")


# -- date columns ------------------------------------------------------------------------------------------


def date_columns(df: DataFrame) -> list[str]:
    """Columns that hold dates: typed ones, and text columns whose cells read as dates."""
    typed = {f.name for f in df.schema if is_date_type(f.dataType)}
    texts = text_columns(df)
    cheap = []
    for i, name in enumerate(texts):
        text = strip(quoted(name))
        filled = text != ""
        cheap += [
            F.count_if(filled).alias(f"n{i}"),
            F.count_if(text.rlike(PLAIN_NUMBER)).alias(f"num{i}"),
            F.count_if(text.rlike(TYPING_DATE_SHAPE)).alias(f"shape{i}"),
        ]
    seen = df.agg(*cheap).first() if cheap else None
    likely = [
        name for i, name in enumerate(texts)
        if seen[f"n{i}"] >= 3 and seen[f"num{i}"] < 0.8 * seen[f"n{i}"]
        and (roles.has_date_hint(name) or seen[f"shape{i}"] >= 0.75 * seen[f"n{i}"])
    ]
    # Only the columns that look like dates are parsed.
    if likely:
        parsed = df.agg(*[F.count(parse_local_date(quoted(c))).alias(f"d{i}") for i, c in enumerate(likely)]).first()
        for i, name in enumerate(likely):
            needed = 0.75 if roles.has_date_hint(name) else 0.95
            if parsed[i] >= needed * seen[f"n{texts.index(name)}"]:
                typed.add(name)
    return [c for c in df.columns if c in typed]


def restore_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return convert_date(df, date_columns(df) if columns is None else columns)
