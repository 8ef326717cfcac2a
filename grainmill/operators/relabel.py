"""Rename columns and relabel categories: planned first, applied whole or not at all."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.text import casefold, name_key, safe_spreadsheet_name, safe_spreadsheet_text
from grainmill.operators.counting import distinct_up_to
from grainmill.operators.roles import kind, quoted, text_columns

# Fixed value: most distinct values a column may have to be relabelled.
MAX_LABELS = 50


class RelabelError(ValueError):
    """A rename or a relabelling was refused; nothing changed."""


@dataclass
class RenamePlan:
    before: list[str]
    after: list[str]
    errors: list[str] = field(default_factory=list)

    @property
    def changes(self) -> list[tuple[int, str, str]]:
        return [(i, a, b) for i, (a, b) in enumerate(zip(self.before, self.after), 1) if a != b]


def plan_renames(columns: Sequence[str], renames: Mapping[str, str]) -> RenamePlan:
    """Check a whole set of renames; swaps are fine, names that differ only by case are not."""
    plan = RenamePlan(list(columns), [str(renames.get(c, c)).strip() for c in columns])
    repeated = [c for c, n in Counter(columns).items() if n > 1]
    plan.errors += [f"duplicate column: {c}" for c in repeated]
    plan.errors += [f"unknown column: {c}" for c in renames if c not in columns]
    plan.errors += [f"empty name for column {i}" for i, c in enumerate(plan.after, 1) if not c]
    keys = Counter(name_key(c) for c in plan.after if c)
    plan.errors += [f"name used twice: {key}" for key, n in keys.items() if n > 1]
    if plan.errors:
        plan.after = list(columns)
    return plan


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    plan = plan_renames(df.columns, renames)
    if plan.errors:
        raise RelabelError("; ".join(plan.errors))
    return df.toDF(*plan.after)


# -- categories ------------------------------------------------------------------------------------------


def _typed(value: object, data_type: T.DataType) -> Column:
    return F.lit(value).cast(data_type)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column).alias("source")).agg(F.count("*").alias("rows"))


def relabel_report(df: DataFrame, column: str, replacements: DataFrame) -> DataFrame:
    """One row per category: source, target, rows, requested, known, merged.

    `replacements` has source and target of the column's own type; NULL matches NULL. `known` is
    false for a requested source that does not occur. `merged` marks categories that share a target.
    """
    counts = category_counts(df, column).withColumn("known", F.lit(True))
    asked = replacements.select(F.col("source").alias("_s"), F.col("target").alias("_t")).withColumn("requested", F.lit(True))
    both = counts.join(asked, F.col("source").eqNullSafe(F.col("_s")), "full")
    rows = both.select(
        F.when(F.col("known"), F.col("source")).otherwise(F.col("_s")).alias("source"),
        F.when(F.col("requested"), F.col("_t")).otherwise(F.col("source")).alias("target"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("requested", F.lit(False)).alias("requested"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )
    shared = rows.where("known").groupBy(F.col("target").alias("_target")).agg(F.count("*").alias("sources"))
    out = rows.join(shared, F.col("target").eqNullSafe(F.col("_target")), "left")
    merged = F.col("known") & (F.coalesce("sources", F.lit(0)) > 1)
    return out.select("source", "target", "rows", "requested", "known", merged.alias("merged"))


def relabel(df: DataFrame, column: str, replacements: DataFrame, allow_merge: bool = False) -> DataFrame:
    """Replace categories of one column; refused for unknown or repeated sources and, unless
    allowed, for merges."""
    report = relabel_report(df, column, replacements)
    facts = report.agg(
        F.count_if(~F.col("known")).alias("unknown"), F.count_if("merged").alias("merged"),
    ).first()
    repeated = replacements.groupBy("source").count().where("count > 1").limit(1).count()
    if facts["unknown"] or repeated:
        raise RelabelError("a requested category does not exist or is asked twice")
    if facts["merged"] and not allow_merge:
        raise RelabelError("categories would be merged")
    return relabelled(df, column, replacements)


def relabelled(df: DataFrame, column: str, replacements: DataFrame) -> DataFrame:
    """Apply source to target rows without checks. The list of labels is a small side by nature;
    Spark decides from its size whether to broadcast it."""
    asked = replacements.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.lit(True).alias("_hit"))
    joined = df.join(asked, quoted(column).eqNullSafe(F.col("_s")), "left")
    new = F.when(F.col("_hit"), F.col("_t")).otherwise(quoted(column))
    return joined.select(*[new.alias(c) if c == column else quoted(c) for c in df.columns])


def relabel_eligibility(df: DataFrame) -> DataFrame:
    """Per column: can_relabel and a reason code. Only text columns with 2 to 50 values qualify."""
    texts = text_columns(df)
    small = distinct_up_to(df, texts, MAX_LABELS)
    rows = []
    for f in df.schema:
        n = small.get(f.name, MAX_LABELS + 1)
        reason = "not_text" if kind(f.dataType) != "texte" else "too_many" if n > MAX_LABELS else "too_few" if n < 2 else "ok"
        rows.append((f.name, reason == "ok", reason))
    return df.sparkSession.createDataFrame(rows, "column_name string, can_relabel boolean, reason string")


def category_listing(df: DataFrame, column: str, labels: DataFrame | None = None, top: int = MAX_LABELS) -> DataFrame:
    """Most frequent categories with their display label: source, display, rows."""
    counts = category_counts(df.where(quoted(column).isNotNull()), column).select(
        F.col("source").cast("string").alias("source"), "rows"
    )
    best = counts.orderBy(F.desc("rows"), "source").limit(top)
    if labels is None:
        return best.select("source", F.col("source").alias("display"), "rows")
    named = labels.select(F.col("source").alias("_s"), F.col("display").alias("_d"))
    return best.join(named, F.col("source") == F.col("_s"), "left").select("source", F.coalesce("_d", "source").alias("display"), "rows")


def draft_collisions(listing: DataFrame) -> DataFrame:
    """One row for a draft of labels: labels, affected_rows, has_collision (same label but for case)."""
    keyed = listing.groupBy(casefold(F.col("display")).alias("key")).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return keyed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), F.coalesce(F.sum("rows"), F.lit(0)).alias("affected_rows"),
        F.coalesce(F.max(F.col("n") > 1), F.lit(False)).alias("has_collision"),
    )


def stale_preview(submitted: DataFrame, current: DataFrame) -> DataFrame:
    """Categories submitted but gone, and present but not submitted: source, problem."""
    gone = submitted.select("source").join(current.select("source"), "source", "left_anti").withColumn("problem", F.lit("gone"))
    new = current.select("source").join(submitted.select("source"), "source", "left_anti").withColumn("problem", F.lit("not_submitted"))
    return gone.unionByName(new)


# -- display view and export --------------------------------------------------------------------------------


def label_maps(dictionary: DataFrame) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Display names and value labels of a dictionary of (column, display_name, source, display).

    A dictionary is written by people, at most 50 labels per column.
    """
    names: dict[str, str] = {}
    values: dict[str, dict[str, str]] = {}
    for row in dictionary.collect():
        if row["display_name"]:
            names[row["column"]] = row["display_name"]
        if row["source"] is not None and row["display"]:
            values.setdefault(row["column"], {})[row["source"]] = row["display"]
    return names, values


def label_map_rows(dictionary: DataFrame) -> DataFrame:
    """The maps used by an export as rows: kind, column_name, source, display."""
    names = dictionary.select(
        F.lit("column").alias("kind"), F.col("column").alias("column_name"), F.col("column").alias("source"),
        F.coalesce(F.nullif("display_name", F.lit("")), F.col("column")).alias("display"),
    ).distinct()
    values = dictionary.where("source is not null and display <> ''").select(
        F.lit("value").alias("kind"), F.col("column").alias("column_name"), "source", "display"
    )
    return names.unionByName(values)


def display_view(df: DataFrame, names: Mapping[str, str], values: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Relabelled values and column titles; the source frame is unchanged."""
    columns = []
    for c in df.columns:
        shown = quoted(c)
        if values.get(c):
            table = F.create_map(*[F.lit(x) for pair in values[c].items() for x in pair])
            shown = F.coalesce(F.try_element_at(table, shown.cast("string")), shown.cast("string"))
        columns.append(shown.alias(c))
    plan = plan_renames(df.columns, {c: n for c, n in names.items() if c in df.columns})
    if plan.errors:
        raise RelabelError("; ".join(plan.errors))
    return df.select(*columns).toDF(*plan.after)


def safe_export(df: DataFrame) -> DataFrame:
    """Neutralise spreadsheet formulas in text cells and column names."""
    texts = set(text_columns(df))
    return df.select(*[
        (safe_spreadsheet_text(quoted(c)) if c in texts else quoted(c)).alias(safe_spreadsheet_name(c)) for c in df.columns
    ])


def typed_equal(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """Category equality: missing equals missing, text only equals text, booleans only booleans."""
    family = lambda t: "text" if isinstance(t, T.StringType) else "bool" if isinstance(t, T.BooleanType) else "number"
    if family(left_type) != family(right_type):
        return left.isNull() & right.isNull()
    return left.eqNullSafe(right)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON: missing and NaN as null, ISO dates, other types as text."""
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, (T.DateType, T.DecimalType, T.BinaryType)):
            c = c.cast("string")
        cells.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
