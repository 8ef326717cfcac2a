"""Table and column profiles, quality score, summaries. One aggregate pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import vocabulary as V
from grainmill.functions.numbers import as_number, cast_number, display_number, round_even
from grainmill.functions.text import is_blank, is_sensitive_name, normalize_name, strip
from grainmill.operators.counting import column_medians, distinct_up_to, duplicate_rows
from grainmill.operators.roles import kind, numeric_columns, quoted, snake, text_columns


def _distinct(c: Column, exact: bool) -> Column:
    return F.count_distinct(c) if exact else F.approx_count_distinct(c)


def _column_counts(df: DataFrame, exact: bool) -> DataFrame:
    """One row: rows, and per column i missing mi, blank bi, distinct ui."""
    aggregates = [F.count("*").alias("rows")]
    for i, field in enumerate(df.schema):
        c = quoted(field.name)
        blank = F.count_if(is_blank(c)) if isinstance(field.dataType, T.StringType) else F.lit(0).cast("bigint")
        aggregates += [
            F.count_if(c.isNull()).alias(f"m{i}"),
            blank.alias(f"b{i}"),
            _distinct(c, exact).alias(f"u{i}"),
        ]
    return df.agg(*aggregates)


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: name, kind, missing, missing_pct, blank, distinct_values."""
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(kind(field.dataType)).alias("kind"),
            F.col(f"m{i}").alias("missing"),
            F.coalesce(round_even(F.try_divide(F.col(f"m{i}") * 100.0, F.col("rows")), 1), F.lit(0.0)).alias("missing_pct"),
            F.col(f"b{i}").alias("blank"),
            F.col(f"u{i}").alias("distinct_values"),
        )
        for i, field in enumerate(df.schema)
    ]
    return _column_counts(df, exact).select(F.inline(F.array(*cells)))


def quality_score(missing: Column, blank: Column, duplicates: Column, constant: Column, rows: Column, columns: int) -> Column:
    cells = F.greatest(rows * columns, F.lit(1))
    loss = (
        (missing + blank) / cells * 45
        + duplicates / F.greatest(rows, F.lit(1)) * 30
        + constant / F.lit(max(columns, 1)) * 10
    )
    return F.greatest(F.lit(0), F.rint(F.lit(100.0) - loss)).cast("int")


def table_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: sizes, missing and blank cells, duplicate rows, constant columns, score."""
    n = len(df.columns)
    total = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(n)), F.lit(0).cast("bigint"))
    constant = sum(
        ((F.col(f"u{i}") <= 1) & (F.col("rows") > 1)).cast("bigint") for i in range(n)
    ) + F.lit(0).cast("bigint")
    base = _column_counts(df, exact).select(
        "rows",
        F.lit(n).alias("columns_count"),
        total("m").alias("missing"),
        total("b").alias("blank"),
        duplicate_rows(df).alias("duplicates"),
        constant.alias("constant_columns"),
    )
    score = quality_score(
        F.col("missing"), F.col("blank"), F.col("duplicates"), F.col("constant_columns"), F.col("rows"), n
    )
    return base.withColumn("quality_score", score)


def column_examples(df: DataFrame, order_by: Sequence[str], count: int = 3) -> DataFrame:
    """First non-missing values of each column in row order: column_name, ord, example.

    The first thousand rows usually settle every column. Only a column still short of
    examples gets its own top-k over the whole table.
    """
    keys = [quoted(k) for k in order_by]
    fields = [f for f in df.schema if f.name not in order_by]
    head = df.orderBy(*keys).limit(1000)
    seen = head.agg(*[F.count(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(fields)], F.count("*").alias("n")).first()
    whole_table = seen["n"] < 1000
    parts = []
    for i, field in enumerate(fields):
        c = quoted(field.name)
        source = head if whole_table or seen[i] >= count else df
        first = source.where(c.isNotNull()).orderBy(*keys).limit(count)
        # limit() leaves at most `count` rows here, so this window is bounded.
        first = first.select(F.lit(field.name).alias("column_name"), F.monotonically_increasing_id().alias("i"), c.cast("string").alias("example"))
        parts.append(first)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("column_name", (F.col("i") + 1).alias("ord"), "example")


def gold_column_profile(df: DataFrame, exact: bool = True, stored: bool = False) -> DataFrame:
    """Per column: data_type, non_null, completeness_pct, distinct_values.

    Exact distinct counts of several columns in one aggregate expand every row per column, all columns wide. A frame that is
    `stored` in columns is grouped by one column at a time instead, each of which reads its own column only.
    """
    if exact and stored and df.columns:
        return _stored_column_profile(df)
    aggregates = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        aggregates += [F.count(quoted(name)).alias(f"n{i}"), _distinct(quoted(name), exact).alias(f"u{i}")]
    cells = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(kind(f.dataType)).alias("data_type"),
            F.col(f"n{i}").alias("non_null"),
            F.coalesce(round_even(F.try_divide(F.col(f"n{i}") * 100.0, F.col("rows")), 1), F.lit(0.0)).alias("completeness_pct"),
            F.col(f"u{i}").alias("distinct_values"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def _stored_column_profile(df: DataFrame) -> DataFrame:
    parts = None
    for f in df.schema:
        groups = df.groupBy(quoted(f.name).alias("value")).agg(F.count("*").alias("n"))
        counts = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("distinct_values"),
        )
        part = counts.select(
            F.lit(f.name).alias("column_name"), F.lit(kind(f.dataType)).alias("data_type"), "non_null",
            F.coalesce(round_even(F.try_divide(F.col("non_null") * 100.0, F.col("rows")), 1), F.lit(0.0)).alias("completeness_pct"),
            "distinct_values",
        )
        parts = part if parts is None else parts.unionAll(part)
    return parts


def semantic_manifest(df: DataFrame) -> DataFrame:
    """Per column: name, normalised name, kind, whether a missing value was observed."""
    aggregates = [F.count("*").alias("row_count")]
    aggregates += [F.max(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    cells = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(snake(f.name)).alias("normalized_name"),
            F.lit(kind(f.dataType)).alias("type"),
            F.coalesce(F.col(f"n{i}"), F.lit(False)).alias("nullable"),
            F.col("row_count"),
        )
        for i, f in enumerate(df.schema)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


# -- privacy-safe summary ---------------------------------------------------------------------


def _castable(df: DataFrame, name: str) -> Column:
    """The column as double without locale parsing."""
    data_type = df.schema[name].dataType
    text = isinstance(data_type, T.StringType)
    return cast_number(strip(quoted(name))) if text else as_number(quoted(name), data_type)


def numeric_summary(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Statistics of the columns that are numeric for at least 80 % of rows (3 at least).

    The sample standard deviation and the median are exact; medians come from column_medians().
    """
    fields = [f for f in df.schema.fields[:max_columns] if kind(f.dataType) != "date"]
    values = {f"v{i}": _castable(df, f.name) for i, f in enumerate(fields)}
    rows = df.select(*[v.alias(k) for k, v in values.items()])
    counts = rows.agg(F.count("*").alias("rows"), *[F.count(k).alias(k) for k in values]).first()
    enough = max(3, int(counts["rows"] * 0.8))
    kept = [(k, f.name) for k, f in zip(values, fields) if counts[k] and counts[k] >= enough]
    if not kept:
        return df.sparkSession.createDataFrame([], NUMERIC_SUMMARY)
    medians = column_medians(rows, {k: F.col(k) for k, _ in kept})
    aggregates = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count(k).alias("count"),
            round_even(F.avg(k), 4).alias("mean"),
            round_even(F.lit(medians[k]), 4).alias("median"),
            round_even(F.min(k), 4).alias("minimum"),
            round_even(F.max(k), 4).alias("maximum"),
            round_even(F.stddev_samp(k), 4).alias("standard_deviation"),
        ).alias(k)
        for k, name in kept
    ]
    return rows.agg(*aggregates).select(F.inline(F.array(*[F.col(k) for k, _ in kept])))


NUMERIC_SUMMARY = (
    "column_name string, count bigint, mean double, median double, minimum double, maximum double, "
    "standard_deviation double"
)


def value_distributions(df: DataFrame, max_columns: int | None = None, max_values: int = 20, top: int = 10) -> DataFrame:
    """Ten most frequent values of each column with 2..20 of them; sensitive columns never leave."""
    names = [c for c in df.columns[:max_columns] if not is_sensitive_name(c)]
    small = distinct_up_to(df, names, max_values)
    kept = [c for c in names if 1 < small.get(c, 0) <= max_values]
    if not kept:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count bigint")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.coalesce(quoted(c).cast("string"), F.lit(V.MISSING_LABEL)).alias("value"))
            for c in kept
        ]
    )
    counts = df.select(F.inline(cells)).groupBy("column_name", "value").agg(F.count("*").alias("count"))
    # At most 21 values per column reach this window.
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.select("column_name", F.substring("value", 1, 80).alias("value"), "count")


def correlations(df: DataFrame, max_columns: int | None = None, top: int = 5) -> DataFrame:
    """Strongest Pearson correlations over rows where both columns are present."""
    names = numeric_columns(df)[:max_columns]
    rows = df.select(*[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, value double")

    def pearson(i: int, j: int) -> Column:
        a = F.when(F.col(f"v{j}").isNotNull(), F.col(f"v{i}"))
        b = F.when(F.col(f"v{i}").isNotNull(), F.col(f"v{j}"))
        return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))

    wide = rows.agg(*[pearson(i, j).alias(f"r{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), round_even(F.col(f"r{i}_{j}"), 3).alias("value"))
        for i, j in pairs
    ]
    long = wide.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    return long.orderBy(F.abs("value").desc(), "left", "right").limit(top)


# -- answers ------------------------------------------------------------------------------------


def missing_ranking(df: DataFrame, top: int = 5) -> DataFrame:
    counts = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)]
    long = counts.select(F.inline(F.array(*cells))).where("missing > 0")
    return long.orderBy(F.desc("missing"), "column_name").limit(top)


def table_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Score, missing cells and duplicates, two numeric columns, the top value of one text column."""
    facts = {"quality_score": F.col("quality_score"), "missing_or_blank": F.col("missing") + F.col("blank"), "duplicates": F.col("duplicates")}
    profile = table_profile(df, exact).select(F.inline(F.array(*[
        F.struct(F.lit("table").alias("item"), F.lit(m).alias("measure"), v.cast("string").alias("value")) for m, v in facts.items()
    ])))
    text = lambda c: F.format_string("%.2f", display_number(c))
    parts = []
    for name in numeric_columns(df)[:2]:
        c = quoted(name).cast("double")
        row = df.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")).where("mean is not null")
        parts.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("item"), F.lit(m).alias("measure"), text(F.col(m)).alias("value")) for m in ("mean", "min", "max")
        ]))))
    candidates = text_columns(df)
    small = distinct_up_to(df, candidates, 50)
    chosen = next((c for c in candidates if 1 <= small.get(c, 0) <= 50), None)
    if chosen:
        top = value_frequency(df.where(quoted(chosen).isNotNull()), chosen, 1)
        parts.append(top.select(F.lit(chosen).alias("item"), F.col("label").alias("measure"), F.col("rows").cast("string").alias("value")))
    for part in parts:
        profile = profile.unionByName(part)
    return profile


def structural_problems(df: DataFrame, exact: bool = True) -> DataFrame:
    """Empty cells, duplicate rows and columns that never vary, one row per problem found."""
    counts = _column_counts(df, exact)
    n = len(df.columns)
    empty = sum((F.col(f"m{i}") + F.col(f"b{i}") for i in range(n)), F.lit(0).cast("bigint"))
    problems = [("empty_cells", "", empty), ("duplicate_rows", "", duplicate_rows(df))]
    problems += [("constant_column", c, (F.col(f"u{i}") <= 1).cast("bigint")) for i, c in enumerate(df.columns)]
    cells = [F.struct(F.lit(p).alias("problem"), F.lit(c).alias("column_name"), n.alias("count")) for p, c, n in problems]
    return counts.select(F.inline(F.array(*cells))).where("count > 0")


def value_frequency(df: DataFrame, column: str, top: int) -> DataFrame:
    """Most frequent values with a label for the missing ones: label, rows."""
    label = F.coalesce(quoted(column).cast("string"), F.lit(V.MISSING_LABEL))
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "label").limit(top)


def distinct_entities(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    return df.agg(_distinct(quoted(column), exact).alias("distinct_values"))


def scalar_answer(df: DataFrame, column: str) -> DataFrame:
    """Mean, sum, max and min over the cells that cast to a number, with their count."""
    c = _castable(df, column)
    return df.agg(
        F.count(c).alias("used_values"),
        display_number(F.avg(c)).alias("mean"),
        display_number(F.sum(c)).alias("sum"),
        display_number(F.max(c)).alias("maximum"),
        display_number(F.min(c)).alias("minimum"),
    )


def entity_column(columns: Sequence[str], question: str) -> str | None:
    """Column counted by a "how many ..." question, by entity words then by column words."""
    text = normalize_name(question)
    if not any(marker in text for marker in V.COUNT_MARKERS):
        return None
    asked = set(text.split())
    ranks = []
    for place, column in enumerate(columns):
        key = snake(column)
        parts = key.split("_")
        for group, terms in enumerate(V.ENTITY_WORDS.values()):
            for order, term in enumerate(terms if asked & set(terms) else ()):
                whole = [f"{term}_id", f"{term}_name", term, f"{term}s"]
                if key in whole:
                    ranks.append((0, group, order, 0, whole.index(key), 0, place))
                elif term in parts:
                    ranks.append((0, group, order, 1, int("_id" not in key), len(column), place))
        if asked & {part for part in parts if len(part) > 2}:
            ranks.append((1, 0, 0, 0, 0, 0, place))
    return columns[min(ranks)[-1]] if ranks else None
