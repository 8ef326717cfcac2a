"""Business vocabulary in texts: concepts, columns, calculations and chart specifications.

The phrase lists are fixed and short, so each text is tested against them in place: one
pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.text import has_phrase, normalize_name, padded, strip
from grainmill.operators.charts import ChartError, grouped_chart
from grainmill.operators.roles import quoted


def _first_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """First phrase found, longest in words first, as it is written in the list."""
    ordered = sorted(phrases, key=lambda p: -len(normalize_name(p).split()))
    return F.coalesce(*[F.when(has_phrase(text, p), F.lit(p)) for p in ordered])


def concept_columns(text: Column) -> dict[str, Column]:
    return {concept: _first_phrase(text, phrases) for concept, phrases in V.BUSINESS_CONCEPTS.items()}


def tag_concepts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, concept, matched_term: one row per concept found in a text."""
    words = df.select(*[quoted(k) for k in keys], padded(quoted(text)).alias("_words"))
    tags = F.array(*[
        F.struct(F.lit(concept).alias("concept"), term.alias("matched_term"))
        for concept, term in concept_columns(F.col("_words")).items()
    ])
    return words.select(*keys, F.inline(F.filter(tags, lambda t: t["matched_term"].isNotNull())))


def column_concepts(name: str, kind: str | None = None) -> set[str]:
    """Concepts a column name stands for; a date column only ever means a date."""
    if kind == "date":
        return {"date"}
    words = f" {normalize_name(name)} "
    return {
        concept for concept, phrases in V.BUSINESS_CONCEPTS.items()
        if any(f" {normalize_name(p)} " in words for p in phrases)
    }


def _find(words: Column, confidence: float, term: str, grouping: bool) -> Column:
    """struct(confidence, matched_term, grouped) when the term is in the text. Each term is a
    constant here, so the test for "by <term>" is too."""
    grouped = F.lit(False)
    for marker in V.GROUPING_MARKERS if grouping else []:
        grouped = grouped | has_phrase(words, f"{marker} {term}")
    found = F.struct(F.lit(confidence).alias("confidence"), F.lit(term).alias("matched_term"), grouped.alias("grouped"))
    return F.when(has_phrase(words, term), found)


def _concept_find(words: Column, phrases: Iterable[str], grouping: bool) -> Column:
    ordered = sorted(phrases, key=lambda p: -len(normalize_name(p).split()))
    return F.coalesce(*[_find(words, 0.85, p, grouping) for p in ordered])


def resolve_columns(
    df: DataFrame, keys: Sequence[str], text: str, catalogue: Sequence[tuple[str, str]],
    aliases: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """keys, column_name, kind, confidence, matched_term, rank for each column a text means.

    `catalogue` lists (column, kind). Its own name counts 1.0, an alias 0.95, a shared concept 0.85.
    """
    # The outer form keeps Spark from filtering texts below by repeating every phrase test.
    found = _resolved(df, keys, text, catalogue, aliases).select(*keys, F.posexplode_outer("matches").alias("rank", "m"))
    return found.where("m is not null").select(
        *keys, "m.column_name", "m.kind", "m.confidence", "m.matched_term", (F.col("rank") + 1).alias("rank")
    )


def _resolved(df, keys, text, catalogue, aliases, grouping=False) -> DataFrame:
    """keys, _words and `matches` sorted by confidence then catalogue position."""
    by_name = {normalize_name(name): list(terms) for name, terms in (aliases or {}).items()}
    words = F.col("_words")
    needed = sorted({c for name, kind in catalogue for c in column_concepts(name, kind)})
    base = df.select(*[quoted(k) for k in keys], padded(quoted(text)).alias("_words"))
    base = base.select("*", *[_concept_find(words, V.BUSINESS_CONCEPTS[c], grouping).alias(f"_c_{c}") for c in needed])
    matches = []
    for i, (name, kind) in enumerate(catalogue):
        terms = [t for t in by_name.get(normalize_name(name), []) if normalize_name(t)]
        finds = [_find(words, 1.0, name, grouping), *[_find(words, 0.95, t, grouping) for t in terms]]
        finds += [F.col(f"_c_{c}") for c in sorted(column_concepts(name, kind))]
        matches.append(F.coalesce(*finds).alias(f"_m_{i}"))
    base = base.select(*keys, "_words", *matches)
    cells = []
    for i, (name, kind) in enumerate(catalogue):
        m = F.col(f"_m_{i}")
        cells.append(F.when(m.isNotNull(), F.struct(
            (-m["confidence"]).alias("order"), F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("kind"),
            m["confidence"].alias("confidence"), m["matched_term"].alias("matched_term"), m["grouped"].alias("grouped"),
        )))
    return base.select(*keys, "_words", F.array_sort(F.array_compact(F.array(*cells))).alias("matches"))


def _by_list(words: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    def any_of(phrases: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | has_phrase(words, p)
        return out

    return F.coalesce(*[F.when(any_of(phrases), F.lit(name)) for name, phrases in groups.items()])


def asked_aggregation(words: Column) -> Column:
    """mean, median, sum or count when the text asks for it, else NULL."""
    return _by_list(words, V.AGGREGATION_PHRASES)


def asked_chart_type(words: Column) -> Column:
    return F.coalesce(_by_list(words, V.CHART_PHRASES), F.lit("auto"))


def is_grouped(words: Column) -> Column:
    return _by_list(words, {"grouped": V.GROUPING_MARKERS}).isNotNull()


def chart_specs(
    df: DataFrame, keys: Sequence[str], text: str, catalogue: Sequence[tuple[str, str]],
    aliases: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """keys, dimension, measure, aggregation, chart_type for each text that names a column.

    The dimension is the column after "by", else the first date or category named (the date when
    a trend is asked), else the first date or category of the table. The measure is the
    first other number named.
    """
    kinds = dict(catalogue)
    base = _resolved(df, keys, text, catalogue, aliases, grouping=True)
    base = base.withColumns({"asked": asked_aggregation(F.col("_words")), "chart": asked_chart_type(F.col("_words"))})

    def first(test) -> Column:
        return F.get(F.filter("matches", test), F.lit(0))["column_name"]

    trend = F.col("chart") == "line"
    named_date = first(lambda m: m["kind"] == "date")
    named = first(lambda m: m["kind"] != "number")
    explicit = first(lambda m: m["grouped"])
    base = base.withColumn("dim", F.coalesce(explicit, F.when(trend, named_date), named))
    number = F.get(F.filter("matches", lambda m: (m["kind"] == "number") & ~m["column_name"].eqNullSafe(F.col("dim"))), F.lit(0))
    base = base.withColumn("number", number["column_name"])
    aggregation = F.coalesce("asked", F.when(F.col("number").isNotNull(), "sum").otherwise("count"))
    base = base.withColumn("agg", aggregation)
    base = base.withColumn("number", F.when(F.col("agg") != "count", F.col("number")))
    first_date = next((c for c, k in catalogue if k == "date"), None)
    first_group = next((c for c, k in catalogue if k != "number"), None)
    needs = F.col("dim").isNull() & F.col("number").isNotNull()
    auto = F.coalesce(F.when(needs & trend, F.lit(first_date)), F.when(needs, F.lit(first_group)))
    alone = needs & auto.isNull()
    base = base.withColumns({"auto": auto, "alone": alone})
    dimension = F.coalesce("dim", "auto", F.when(F.col("alone"), F.col("number")))
    # Only numbers named and nothing to measure: count rows of the first one named.
    fallback = dimension.isNull()
    final = F.coalesce(dimension, F.get("matches", F.lit(0))["column_name"])
    no_measure = F.col("alone") | fallback | F.col("number").isNull()
    kind_map = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    base = base.withColumns({"dimension": final, "no_measure": no_measure})
    chart = F.when(F.col("alone"), "bar").otherwise(F.col("chart"))
    chart = F.when((chart == "auto") & (F.try_element_at(kind_map, F.col("dimension")) == "date"), "line").otherwise(chart)
    spec = F.struct(
        F.col("dimension"), F.when(~F.col("no_measure"), F.col("number")).alias("measure"),
        F.when(F.col("alone") | fallback, "count").otherwise(F.col("agg")).alias("aggregation"), chart.alias("chart_type"),
    )
    return base.select(*keys, F.inline_outer(F.array(spec))).where("dimension is not null")


def charts_for_texts(data: DataFrame, specs: DataFrame) -> DataFrame:
    """Chart points of every distinct specification: dimension, measure, aggregation, ord, label, value.

    There are at most as many specifications as pairs of catalogue columns and calculations.
    """
    out = None
    distinct = specs.select("dimension", "measure", "aggregation").distinct()
    for row in distinct.orderBy("dimension", "measure", "aggregation").collect():
        try:
            points = grouped_chart(data, row["dimension"], row["measure"], row["aggregation"])
        except ChartError:
            continue
        points = points.select(
            F.lit(row["dimension"]).alias("dimension"), F.lit(row["measure"]).cast("string").alias("measure"),
            F.lit(row["aggregation"]).alias("aggregation"), "ord", "label", "value",
        )
        out = points if out is None else out.unionByName(points)
    if out is None:
        raise ChartError("no text gives a chart")
    return out


def dictionary_aliases(entries: DataFrame) -> DataFrame:
    """column, term rows from display names, labels and `,` or `;` separated synonyms."""
    split = F.split(F.translate(F.coalesce("synonyms", F.lit("")), ";", ","), ",")
    terms = F.concat(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("display_name", "label_fr", "label_ar")]), split)
    clean = F.filter(F.transform(terms, strip), lambda t: t != "")
    return entries.select(strip(F.col("column")).alias("column"), F.explode(clean).alias("term")).where(F.col("column") != "")
