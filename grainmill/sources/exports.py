"""CSV and JSON exports, written in parallel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from grainmill.operators.relabel import display_view, safe_export


def export_frame(df: DataFrame, names: Mapping[str, str], values: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Relabelled and formula-safe, as text: what a CSV export holds."""
    shown = safe_export(display_view(df, names, values))
    return shown.select(*[shown[f"`{c}`"].cast("string").alias(c) for c in shown.columns])


def write_csv(df: DataFrame, path: str, names: Mapping[str, str] | None = None, values: Mapping | None = None) -> None:
    """UTF-8 files with a header each, without a byte order mark."""
    export_frame(df, names or {}, values or {}).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, names: Mapping[str, str] | None = None, values: Mapping | None = None) -> None:
    """One record per line with ISO dates; JSON needs no formula escaping."""
    shown = display_view(df, names or {}, values or {})
    shown.write.mode("errorifexists").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").option("ignoreNullFields", False).json(path)
