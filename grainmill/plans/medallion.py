"""Bronze, contract, checks, Silver and Gold as one job with a run record."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from grainmill.operators.cleaning import restore_dates
from grainmill.operators.contract import (
    CHECK_SCHEMA, ColumnRule, contract_frame, contract_from, infer_contract, run_checks, summarize_checks,
)
from grainmill.operators.gold import gold_tables
from grainmill.sources.files import fingerprint, read_bronze_text, read_csv
from grainmill.sources.layers import AUDIT_COLUMNS, Project, utc_now, with_row_numbers


def ingest_bronze(project: Project, path: str, multi_line: bool = False) -> DataFrame:
    """Publish the raw rows as text with audit columns."""
    raw = read_bronze_text(project.spark, path, multi_line)
    staging = f"{project.path}/staging/{uuid.uuid4().hex[:12]}"
    return project.save(with_row_numbers(raw, staging, utc_now()), "bronze")


def publish_contract(project: Project, contract: list[ColumnRule]) -> None:
    project.save(contract_frame(project.spark, contract), "contract")


def read_contract(project: Project) -> list[ColumnRule]:
    location = project.locations().get("contract")
    return contract_from(project.spark.read.parquet(location)) if location else []


def publish_gold(project: Project, silver: DataFrame, stored: bool = False) -> dict[str, DataFrame]:
    """Replace every Gold table in one pointer change; stale names disappear with it. The tables read Silver several times, so a
    frame that is not `stored` as a table is written once."""
    if not stored:
        staging = f"{project.path}/staging/{uuid.uuid4().hex[:12]}"
        silver.write.mode("errorifexists").parquet(staging)
        silver = project.spark.read.schema(silver.schema).parquet(staging)
    tables = gold_tables(silver, stored=True)
    locations = {name: project.write(df, name) for name, df in tables.items()}
    stale = {name: None for name in project.locations() if name.startswith("gold_") and name not in tables}
    project.publish({**locations, **stale})
    return {name: project.spark.read.parquet(path) for name, path in locations.items()}


def refresh(
    project: Project, silver: DataFrame, as_of: dt.date, trigger: str, source_path: str | None = None,
    actions: Sequence[str] = (),
) -> dict:
    """Publish a Silver frame over the current Bronze: contract, checks, Silver, Gold, run record.

    The contract is inferred from Silver and evaluated on both layers. Running it again on the same
    frame publishes the same tables.
    """
    started, stages = utc_now(), []

    def stage(name: str, output: str, work):
        begin = time.perf_counter()
        value, rows_in, rows_out = work()
        stages.append({
            "name": name, "status": "success", "duration_ms": round((time.perf_counter() - begin) * 1000, 1),
            "rows_in": rows_in, "rows_out": rows_out, "output": output,
        })
        return value

    bronze = project.read("bronze").drop(*AUDIT_COLUMNS)
    bronze_rows = bronze.count()

    def transform():
        # Written first, so that the contract and the checks read the stored table.
        stored = project.save(silver, "silver")
        return stored, bronze_rows, stored.count()

    typed = stage("transform_silver", "silver", transform)
    silver_rows = stages[-1]["rows_out"]

    def validate():
        contract = infer_contract(typed)
        publish_contract(project, contract)
        before = project.spark.createDataFrame(run_checks(bronze, contract, as_of).collect(), CHECK_SCHEMA)
        after = project.spark.createDataFrame(run_checks(typed, contract, as_of).collect(), CHECK_SCHEMA)
        return (before, after), bronze_rows, bronze_rows

    before, after = stage("validate_contract", "contract", validate)

    def aggregate():
        tables = publish_gold(project, typed, stored=True)
        shapes = [{"name": n, "rows": df.count(), "columns": df.columns} for n, df in tables.items()]
        return shapes, silver_rows, sum(s["rows"] for s in shapes)

    gold = stage("publish_gold", "gold", aggregate)
    # Checks are a few rows per column, so the record carries them.
    plain = lambda df: [r.asDict() for r in df.collect()]
    quality = lambda df: summarize_checks(df).first().asDict()
    source = fingerprint(project.spark, source_path).first().asDict() if source_path else {"file": "bronze", "sha256": None, "bytes": None}
    run = {
        "run_id": uuid.uuid4().hex[:12], "started_at": started, "finished_at": utc_now(), "trigger": trigger,
        "status": "success", "input": source, "stages": stages,
        "quality": {"bronze": quality(before), "silver": quality(after)},
        "checks": {"bronze": plain(before), "silver": plain(after)},
        "rows": {"bronze": bronze_rows, "silver": silver_rows}, "gold_tables": gold, "actions": list(actions),
    }
    project.append_run(run)
    return run


def run(project: Project, path: str, as_of: dt.date, multi_line: bool = False) -> dict:
    """Import a file: Bronze, then a first Silver that is the typed file itself."""
    ingest_bronze(project, path, multi_line)
    silver = restore_dates(read_csv(project.spark, path, multi_line=multi_line))
    return refresh(project, silver, as_of, "import", source_path=path)

