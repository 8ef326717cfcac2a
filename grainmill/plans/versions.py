"""Reversible fix batches: apply, undo, reset, and recipes that replay a batch elsewhere."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from grainmill.operators.cleaning import apply_cleaning
from grainmill.plans.medallion import refresh
from grainmill.sources.layers import Project, utc_now

# Stands in the journal for the withdrawal of all batches before it.
RESET = "reset"
BATCH_SCHEMA = (
    "batch_id string, applied_at string, label string, actions array<string>, before string, after string, "
    "log array<struct<step:int,action:string,rows_before:bigint,rows_after:bigint,missing_before:bigint,missing_after:bigint>>, "
    "undone boolean"
)
RECIPE_SCHEMA = "recipe_id string, created_at string, name string, actions array<string>"


def _journal(project: Project, name: str, schema: str) -> DataFrame:
    try:
        return project.spark.read.schema(schema).json(f"{project.path}/{name}")
    except AnalysisException:
        return project.spark.createDataFrame([], schema)


def batches(project: Project) -> DataFrame:
    """Batches still in force, oldest first: applied after the last reset and not undone."""
    rows = _journal(project, "batches", BATCH_SCHEMA)
    undone = rows.where("undone").select("batch_id")
    last_reset = rows.where(F.col("batch_id") == RESET).agg(F.max("applied_at").alias("reset_at"))
    live = rows.where("not undone").join(undone, "batch_id", "left_anti").crossJoin(F.broadcast(last_reset))
    return live.where(F.col("reset_at").isNull() | (F.col("applied_at") > F.col("reset_at"))).drop("reset_at").orderBy("applied_at")


def cleaning_log(project: Project) -> DataFrame:
    """Log rows of the batches in force."""
    return batches(project).select("batch_id", "label", "applied_at", F.inline("log"))


def current(project: Project, raw: DataFrame) -> DataFrame:
    """The corrected version when there is one, else the raw table."""
    location = project.locations().get("version")
    return project.spark.read.parquet(location) if location else raw


def apply_batch(
    project: Project, raw: DataFrame, actions: Sequence[str], label: str, as_of: dt.date, trigger: str = "cleaning"
) -> int:
    """Apply fixes to the current version as a new version; the one before stays for undo."""
    before = project.locations().get("version")
    cleaned, log = apply_cleaning(current(project, raw), actions)
    steps = [r.asDict() for r in log.collect()]
    if not steps:
        return 0
    after = project.write(cleaned, "version")
    project.publish({"version": after})
    row = {
        "batch_id": uuid.uuid4().hex[:12], "applied_at": utc_now(), "label": label[:80], "actions": [s["action"] for s in steps],
        "before": before, "after": after, "log": steps, "undone": False,
    }
    _append(project, "batches", row, BATCH_SCHEMA)
    refresh(project, project.spark.read.parquet(after), as_of, trigger, actions=row["actions"])
    return len(steps)


def _append(project: Project, name: str, row: dict, schema: str) -> None:
    project.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"{project.path}/{name}")


def undo(project: Project, raw: DataFrame, as_of: dt.date) -> bool:
    """Point back at the version before the last batch."""
    last = batches(project).orderBy(F.desc("applied_at")).first()
    if last is None:
        return False
    project.publish({"version": last["before"]})
    _append(project, "batches", {**last.asDict(recursive=True), "undone": True}, BATCH_SCHEMA)
    refresh(project, current(project, raw), as_of, "undo")
    return True


def reset(project: Project, raw: DataFrame, as_of: dt.date) -> None:
    """Back to the raw table; every batch is withdrawn."""
    event = {"batch_id": RESET, "applied_at": utc_now(), "label": RESET, "actions": [], "before": None, "after": None, "log": [], "undone": True}
    _append(project, "batches", event, BATCH_SCHEMA)
    project.publish({"version": None})
    refresh(project, raw, as_of, "reset")


def save_recipe(project: Project, name: str) -> str | None:
    """Keep the actions of the last batch under a name."""
    last = batches(project).orderBy(F.desc("applied_at")).first()
    if last is None:
        return None
    row = {"recipe_id": uuid.uuid4().hex[:12], "created_at": utc_now(), "name": name.strip()[:80] or "recipe", "actions": last["actions"]}
    _append(project, "recipes", row, RECIPE_SCHEMA)
    return row["recipe_id"]


def recipes(project: Project, limit: int | None = None) -> DataFrame:
    """Recipes, newest first; `limit` is for display."""
    rows = _journal(project, "recipes", RECIPE_SCHEMA).orderBy(F.desc("created_at"))
    return rows.limit(limit) if limit else rows


def apply_recipe(project: Project, raw: DataFrame, recipe: Sequence[str], name: str, as_of: dt.date) -> int:
    """Replay a recipe on this project; only the actions it currently needs are run."""
    return apply_batch(project, raw, recipe, f"recipe: {name}", as_of, "recipe")
