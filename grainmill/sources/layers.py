"""Published layers of a project: bronze, silver and gold tables, contract and run journal.

    <root>/<project>/bronze/<version>     rows as read, all text, with audit columns
    <root>/<project>/silver/<version>     typed and corrected rows
    <root>/<project>/gold/<table>/<version>
    <root>/<project>/contract/<version>
    <root>/<project>/runs                 one JSON file per run
    <root>/<project>/current              which version of each table is published, one JSON per change

A table is written to a folder of its own and becomes visible when the pointer names it, so a
reader never meets a half-written table and a failed write leaves the last one in place.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from grainmill.operators.roles import quoted

TABLE_NAME = re.compile(r"^[a-z][a-z0-9_]{0,63}$")
POINTER_SCHEMA = "changed_at string, seq bigint, name string, location string, dropped boolean"

CHECK_STRUCT = (
    "struct<id:string,column:string,rule:string,label:string,failing_rows:bigint,total_rows:bigint,"
    "pass_rate:double,status:string,detail:string>"
)
QUALITY_STRUCT = "struct<total:bigint,passed:bigint,warnings:bigint,failed:bigint,score:int>"
RUN_SCHEMA = (
    "run_id string, started_at string, finished_at string, trigger string, status string, "
    "input struct<file:string,sha256:string,bytes:bigint>, "
    "stages array<struct<name:string,status:string,duration_ms:double,rows_in:bigint,rows_out:bigint,output:string>>, "
    f"quality struct<bronze:{QUALITY_STRUCT},silver:{QUALITY_STRUCT}>, "
    f"checks struct<bronze:array<{CHECK_STRUCT}>,silver:array<{CHECK_STRUCT}>>, "
    "rows struct<bronze:bigint,silver:bigint>, "
    "gold_tables array<struct<name:string,rows:bigint,columns:array<string>>>, actions array<string>"
)


def utc_now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")


class Project:
    """One project folder. Paths may be on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"

    # -- table pointers ---------------------------------------------------------------------

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(POINTER_SCHEMA).json(f"{self.path}/current")
        except AnalysisException:
            return self.spark.createDataFrame([], POINTER_SCHEMA)

    def locations(self) -> dict[str, str]:
        """Published tables and where they are; a handful per project."""
        last = self._pointers().groupBy("name").agg(
            F.max_by(F.struct("location", "dropped"), F.struct("changed_at", "seq")).alias("p")
        )
        return {r["name"]: r["p"]["location"] for r in last.collect() if not r["p"]["dropped"]}

    def publish(self, locations: dict[str, str | None]) -> None:
        """Point several names at new locations in one write; None withdraws a name."""
        now = utc_now()
        rows = [(now, i, name, path, path is None) for i, (name, path) in enumerate(locations.items())]
        self.spark.createDataFrame(rows, POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/current")

    def write(self, df: DataFrame, name: str) -> str:
        """Write a table to a fresh folder and return it; nested values become JSON text."""
        folder = f"{self.path}/{name.replace('gold_', 'gold/gold_', 1)}/{uuid.uuid4().hex[:12]}"
        columns = [
            F.to_json(quoted(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else quoted(f.name)
            for f in df.schema
        ]
        df.select(*columns).write.mode("errorifexists").parquet(folder)
        return folder

    def save(self, df: DataFrame, name: str) -> DataFrame:
        location = self.write(df, name)
        self.publish({name: location})
        return self.spark.read.parquet(location)

    def tables(self) -> dict[str, DataFrame]:
        """bronze, silver and gold tables that are published."""
        found = self.locations()
        names = [n for n in ("bronze", "silver") if n in found]
        names += sorted(n for n in found if n.startswith("gold_") and TABLE_NAME.match(n))
        return {n: self.spark.read.parquet(found[n]) for n in names}

    def read(self, name: str, limit: int | None = None) -> DataFrame:
        tables = self.tables()
        if name not in tables:
            raise KeyError(name)
        return tables[name].limit(limit) if limit else tables[name]

    # -- runs ---------------------------------------------------------------------------------

    def append_run(self, run: dict) -> None:
        df = self.spark.createDataFrame([run], T.StructType.fromDDL(RUN_SCHEMA))
        df.coalesce(1).write.mode("append").json(f"{self.path}/runs")

    def runs(self, limit: int | None = None) -> DataFrame:
        """Most recent runs first, all of them unless `limit` asks for fewer to display; unreadable lines are skipped."""
        return read_runs(self.spark, f"{self.path}/runs", limit)


def read_runs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    try:
        runs = spark.read.schema(RUN_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        runs = spark.createDataFrame([], RUN_SCHEMA)
    newest = runs.where("run_id is not null").orderBy(F.desc("started_at"), F.desc("run_id"))
    return newest.limit(limit) if limit else newest


def run_history(runs: DataFrame) -> DataFrame:
    """First and last run, best Silver score, Gold tables of the last run."""
    by_time = F.struct("started_at", "run_id")
    return runs.agg(
        F.min_by("rows.bronze", by_time).alias("bronze_rows"),
        F.max_by("quality.silver.total", by_time).alias("checks_total"),
        F.min_by("quality.bronze.score", by_time).alias("bronze_score"),
        F.max("quality.silver.score").alias("silver_score"),
        F.max_by(F.size("gold_tables"), by_time).alias("gold_tables"),
        F.max_by("input.file", by_time).alias("source_name"),
    )


# -- audit columns ---------------------------------------------------------------------------------


def with_row_numbers(df: DataFrame, folder: str, ingested_at: str) -> DataFrame:
    """Add _ingested_at, _source_file and _row_number (1..n in file order) to rows just read.

    Rows are staged once with the split they came from. A split is a contiguous piece of one
    file, so its rows are numbered by their order inside it plus the rows of the splits before; the
    offsets are one row per split. No task ever sees more than its own rows.
    """
    staged = df.select(
        "*",
        F.input_file_name().alias("_file"), F.input_file_block_start().alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    staged.write.mode("errorifexists").parquet(folder)
    staged = df.sparkSession.read.parquet(folder)
    splits = staged.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    joined = staged.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return joined.select(
        *[quoted(c) for c in df.columns],
        F.lit(ingested_at).alias("_ingested_at"),
        F.regexp_extract("_file", r"([^/]+)$", 1).alias("_source_file"),
        (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("_row_number"),
    )


AUDIT_COLUMNS = ["_ingested_at", "_source_file", "_row_number"]


# -- catalogue ----------------------------------------------------------------------------------------


def layer_of(name: str) -> str:
    return "gold" if name.startswith("gold_") else name


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """name, layer, rows and columns (name:type list) of each published table."""
    parts = None
    for name, df in tables.items():
        columns = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), F.lit(layer_of(name)).alias("layer"), "rows",
            F.lit(len(df.columns)).alias("column_count"), F.lit(columns).alias("columns"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def layer_sizes(tables: DataFrame) -> DataFrame:
    return tables.groupBy("layer").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))


#: Rows up to which a page is found by sorting; before deeper pages the range of keys is narrowed to at most so many.
SORTED_ROWS = 50_000
#: Ranges that a round of narrowing counts, and keys that their bounds are drawn from, at most.
KEY_RANGES, SAMPLED_KEYS = 64, 20_000


def table_page(df: DataFrame, order_by: list[str], limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of a table with the total number of rows; 1 to 5000 rows per page.

    Near the start it is the head of a sort. For a deep page the first key is narrowed first: bounds from a sample of keys
    are counted in one aggregate, the ranges that hold the page stay, and only their rows are sorted. The condition on the key
    reaches the scan. NULL keys come first, as in a sort. A single key with more rows than that is sorted by the other keys.
    """
    limit, offset = max(1, min(int(limit), 5000)), max(0, int(offset))
    total = df.agg(F.count("*")).scalar()
    part, skipped = (df, 0) if offset + limit <= SORTED_ROWS else _key_range(df, order_by[0], offset, limit)
    page = part.orderBy(*[quoted(c) for c in order_by]).offset(offset - skipped).limit(limit)
    return page.withColumn("total_rows", total)


def _key_range(df: DataFrame, name: str, offset: int, limit: int) -> tuple[DataFrame, int]:
    """The rows of a range of keys that hold the page, and how many rows come before the range."""
    key, part, before = quoted(name), df, 0
    rows = df.count()
    while rows > SORTED_ROWS:
        share = min(1.0, SAMPLED_KEYS / 2 / rows)
        drawn = sorted(r[0] for r in part.select(key).where(key.isNotNull()).sample(share, seed=11).limit(SAMPLED_KEYS).distinct().collect())
        bounds = sorted({drawn[len(drawn) * k // KEY_RANGES] for k in range(1, KEY_RANGES)}) if drawn else []
        if not bounds:
            break
        below = part.agg(*[F.count_if(key.isNull() | (key < F.lit(b))).alias(f"n{k}") for k, b in enumerate(bounds)]).first()
        low = [k for k in range(len(bounds)) if before + below[k] <= offset]
        high = [k for k in range(len(bounds)) if before + below[k] >= offset + limit]
        first, last = below[low[-1]] if low else 0, below[high[0]] if high else rows
        if last - first >= rows:
            break  # one key holds what is left
        if low:
            part = part.where(key >= F.lit(bounds[low[-1]]))
        if high:
            part = part.where(key.isNull() | (key < F.lit(bounds[high[0]]))) if not low else part.where(key < F.lit(bounds[high[0]]))
        before, rows = before + first, last - first
    return part, before


def preview(df: DataFrame, order_by: list[str], limit: int = 12) -> DataFrame:
    return df.orderBy(*[quoted(c) for c in order_by]).limit(limit)
