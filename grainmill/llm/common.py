"""Helpers shared by the operators: tables, written intermediate results, code that travels to workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def travels(module: str) -> None:
    """Send a module's functions to the workers by value, so that executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/grainmill"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="grainmill-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it back: it is computed once, a lost executor costs
    nothing of it, and the plan that follows knows its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lowered(text: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def by_row(df: DataFrame, inputs: Sequence[str], keep: Sequence[str], outputs: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Apply a Python function to each row in Arrow batches.

    start() runs once in each task and returns the function; it gets the input columns of a row and returns the
    values of `outputs` (DDL). The columns of `keep` go through untouched, nulls and large integers included.
    """
    kept = df.select(*dict.fromkeys([*keep, *inputs]))
    made = StructType.fromDDL(outputs)
    schema = StructType([*(kept.schema[c] for c in keep), *made.fields])
    types = to_arrow_schema(made)
    names = [*keep, *made.names]
    keep, inputs = list(keep), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in batches:
            # Long texts: no more than a few megabytes of results are held at a time.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [one(*values) for values in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                new = [pa.array(list(column), type=field.type) for column, field in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=names)

    return kept.mapInArrow(run, schema)
