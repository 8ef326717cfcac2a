"""Readers: delimited text, JSON, plain text, and the guards on what was read."""

from __future__ import annotations

import csv
import re
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.text import name_key
from grainmill.operators.documents import text_lines
from grainmill.operators.roles import quoted

# Encodings tried in order, and JSON keys that hold the records.
ENCODINGS = ["UTF-8", "windows-1252", "ISO-8859-1"]
RECORD_KEYS = ["data", "records", "items", "results"]
LEGACY_CHARSETS = "spark.sql.legacy.javaCharsets"

# Bytes that windows-1252 leaves undefined.
UNDEFINED_1252 = "[\u0081\u008d\u008f\u0090\u009d]"


class ScanError(ValueError):
    """The file cannot be read as a table."""


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that reads the whole file: UTF-8, then windows-1252, then ISO-8859-1."""
    raw = spark.read.text(path)
    if raw.where(~F.is_valid_utf8("value")).isEmpty():
        return ENCODINGS[0]
    as_latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return ENCODINGS[1] if raw.where(as_latin.rlike(UNDEFINED_1252)).isEmpty() else ENCODINGS[2]


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Delimiter from the first twenty lines; a comma when nothing else fits."""
    head = [row["value"] for row in spark.read.text(path).limit(20).collect() if row["value"]]
    try:
        return csv.Sniffer().sniff("\n".join(head), delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _csv_reader(spark: SparkSession, path: str, multi_line: bool):
    encoding = detect_encoding(spark, path)
    if encoding == "windows-1252":
        # Spark only reads this charset with its legacy list enabled.
        spark.conf.set(LEGACY_CHARSETS, "true")
    return (
        spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("multiLine", multi_line)
        .option("nullValue", "").option("emptyValue", "").option("enforceSchema", False)
    )


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header. A line with too many cells stops the read.

    Files stay splittable, so a quoted cell may not hold a line break unless `multi_line` is set.
    """
    reader = _csv_reader(spark, path, multi_line)
    return guard(reader.option("inferSchema", infer).option("preferDate", False).csv(path))


def read_bronze_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text, an empty cell as NULL."""
    df = guard(_csv_reader(spark, path, multi_line).option("inferSchema", False).csv(path))
    return df.select(*[F.nullif(quoted(c), F.lit("")).alias(c) for c in df.columns])


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns, arrays as JSON text."""
    columns: list[Column] = []

    def visit(c: Column, name: str, data_type: T.DataType) -> None:
        if isinstance(data_type, T.StructType):
            for f in data_type:
                visit(c.getField(f.name), f"{name}.{f.name}", f.dataType)
        elif isinstance(data_type, (T.ArrayType, T.MapType)):
            columns.append(F.to_json(c).alias(name))
        else:
            columns.append(c.alias(name))

    for f in df.schema:
        visit(quoted(f.name), f.name, f.dataType)
    return df.select(*columns)


def _json_kinds(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a path by what their first line that is not blank says: `lines` (a whole object, and more lines after it),
    `list` or `object`. One pass over the text; each file gives one row."""
    read = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    read, place = read.where(F.trim("value") != ""), F.struct("file_block_start", "row")
    files = read.groupBy("file_path").agg(F.min_by(F.regexp_replace("value", r"^[\ufeff\s]+", ""), place).alias("head"), F.count("*").alias("lines"))
    one_object = (F.col("lines") > 1) & F.json_object_keys("head").isNotNull()
    kind = F.when(F.col("head").startswith("["), "list").when(one_object, "lines").otherwise("object")
    found: dict[str, list[str]] = {}
    for row in files.select("file_path", kind.alias("kind")).orderBy("file_path").collect():  # file names, as the reader lists them
        found.setdefault(row["kind"], []).append(re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(row["file_path"])))
    return found


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames. A column whose types differ becomes text, unless all are numbers."""
    types: dict[str, set] = {}
    for f in (f for df in frames for f in df.schema):
        types.setdefault(f.name, set()).add(f.dataType)
    mixed = {c for c, kinds in types.items() if len(kinds) > 1 and not all(isinstance(k, T.NumericType) for k in kinds)}
    even = [df.select(*[quoted(c).cast("string").alias(c) if c in mixed else quoted(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), even)


def _objects(raw: DataFrame) -> list[DataFrame]:
    """Rows of documents that are one object each: the list under the first record key a document has, else the lists of
    all its keys side by side, else the object itself."""
    arrays = {f.name: f.dataType for f in raw.schema if isinstance(f.dataType, T.ArrayType)}
    keys = [k for k in RECORD_KEYS if k in arrays]
    without, frames = F.lit(True), []
    for key in keys:
        if not isinstance(arrays[key].elementType, T.StructType):
            raise ScanError(f"{key} is not a list of objects")
        frames.append(flatten(raw.where(without).select(F.inline(quoted(key)))))
        without &= quoted(key).isNull()
    rest = raw.where(without).drop(*keys) if keys else raw
    if not rest.columns or (keys and rest.isEmpty()):
        return frames
    if not keys and len(arrays) == len(raw.columns):
        return [flatten(raw.select(F.inline(F.arrays_zip(*[quoted(c) for c in raw.columns]))))]
    return [*frames, flatten(rest)]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, the list under a record key, one object of equally long lists, or JSON Lines; a folder may hold
    files of every kind. In JSON Lines a line that is no object stops the read."""
    kinds = _json_kinds(spark, path)
    if not kinds:
        raise ScanError("no JSON value found")
    reader = spark.read.option("mode", "FAILFAST")
    frames = []
    for kind, own in kinds.items():
        where = path if len(kinds) == 1 else own
        if kind == "lines":
            frames.append(flatten(reader.option("multiLine", False).json(where)))
        else:
            raw = reader.option("multiLine", True).json(where)
            frames += [flatten(raw)] if kind == "list" else _objects(raw)
    return guard(_stacked(frames))


def guard(df: DataFrame) -> DataFrame:
    """Trim names, number the empty ones, refuse duplicates, and suffix names equal but for case."""
    names = [c.strip() for c in df.columns]
    if not names:
        raise ScanError("no column found")
    names = [f"colonne_{i}" if not c or c == f"_c{i - 1}" else c for i, c in enumerate(names, 1)]
    repeated = [c for c, n in Counter(names).items() if n > 1]
    if repeated:
        raise ScanError("duplicate column names: " + ", ".join(repeated))
    seen: Counter[str] = Counter()
    unique = []
    for c in names:
        seen[name_key(c)] += 1
        unique.append(c if seen[name_key(c)] == 1 else f"{c}_{seen[name_key(c)]}")
    df = df.toDF(*unique)
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c) for c in df.columns])


def read_dataset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read by extension. `multi_line`: quoted cells of a CSV file may hold line breaks."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, multi_line=multi_line)
    if lowered.endswith(".json"):
        return read_json(spark, path)
    raise ScanError("use CSV or JSON")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """source and lines of plain-text files, UTF-8 then windows-1252."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    latin = F.decode("content", "ISO-8859-1")
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.translate(latin, _C1_CONTROLS, _C1_IN_1252))
    text = F.regexp_replace(text, "^\ufeff", "")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("source"), text.alias("text"))


def document_lines(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no, line for every line of every document."""
    lines = documents.select(*[quoted(k) for k in keys], F.posexplode(text_lines(quoted(text))).alias("i", "line"))
    return lines.select(*keys, (F.col("i") + 1).alias("line_no"), "line")


_DEFINED = [b for b in range(0x80, 0xA0) if chr(b) not in UNDEFINED_1252]
_C1_CONTROLS = "".join(chr(b) for b in _DEFINED)
_C1_IN_1252 = bytes(_DEFINED).decode("cp1252")


def _digests():
    """Built inside a function so that it travels by value and workers need not import this package."""

    def digests(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            found = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with open("/" + path[len("file:"):].lstrip("/"), "rb") as file:
                    while block := file.read(1 << 22):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "sha256": found, "bytes": batch["bytes"]})

    return digests


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, bytes of a source, in one row. A source of several parts has the digest of its parts' names and digests in
    order, the sum of their bytes and the name of its folder.

    Files that workers can open are read in blocks of 4 MB, so neither their size nor a cell's limit of 2 GB matters. On other
    file systems, which Spark alone reads, a file is one cell.
    """
    files = spark.read.format("binaryFile").load(path)
    known = files.select("path", F.col("length").alias("bytes"))
    if known.where(~F.startswith("path", F.lit("file:"))).isEmpty():
        read = known.mapInPandas(_digests(), "path string, sha256 string, bytes bigint")
    else:
        read = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    each = read.select(name.alias("file"), folder.alias("folder"), "sha256", "bytes")
    parts = F.array_sort(F.collect_list(F.struct("file", "sha256")))
    whole = each.agg(parts.alias("parts"), F.max("folder").alias("folder"), F.sum("bytes").alias("bytes"))
    listed = F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["file"], p["sha256"])), "\n")
    one = F.size("parts") == 1
    return whole.select(
        F.when(one, F.col("parts")[0]["file"]).otherwise(F.col("folder")).alias("file"),
        F.when(one, F.col("parts")[0]["sha256"]).otherwise(F.sha2(listed, 256)).alias("sha256"), "bytes",
    )
