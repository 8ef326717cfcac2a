"""Token-id files: documents in ascending doc_id order, coded in blocks that stand alone."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from grainmill.llm.common import by_row, shared_folder, travels
from grainmill.llm.range_coder import BLOCK, decode, encode
from grainmill.llm.tokens import END, id_bytes, tokenizer_path

travels(__name__)

#: Blocks that a task codes side by side; a lane has about 170 kB of model and buffers.
LANES = 1024
#: A file row: the block, and the slices of documents in it (their number in the part, doc_id, ids before in the part, ids here).
ROW = "part int, block int, payload binary, docs array<struct<number: bigint, doc_id: {0}, start: bigint, n: bigint>>"


def _matrix_times(matrix: list[int], vector: int) -> int:
    out = 0
    while vector:
        low = vector & -vector
        out ^= matrix[low.bit_length() - 1]
        vector ^= low
    return out


def _shifts() -> list[list[int]]:
    """What 2**k zero bytes make of a CRC-32, for each k."""
    matrix, found = [0xEDB88320, *(1 << k for k in range(31))], []  # one zero bit
    for k in range(64):
        if k >= 3:
            found.append(matrix)
        matrix = [_matrix_times(matrix, row) for row in matrix]
    return found


SHIFTS = _shifts()


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings together, from the CRC-32 of each and the number of bytes of the second."""
    for k in range(size.bit_length()):
        if size >> k & 1:
            first = _matrix_times(SHIFTS[k], first)
    return first ^ second


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = END) -> None:
    """Encode whole texts, end each document with `end`, and write the ids in ascending doc_id order.

    The file parts are ordered by doc_id (null first; ties by the text's hash), so are blocks in a part. A block holds
    at most BLOCK ids, of many short documents or of a slice of a long one, and can be read without any other.
    """
    where, stop = tokenizer_path(tokenizer), np.array([end], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    slice_type = pa.list_(pa.struct([("number", pa.int64()), ("doc_id", id_type), ("start", pa.int64()), ("n", pa.int64())]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, part = id_bytes(where), TaskContext.get().partitionId()
        blocks: list[np.ndarray] = []
        owners: list[list[dict]] = []
        open_ids, open_slices, room = [], [], BLOCK
        number = total = written = 0

        def passed_on() -> pa.RecordBatch:
            nonlocal written
            payload = encode(blocks)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blocks), pa.int32()), pa.array(range(written, written + len(blocks)), pa.int32()), pa.array(payload, pa.binary()), pa.array(owners, slice_type)],
                names=["part", "block", "payload", "docs"],
            )
            written += len(blocks)
            blocks.clear()
            owners.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, ids, at = doc.as_py(), np.frombuffer(ids_of(text.as_py()) + stop, dtype="<u4"), 0
                while at < len(ids):
                    taken = ids[at : at + room]
                    open_ids.append(taken)
                    open_slices.append({"number": number, "doc_id": doc_id, "start": total + at, "n": len(taken)})
                    at, room = at + len(taken), room - len(taken)
                    if not room:
                        blocks.append(np.concatenate(open_ids))
                        owners.append(open_slices)
                        open_ids, open_slices, room = [], [], BLOCK
                        if len(blocks) == LANES:
                            yield passed_on()
                number, total = number + 1, total + len(ids)
        if open_ids:
            blocks.append(np.concatenate(open_ids))
            owners.append(open_slices)
        if blocks:
            yield passed_on()

    ordered.mapInArrow(code, ROW.format(kind)).write.parquet(path)


def read_slices(files: DataFrame, made: str, of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Decode the blocks: part, number, doc_id, start (ids before in the part), and the values of `made` (DDL) that `of` makes of the
    ids, for each document's slice in a block. A block that does not match its checksum raises ValueError."""
    kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    fields = to_arrow_schema(StructType.fromDDL(made))
    names, types = ["part", "number", "doc_id", "start", *fields.names], list(fields.types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, list[dict]]] = []

        def read() -> pa.RecordBatch:
            out = []
            for (part, _, slices), ids in zip(held, decode([h[1] for h in held]), strict=True):
                at = 0
                for s in slices:
                    out.append((part, s["number"], s["doc_id"], s["start"], *of(ids[at : at + s["n"]])))
                    at += s["n"]
            held.clear()
            kinds = [pa.int32(), pa.int64(), id_type, pa.int64(), *types]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field("docs").type.value_type.field("doc_id").type
            for part, payload, slices in zip(*(batch.column(c) for c in ("part", "payload", "docs")), strict=True):
                held.append((part.as_py(), payload.as_py(), slices.as_py()))
                if len(held) == LANES:
                    yield read()
        if held:
            yield read()

    return files.select("part", "payload", "docs").mapInArrow(run, f"part int, number bigint, doc_id {kind}, start bigint, {made}")


def read_ids(files: DataFrame) -> DataFrame:
    """part, number, doc_id, start and ids (binary, little-endian unsigned 32-bit) of each slice."""
    return read_slices(files, "ids binary", lambda ids: (ids.tobytes(),))


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, one row per document, from the ids in the files."""
    # Summed up where the ids are decoded, so that they need not pass through a second worker of each task.
    slices = read_slices(files, "n bigint, crc bigint", lambda ids: (len(ids), zlib.crc32(ids)))
    whole = slices.groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("slices")
    )

    def start():
        def one(parts: list[dict]) -> tuple:
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = joined_crc(crc, p["crc"], 4 * p["n"])
            return (crc,)

        return one

    named = by_row(whole, ["slices"], ["part", "doc_id", "start", "n_tokens"], "ids_crc32 bigint", start)
    # One row per file part.
    sizes = files.select("part", F.aggregate(F.transform("docs", lambda d: d["n"]), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return named.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """Write the documents' ids to `path` (a new folder in the shared one, if None), read the files back and index them.

    Returns doc_id, start, n_tokens (with the end id), ids_crc32, one row per input row. Null and empty texts have
    the end id alone. Null ids come first; repeated rows repeat; other columns are ignored.
    """
    path = path or f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end)
    files = docs.sparkSession.read.schema(ROW.format(docs.schema["doc_id"].dataType.simpleString())).parquet(path)
    return token_index(files)
