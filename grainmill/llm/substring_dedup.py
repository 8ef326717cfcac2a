"""Removal of repeated byte strings: sampled anchors find where texts can repeat, suffix arrays decide what does.

Each `length`-byte window belongs to an anchor, the place of the least hash of GRAM bytes in it. Equal windows have equal
anchors, wherever they stand. Windows that share an anchor, in runs of at most RUN offsets, have a core of bytes in common.
Runs whose core occurs once repeat nowhere. Runs that agree in all their bytes repeat everywhere. What is left, around
the ends of repeated passages, goes core by core into suffix arrays, and windows with a common prefix of their
whole length with a neighbour repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, stored, travels
from grainmill.llm.suffix_array import common_prefixes, suffix_array

travels(__name__)

GRAM, RUN = 32, 128
#: Bytes of a text that are hashed at a time; parts overlap by a window.
PART = 1 << 19
#: Bytes of the texts that one suffix array sorts, and runs that one core may bring to it. Cores with more
#: runs are counted window by window.
ARRAY_BYTES, ARRAY_RUNS = 1 << 21, 2000
#: Stands for a null doc_id.
LAST = 2**63 - 1

_RNG = np.random.default_rng(7919)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of any part of a byte string, from sums over its prefixes."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    def __init__(self, s: np.ndarray) -> None:
        if len(Hasher.up) < len(s) + 1:
            n = 1 << len(s).bit_length() + 1
            Hasher.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _R))])
            Hasher.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _R_INVERSE))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[s] * Hasher.up[: len(s)])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Hasher.down[starts] + (ends - starts).astype(np.uint64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` values, the place of the least; the last of equals. Values lose their low 20 bits."""
    n = len(values)
    low = np.uint64((1 << 20) - 1)
    keyed = (values & ~low) | (low - np.arange(n, dtype=np.uint64))
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = keyed
    table = padded.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (low - (least & low)).astype(np.int64)


def runs(s: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a part: first window, windows, bytes from there to the core, core hash, hash of all bytes."""
    hashes = Hasher(s)
    grams = np.arange(len(s) - GRAM + 1)
    anchor = least_places(hashes(grams, grams + GRAM), length - GRAM + 1)
    window = np.arange(len(anchor))
    which = (anchor - window) // RUN
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])))
    count = np.diff(np.append(first, len(window)))
    core = anchor[first] - RUN * which[first]
    before = core - first
    kind = mixed(which[first].astype(np.uint64) + np.uint64(1))
    core_hash = hashes(core, core + length - RUN + 1) ^ kind
    whole = mixed(hashes(first, first + count - 1 + length) + (before * RUN + count).astype(np.uint64) * _R)
    return first, count, before, core_hash.view(np.int64), whole.view(np.int64)


def find_runs(rows: DataFrame, length: int) -> DataFrame:
    """id, digest, first, n, lead, core, whole: the runs of every text of at least `length` bytes."""
    names = ["id", "digest", "first", "n", "lead", "core", "whole"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0

            def passed_on(out: list[tuple]) -> pa.RecordBatch:
                kinds = (np.int64, np.int64, np.int64, np.int16, np.int16, np.int64, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(kind)) for k, kind in enumerate(kinds)], names=names)

            for own, digest, text in zip(*(batch.column(c) for c in ("id", "digest", "text")), strict=True):
                s = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                for at in range(0, len(s) - length + 1, PART):
                    first, n, lead, core, whole = runs(s[at : at + PART + length - 1], length)
                    out.append((np.full(len(first), own.as_py()), np.full(len(first), digest.as_py()), first + at, n, lead, core, whole))
                    size += len(first)
                if size > 200_000:
                    yield passed_on(out)
                    out, size = [], 0
            if out:
                yield passed_on(out)

    return rows.where(F.octet_length("text") >= length).mapInArrow(search, "id bigint, digest bigint, first bigint, n smallint, lead smallint, core bigint, whole bigint")


def repeated_windows(segments: list[bytes], counts: list[int], size: int) -> list[np.ndarray]:
    """For each segment, which of its first `count` windows of `size` bytes occur in any of the segments again."""
    s = np.frombuffer(b"".join(segments), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in segments])])[:-1]
    real = np.zeros(len(s), dtype=bool)
    for at, n in zip(starts, counts, strict=True):
        real[at : at + n] = True
    order = suffix_array(s, size)
    order = order[real[order]]
    same = common_prefixes(s, order, size) >= size
    again = np.zeros(len(s), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return [again[at : at + n] for at, n in zip(starts, counts, strict=True)]


def stretches(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _text_rows(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), *carry).withColumn("digest", F.xxhash64("text"))


def open_segments(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """core, salt, id, digest, first, n, lead, segment: the bytes of runs without their common core, which eight
    bytes of its hash stand for."""
    lists = wanted.groupBy("id", "digest").agg(F.collect_list(F.struct("core", "many", "first", "n", "lead")).alias("runs"))
    found = rows.join(lists, ["id", "digest"])
    core_size = length - RUN + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "many", "id", "digest", "first", "n", "lead", "segment"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary()]
        for batch in batches:
            out = []
            for own, digest, text, own_runs in zip(*(batch.column(c) for c in ("id", "digest", "text", "runs")), strict=True):
                raw = text.as_py().encode()
                for r in own_runs.as_py():
                    at, core = r["first"], r["first"] + r["lead"]
                    segment = raw[at:core] + r["core"].to_bytes(8, "big", signed=True) + raw[core + core_size : at + r["n"] - 1 + length]
                    out.append((r["core"], r["many"], own.as_py(), digest.as_py(), at, r["n"], r["lead"], segment))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return found.mapInArrow(cut, "core bigint, many boolean, id bigint, digest bigint, first bigint, n smallint, lead smallint, segment binary")


def by_suffix_arrays(segments: DataFrame, length: int) -> DataFrame:
    """id, digest, start, end: byte ranges of repeated windows among runs with one core."""
    size = RUN - 1 + 8  # bytes of a window outside the core, and the core's eight

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (own, digest, first, *_), flags in zip(rows, repeated_windows([r[4] for r in rows], [r[3] for r in rows], size), strict=True):
                out += [(own, digest, a, b) for a, b in stretches(flags, first, length)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "digest", "start", "end"])

        last = None
        for batch in batches:
            for core, own, digest, first, n, segment in zip(*(batch.column(c).to_pylist() for c in ("core", "id", "digest", "first", "n", "segment")), strict=True):
                if weight > ARRAY_BYTES and core != last:  # all runs of a core are in one array
                    yield solved(held)
                    held, weight = [], 0
                held.append((own, digest, first, n, segment))
                weight += len(segment)
                last = core
        if held:
            yield solved(held)

    together = segments.where("not many").repartition("core").sortWithinPartitions("core")
    return together.mapInArrow(search, "id bigint, digest bigint, start bigint, `end` bigint")


def by_counting(segments: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many runs: every window is a row, and equal rows are counted."""
    size = RUN - 1 + 8

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, digest, first, n, segment in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "first", "n", "segment")), strict=True):
                windows = [hashlib.sha256(segment[k : k + size]).digest()[:16] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([own] * n), pa.array([digest] * n), pa.array(range(first, first + n), pa.int64()), pa.array(windows, pa.binary())], names=["id", "digest", "start", "window"])

    windows = stored(segments.where("many").mapInArrow(explode, "id bigint, digest bigint, start bigint, window binary"), "windows")
    again = stored(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    return windows.join(again, "window").select("id", "digest", "start", (F.col("start") + length).alias("end"))


def substring_dedup(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else, in this or any other text.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed ranges), removed (start and end of each), kept_bytes and the columns of `carry`, one
    row per input row. Strings are judged on the input; matches never cross documents; overlapping repeats count. Null
    text is empty. Repeated rows repeat each other, so all their strings of `length` bytes go. Rows of one doc_id are told
    apart by their text. Strings are compared by hashes of 64 bits for cores and 128 for whole runs.
    """
    rows = _text_rows(docs)
    found = stored(find_runs(rows, length), "runs")
    # One row stands for all runs with the same bytes; the columns of first() all come from one row.
    kinds = stored(found.groupBy("core", "whole").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("id", "digest", "first", "n", "lead"))), "kinds")
    per_core = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unlike = stored(per_core, "cores")
    all_alike = stored(kinds.where("times > 1").select("core", "whole"), "alike")
    wanted = kinds.join(unlike, "core").withColumn("many", F.col("kinds") > ARRAY_RUNS)
    segments = stored(open_segments(rows, wanted, length), "segments")
    covered = [
        found.join(all_alike, ["core", "whole"]).select("id", "digest", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + length).alias("end")),
        by_suffix_arrays(segments, length),
        by_counting(segments, length),
    ]
    spans = covered[0].unionAll(covered[1]).unionAll(covered[2]).groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = _text_rows(docs, carry).join(spans, ["id", "digest"], "left").withColumn("doc_id", F.when(F.col("id") != LAST, F.col("id")))

    def start():
        def one(text: str, ranges: list[dict] | None) -> tuple:
            raw = text.encode()
            merged: list[list[int]] = []
            for r in ranges or ():
                if merged and r["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["end"])
                else:
                    merged.append([r["start"], r["end"]])
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            return len(raw), sum(b - a for a, b in merged), len(merged), merged, b"".join(kept)

        return one

    return by_row(joined, ["text", "spans"], ["doc_id", *carry], "n_bytes bigint, n_removed bigint, n_spans bigint, removed array<array<bigint>>, kept_bytes binary", start)
