"""Best-fit packing of token pieces into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import stored, travels
from grainmill.llm.tokens import END, id_bytes, tokenizer_path

travels(__name__)

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum that fits, longest lengths first.
    reach[k] has bit s set if some of the k longest lengths, each as often as available, sum to s."""
    lengths = sorted(counts, reverse=True)
    within = (1 << room + 1) - 1
    reach = [1]
    for length in lengths:
        sums, left, step = reach[-1], min(counts[length], room // length), 1
        while left and sums >> room == 0:  # copies in powers of two; a full bin ends the search
            take = min(step, left)
            sums |= sums << length * take & within
            left, step = left - take, step * 2
        reach.append(sums)
        if sums >> room:
            break
    at, chosen = reach[-1].bit_length() - 1, []
    for k in range(len(reach) - 1, 0, -1):
        length, n = lengths[k - 1], 0
        while not reach[k - 1] >> at & 1:  # the fewest copies that leave a sum the longer lengths can make
            at, n = at - length, n + 1
        chosen += [length] * n
    return chosen[::-1]


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Fill bins by minimum bin slack: each time the fullest combination, then remove it, as often as its lengths last.

    Takes lengths and how often each occurs, at most `room` of them, so the work does not depend on the number of pieces.
    Returns (length, first rank, pieces a bin, first bin, bins, offset): the pieces of that length with ranks from
    `first rank` on go in turn to the bins, so many to a bin, from `offset` on.
    """
    left = {length: n for length, n in counts.items() if n}
    used, runs, bins = dict.fromkeys(left, 0), [], 0
    while left:
        # The longest length must go somewhere: the rest of its bin is filled as well as can be.
        longest = max(left)
        others = {length: n - (length == longest) for length, n in left.items()}
        chosen = [longest, *fullest({length: n for length, n in others.items() if n}, room - longest)]
        need = {length: chosen.count(length) for length in chosen}
        times = min(left[length] // n for length, n in need.items())
        offset = 0
        for length, n in need.items():
            runs.append((length, used[length], n, bins, times, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        bins += times
    return runs


def pieces(ids: bytes, room: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only documents over `room` are cut, all but the first piece full."""
    n = len(ids) // 4
    first = n % room or room
    cuts = [0, *range(first, n + 1, room)] if n > room else [0, n]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def pack(docs: DataFrame, room: int = 1024, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """Pack the documents' token pieces into sequences of at most `room` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null or empty text has
    only its end id and is one piece. Repeated rows and null ids are packed like any other. Other columns are ignored.
    Only the number of pieces of each length, at most `room` numbers, comes to the driver.
    """
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    path, stop = tokenizer_path(tokenizer), np.array([end], dtype="<u4").tobytes()
    id_field = docs.schema["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part, seen = id_bytes(path), TaskContext.get().partitionId(), np.zeros(room + 1, dtype=np.int64)
        for batch in batches:
            texts, rows, owners = batch.column("text"), [], []
            for i in range(batch.num_rows):
                for piece in pieces(ids(texts[i].as_py()) + stop, room):
                    rows.append((*piece, part, int(seen[piece[2]])))
                    seen[piece[2]] += 1
                    owners.append(i)
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, type=pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "turn"])

    made = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_field.dataType.simpleString()}, {PIECES}, part int, turn bigint")
    # Written once: ranks within a task hold only for the run that made them.
    made = stored(made, "pieces")
    by_task = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_task.selectExpr("length", "part", "sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding) before")
    totals = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}
    runs = sorted(plan(totals, room))
    starts = {length: [r for r in runs if r[0] == length] for length in totals}
    shared = docs.sparkSession.sparkContext.broadcast({length: np.array([r[1:] for r in own], dtype=np.int64) for length, own in starts.items()})
    ranked = made.join(before, ["length", "part"]).withColumn("rank", F.col("turn") + F.coalesce("before", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                table = shared.value[int(length)]
                run = table[np.searchsorted(table[:, 0], ranks[here], "right") - 1]
                nth = ranks[here] - run[:, 0]
                sequence[here] = run[:, 2] + nth // run[:, 1]
                offset[here] = run[:, 4] + nth % run[:, 1] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(sequence), pa.array(offset)], names=[*out, "sequence_id", "offset"])

    return ranked.select(*out, "rank").mapInArrow(place, f"doc_id {id_field.dataType.simpleString()}, {PIECES}, sequence_id bigint, `offset` bigint")
