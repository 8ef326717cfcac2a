"""The first k entries of many rows, kept in a task and merged over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import travels

travels(__name__)


class Best:
    """The first k entries of each row by score, highest first, ties by smaller id, null ids last."""

    def __init__(self, rows: int, k: int, least: np.ndarray | float = -np.inf):
        self.k = k
        self.known, self.missing = np.zeros((rows, k), dtype=bool), np.zeros((rows, k), dtype=bool)
        self.score, self.ids = np.zeros((rows, k), dtype=np.int64), np.zeros((rows, k), dtype=np.int64)
        #: Scores below this can't enter a row.
        self.least = np.zeros(rows) + least

    @property
    def entries(self) -> list[np.ndarray]:
        """Row, score, no id, id of all entries, by row and place."""
        at = np.nonzero(self.known)
        return [at[0], self.score[at], self.missing[at].astype(np.int64), self.ids[at]]

    def add(self, *new: np.ndarray) -> None:
        """Take entries as arrays of row, score, whether the id is null, id. Only the rows that they enter are sorted anew."""
        row, score, missing, ids = (x.astype(np.int64) for x in new)
        last = self.score[row, -1]
        better = (missing < self.missing[row, -1]) | ((missing == self.missing[row, -1]) & (ids < self.ids[row, -1]))
        enters = np.flatnonzero(~self.known[row, -1] | (score > last) | ((score == last) & better))
        if not len(enters):
            return
        touched = np.unique(row[enters])
        at, place = np.nonzero(self.known[touched])
        held = touched[at], place
        old = held[0], self.score[held], self.missing[held], self.ids[held]
        row, score, missing, ids = (np.concatenate([a, b[enters]]) for a, b in zip(old, (row, score, missing, ids), strict=True))
        order = np.lexsort((ids, missing, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept, to = order[place < self.k], (row[place < self.k], place[place < self.k])
        self.known[to], self.score[to], self.missing[to], self.ids[to] = True, score[kept], missing[kept], ids[kept]
        full = touched[self.known[touched, -1]]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])


#: What a task gives: row a and slot of a, score, id.
FOUND = "a bigint, slot bigint, score bigint, id bigint"


def listed(best: Best, width: int = 1) -> Iterator[pa.RecordBatch]:
    """The entries as FOUND; row = a * width + slot."""
    row, score, missing, ids = best.entries
    for at in range(0, len(row), 65536):
        cut = slice(at, at + 65536)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[cut] // width), pa.array(row[cut] % width), pa.array(score[cut]), pa.array(ids[cut], mask=missing[cut].astype(bool))], names=["a", "slot", "score", "id"]
        )


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (a, slot) over all tasks, with their rank."""
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
