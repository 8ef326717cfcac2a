"""What the linear text classifiers share: labelled texts, n-gram counts by class, and a model of 64-bit n-gram keys."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, travels

travels(__name__)

Features = Callable[[str | None], np.ndarray]

#: An n-gram is a feature when so large a share of the labelled texts has it. So there are at most 1 / LEAST_SHARE times
#: as many features as a labelled text has n-grams on average, whatever the corpus; the share doubles while they are over MOST_FEATURES.
LEAST_SHARE = 0.001
MOST_FEATURES = 1 << 20


def rolled_ngrams(points: np.ndarray, sizes: tuple[int, ...], salt: int = 0) -> list[np.ndarray]:
    """64-bit keys of the n-grams of a sequence of numbers, for each size."""
    found, rolled = [], np.full(len(points), salt, dtype=np.uint64)
    for k in range(max(sizes)):
        n = len(points) - k
        if n < 1:
            break
        rolled = (rolled[:n] + points[k:]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(31)
        if k + 1 in sizes:
            found.append(rolled * np.uint64(0xBF58476D1CE4E5B9))
    return found


def distinct(keys: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct keys."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *keys]))


def remainder(doc_id: object, by: int) -> int | None:
    """crc32 of the id as text, mod `by`; none of a null id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def marks_of(labels: DataFrame, label: str, by: int, held_out: int) -> DataFrame:
    """doc_id, y (0 or 1): ids with one label or more that may train. Where labels of an id differ the higher holds."""
    used = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % by != held_out) & F.col(label).isNotNull()
    return labels.where(used).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))


def labelled_texts(docs: DataFrame, marks: DataFrame, by: int, held_out: int) -> DataFrame:
    """text, y of the documents with a mark. Both sides are dealt by id at every size, since labels grow with the documents;
    held-out documents stay where they are."""
    kept = docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % by != held_out)).select("doc_id", "text")
    return kept.join(marks.hint("merge"), "doc_id").select("text", "y")


def class_counts(texts: DataFrame, features: Features) -> DataFrame:
    """key, n0, n1: texts of each class that have the n-gram. Summed over each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for at in range(0, batch.num_rows, 250):
                part = [features(t.as_py()) for t in batch.column("text")[at : at + 250]]
                flat = np.concatenate([np.zeros(0, dtype=np.uint64), *part])
                one = np.repeat(y[at : at + 250], [len(p) for p in part])
                keys, place = np.unique(flat, return_inverse=True)
                n1 = np.bincount(place, one, minlength=len(keys)).astype(np.int64)
                n = np.bincount(place, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n - n1), pa.array(n1)], names=["key", "n0", "n1"])

    found = texts.mapInArrow(run, "key bigint, n0 bigint, n1 bigint")
    return found.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratios(counts: DataFrame, n0: int, n1: int, least_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and naive Bayes log-count ratios (class 1 over class 0) of the n-grams that are features. counts: stored."""
    share, size = LEAST_SHARE, MOST_FEATURES + 1
    while size > MOST_FEATURES:
        kept = counts.where(F.col("n0") + F.col("n1") >= max(2, share * (n0 + n1)))
        kept = kept.withColumn("ratio", F.log((F.col("n1") + 1) / F.lit(n1 + 2)) - F.log((F.col("n0") + 1) / F.lit(n0 + 2))).where(F.abs("ratio") >= least_ratio)
        size, share = kept.count(), 2 * share
    table = kept.select("key", "ratio").toArrow()  # MOST_FEATURES rows
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("ratio").to_numpy()[order]


def found_in(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places in `keys` of those of `own` that are there; both sorted."""
    at = np.searchsorted(keys, own)
    return at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own)] if len(keys) else at[:0]


def fit_sample(docs: DataFrame, marks: DataFrame, keys: np.ndarray, features: Features, fit_rows: int) -> list[tuple[np.ndarray, int]]:
    """(places of features, y) of at most `fit_rows` texts of each class: those with the smallest hash of the id."""
    chosen = [marks.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for c in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def start():
        def one(text: str | None) -> tuple:
            return (found_in(sent.value, features(text)).astype(np.int32).tobytes(),)

        return one

    made = by_row(sample, ["text"], ["doc_id", "y"], "x binary", start).orderBy("doc_id", "x").toArrow()
    # An id that many rows repeat gives its first texts only.
    return [(np.frombuffer(x, dtype=np.int32), y) for x, y in zip(made.column("x").to_pylist(), made.column("y").to_pylist(), strict=True)]
