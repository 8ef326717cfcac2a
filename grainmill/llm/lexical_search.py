"""Ranked lexical search over impact vectors in buckets of like length.

A document's vector has the impact of each term that any item asks for; an item's has how often it asks. Documents are
ordered by their vector's length and cut into buckets. An item passes over a bucket when its own length times the bucket's
greatest is below its threshold (Cauchy-Schwarz). Inside, its weightiest coordinates are summed and the rest is bounded;
documents that can still reach the threshold are scored exactly in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.best import FOUND, Best, firsts, listed
from grainmill.llm.common import LOWER, UPPER, stored, travels

travels(__name__)

#: Bytes of items that are searched for at once, and sent to all tasks; more take more rounds.
ITEM_BYTES = 8 << 20
#: Documents of a bucket.
BUCKET = 4096
#: The longest one in so many is searched first; what is found there is the threshold for the others.
HEAD = 64
#: Of an item's coordinates so large a share is summed before documents are left out.
FOCUS = 0.5
#: Room for rounding in bounds.
SLACK = 1e-9

#: Bytes that are no part of a term become blanks, A-Z become a-z; bytes from 0x80 on stay.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lowered."""
    return (text or "").encode().translate(_TERMS).split()


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms), t (numbers of the vocabulary's terms in it) and tf, for documents with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(sent.value)}
        for batch in batches:
            kept, n, t, tf = [], [], [], []
            for k, text in enumerate(batch.column("text")):
                words = terms(text.as_py())
                if words:
                    known = Counter(x for x in map(number.get, words) if x is not None)
                    kept.append(k)
                    n.append(len(words))
                    t.append(list(known))
                    tf.append(list(known.values()))
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "t", "tf"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, t array<int>, tf array<bigint>")


def impacts(found: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, length, t and v (weight times impact), for documents whose vector is not zero."""
    sent = found.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        for batch in batches:
            t, starts = batch.column("t").flatten().to_numpy(), batch.column("t").offsets.to_numpy()
            tf = batch.column("tf").flatten().to_numpy()
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            v = weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            length = np.sqrt(np.bincount(row, v.astype(float) ** 2, minlength=batch.num_rows))
            lists = [pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(x)) for x in (t, v)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), *lists], names=["doc_id", "length", "t", "v"])
            yield out.filter(pa.array(length > 0))

    return found.select("doc_id", "n", "t", "tf").mapInArrow(run, "doc_id bigint, length double, t array<int>, v array<bigint>")


class Bucket:
    """Documents by descending length: postings by document and by term."""

    def __init__(self, batch: pa.Table, size: int):
        ids = batch.column("doc_id").combine_chunks()
        self.missing, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.length = batch.column("length").to_numpy()
        t = batch.column("t").combine_chunks()
        self.t, self.starts = t.flatten().to_numpy(), t.offsets.to_numpy() - t.offsets[0].as_py()
        self.v = batch.column("v").combine_chunks().flatten().to_numpy()
        by_term = np.argsort(self.t, kind="stable")
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))[by_term]
        self.value = self.v[by_term]
        self.at = np.searchsorted(self.t[by_term], np.arange(size + 1))
        filled = np.flatnonzero(np.diff(self.at))
        self.most = np.zeros(size, dtype=np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.value, self.at[filled])

    def survivors(self, t: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
        """Documents whose score with the item (terms t, counts q) may reach `least`."""
        most = q * self.most[t]
        order = np.argsort(-most, kind="stable")
        focus, rest = np.split(order, [max(1, int(np.ceil(FOCUS * len(order))))])
        if most.sum() < least:
            return np.zeros(0, dtype=np.int64)
        part, left = np.zeros(len(self.ids)), self.length**2
        for k in focus:
            cut = slice(self.at[t[k]], self.at[t[k] + 1])
            part[self.doc[cut]] += q[k] * self.value[cut]
            left[self.doc[cut]] -= self.value[cut].astype(float) ** 2
        # What the other coordinates can add: by the lengths of what is left of both vectors, and by the bucket's greatest values.
        more = np.minimum(np.sqrt((q[rest].astype(float) ** 2).sum() * (np.maximum(left, 0) + SLACK * self.length**2)), most[rest].sum())
        return np.flatnonzero((part + more) * (1 + SLACK) >= least)

    def scores(self, docs: np.ndarray, t: np.ndarray, q: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores; dense: zeros for all terms."""
        dense[t] = q
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - ends + sizes, sizes)
        sums = np.append(0, np.cumsum(dense[self.t[where]] * self.v[where]))
        dense[t] = 0
        return sums[ends] - sums[ends - sizes]


def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BUCKET):
            part = batch.slice(at, BUCKET)
            if held and sum(b.num_rows for b in held) + part.num_rows > BUCKET:
                yield pa.Table.from_batches(held)
                held.clear()
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def searched(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: np.ndarray) -> DataFrame:
    """FOUND of each task. vectors: sorted by descending length inside partitions. least: scores to reach, by item."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = sent.value
        best = Best(len(items), k, least)
        lengths = np.array([np.sqrt((q.astype(float) ** 2).sum()) for _, q in items])
        dense = np.zeros(size, dtype=np.int64)
        for table in bucketed(batches):
            open_ = np.flatnonzero(lengths * table.column("length").to_numpy().max() * (1 + SLACK) >= best.least)
            if not len(open_):
                continue
            bucket = Bucket(table, size)
            for item in open_:
                t, q = items[item]
                docs = bucket.survivors(t, q, best.least[item])
                score = bucket.scores(docs, t, q, dense)
                docs, score = docs[score >= best.least[item]], score[score >= best.least[item]]
                best.add(np.full(len(docs), item), score, bucket.missing[docs], bucket.ids[docs])
        yield from listed(best)

    return vectors.mapInArrow(run, FOUND)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents that score highest with each item: item_id, rank, doc_id, score.

    docs: doc_id, text; items: item_id, text. N documents have a term, L terms in all; a document of n terms has
    m = 25 + 75 * n * N div L. A term in df documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), found tf times
    it adds w * (10**9 * tf div (1000 * tf + 8 * m)), as often as the item has it. Only scores above 0 count; equal scores
    by smaller doc_id, null last. Null and empty texts have no terms; such items have no rows. A null item_id is an item.
    Items alike in id and text count once; of two texts under one id each has its own ranks. Repeated documents are documents
    of their own. Items are taken in rounds of ITEM_BYTES; df, N and L always cover all documents.
    """
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rounds = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    results = [_round(docs, asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r), k) for r in range(rounds)]
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


def _round(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = [(r.item_id, Counter(terms(r.text))) for r in asked.collect()]  # ITEM_BYTES
    vocabulary = sorted(set().union(*(words for _, words in rows)))
    found = stored(counted(docs, vocabulary), "term-counts")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in found.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # the vocabulary
        df[r[0]] = r[1]
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    number = {w: at for at, w in enumerate(vocabulary)}
    vectors = [(np.array([number[w] for w in words], dtype=np.int64), np.array(list(words.values()), dtype=np.int64)) for _, words in rows]
    names = spark.createDataFrame([(at, item) for at, (item, _) in enumerate(rows)], f"a bigint, item_id {asked.schema['item_id'].dataType.simpleString()}")

    made = impacts(found, weights, n_docs, n_terms or 1)
    # Ranges of length; equal lengths are dealt by id.
    ordered = stored(made.repartitionByRange(F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length")), "impacts")
    cut = ordered.agg(F.percentile_approx("length", 1 - 1 / HEAD, 10000)).first()[0] or 0.0
    head = stored(searched(ordered.where(F.col("length") >= cut), vectors, len(vocabulary), k, np.ones(len(rows))), "head")
    first = np.ones(len(rows))
    for a, score in firsts(head, k).where(F.col("rank") == k).select("a", "score").collect():  # one an item
        first[a] = score
    rest = searched(ordered.where(F.col("length") < cut), vectors, len(vocabulary), k, first)
    ranked = firsts(head.unionAll(rest), k)
    return stored(ranked.join(names, "a").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"), "ranked")
