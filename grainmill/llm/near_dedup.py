"""MinHash near-dedup with tensored banding.

A text's minhashes form two small collections of half keys; every pair of one half from each collection is a table
key. So HALVES**2 tables need only 2 * HALVES * WIDTH minhashes. Texts with one key are candidates, candidates are
confirmed on their full shingle sets, and confirmed links are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import BLANKS, stored, travels

travels(__name__)

#: Half keys in a collection, and minhashes in a half key. Texts at similarity s have a key in common but with probability
#: 2 * (1 - s**WIDTH)**HALVES: about 0.0004 at 0.8, 0.000005 at 0.9.
HALVES, WIDTH = 12, 3
#: One-bit minhashes of a set, in words of 64: the least hash of each of 512 equal ranges of hashes.
WORDS = 8
#: As many of them may differ between candidates: 5.5 standard deviations over the mean at a similarity of 0.8.
MAX_BITS = 89
#: HALVES, WIDTH and MAX_BITS are made for this similarity in percent; below it they would lose links.
LEAST_PERCENT = 80
#: Parities of a set, in words of 64: whether each of 512 equal classes of hashes has an odd number of shingles. Two sets differ in
#: at most as many parities as shingles, so this test, sharpest for sets of a few hundred shingles, never loses a link.
ODD_WORDS = 8

_MINHASHES = 2 * HALVES * WIDTH
_ODD = (np.random.default_rng(20240229).integers(0, 2**63, _MINHASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANGES = np.arange(64 * WORDS, dtype=np.uint64) << np.uint64(64 - (64 * WORDS).bit_length() + 1)
BITS = [f"bits{k}" for k in range(WORDS)]
ODDS = [f"odds{k}" for k in range(ODD_WORDS)]
SKETCH = [*BITS, *ODDS]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """The distinct `size`-word shingles of the text with A-Z lowered, as sorted 64-bit hashes; a shorter text is one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    size = min(size, len(h))
    n = len(h) - size + 1
    rolled = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        rolled = mixed(rolled * _MIX + h[k : k + n])
    return np.unique(rolled)


def set_id(found: np.ndarray) -> int:
    """Names a shingle set: texts with one set are one class."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The two collections of half keys, and the words of one-bit minhashes (an empty range has bit 0) and of parities."""
    least = np.full(_MINHASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[None, at : at + 4096] * _ODD[:, None]).min(axis=1))
    halves = least.reshape(2 * HALVES, WIDTH)
    keys = np.arange(2 * HALVES, dtype=np.uint64)
    for k in range(WIDTH):
        keys = mixed(keys * _MIX + halves[:, k])
    at = np.searchsorted(found, _RANGES)
    filled = np.append(at[1:], len(found)) > at
    bits = np.packbits(filled & (mixed(found[np.minimum(at, len(found) - 1)]) >> np.uint64(17) & np.uint64(1)).astype(bool)).view(">i8")
    counts = np.bincount((found & np.uint64(64 * ODD_WORDS - 1)).astype(np.int64), minlength=64 * ODD_WORDS)
    odds = np.packbits((counts & 1).astype(bool)).view(">i8")
    keys = keys.view(np.int64)
    return keys[:HALVES], keys[HALVES:], [*bits.tolist(), *odds.tolist()]


def row_id() -> Column:
    """Names a row by doc_id and text: rows alike in both are alike in everything that follows."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row_id, n_shingles, node (set id; null: no words), u, v and the words of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, dtype=np.int64)
        for batch in batches:
            n, node, us, vs, bits = [], [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), size)
                u, v, b = signature(found) if len(found) else (empty, empty, [0] * len(SKETCH))
                n.append(len(found))
                node.append(set_id(found) if len(found) else None)
                us.append(u)
                vs.append(v)
                bits.append(b)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(us, longs), pa.array(vs, longs), *(pa.array([b[k] for b in bits], pa.int64()) for k in range(len(SKETCH)))],
                names=["doc_id", "row_id", "n_shingles", "node", "u", "v", *SKETCH],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_id().alias("row_id"), "text").mapInArrow(run, f"doc_id {kind}, row_id bigint, n_shingles bigint, node bigint, u array<bigint>, v array<bigint>, " + ", ".join(f"{b} bigint" for b in SKETCH))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have `percent` of their union in common. texts: node, text."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[int | None, np.ndarray]] = [(None, np.zeros(0, dtype=np.uint64))] * 2

        def found(side: int, node: int, text: str) -> np.ndarray | None:
            if last[side][0] != node:  # rows come in the order of b
                own = shingles(text, size)
                if set_id(own) != node:  # another text with the same row_id
                    return None
                last[side] = node, own
            return last[side][1]

        for batch in batches:
            links = []
            for x, y, s, t in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                one, two = found(0, x.as_py(), s.as_py()), found(1, y.as_py(), t.as_py())
                if one is not None and two is not None:
                    common = len(one) + len(two) - len(np.union1d(one, two))
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        links.append((x.as_py(), y.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over the links (a, b), by alternating large and small stars.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour. Rounds end when
    all edges point at a root, about the logarithm of the longest path. Sums run map-side, so a node with many links
    is a few rows in the shuffle, and results of rounds are written.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(hung.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        # Done when no root of one edge hangs below another, and every node has one root.
        roots = new.groupBy("a").agg(F.count("*").alias("n"))
        if roots.where("n > 1").isEmpty() and new.join(roots.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def rooted(table: DataFrame, roots: DataFrame | None, node: str, name: str) -> DataFrame:
    """The table with the root of a node column; a node without links is its own root."""
    if roots is None:
        return table.withColumn(name, F.col(node))
    found = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return table.join(found, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows, and node, head, root of every class: its first row by (doc_id, row_id), nulls last, and its component."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; the tables and bit tests find links from {LEAST_PERCENT} to 100")
    # The 64-bit id of a set stands for it; the first document of a class stands for its text.
    marks = stored(signatures(docs, size), "signatures")
    worded = marks.where("node is not null")
    firsts = worded.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("head"), F.first(F.struct("n_shingles", "u", "v", *SKETCH)).alias("s"))
    classes = stored(firsts.select("node", "head", "s.*"), "classes")
    keys = classes.select("node", F.explode("u").alias("u"), "v").select("node", "u", F.explode("v").alias("v")).select(F.xxhash64("u", "v").alias("key"), "node")
    shared = stored(keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first"), "buckets")
    members = stored(keys.join(shared, "key"), "members")
    facts = ["n_shingles", *SKETCH]

    def side(table: DataFrame, name: str, *more: str) -> DataFrame:
        return table.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in [*facts, *more]))

    # Sizes, one-bit minhashes and parities that allow the similarity.
    sizes = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")

    def differ(words: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))

    # Sets of n and m shingles are similar when at most (n + m) * (100 - percent) / (100 + percent) are in one of them alone.
    alone = (100 + percent) * differ(ODDS) <= (100 - percent) * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    plausible = sizes & alone & (differ(BITS) <= MAX_BITS)
    met = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    through = stored(met.join(side(classes, "a"), "a").join(side(classes, "b"), "b").where(plausible).select("a", "b"), "pairs")
    # All nodes that can be in a comparison are in a shared bucket; only their texts are moved.
    wanted = members.select("node").distinct().join(classes.select("node", F.col("head.row_id").alias("row_id")), "node")
    texts = stored(docs.select(row_id().alias("row_id"), "text").join(wanted, "row_id").dropDuplicates(["row_id", "node"]).select("node", "text"), "texts")

    nearest = through.groupBy("a").agg(F.min("b").alias("b"))
    links = stored(confirmed(nearest, texts, size, percent), "confirmed")
    roots = components(links)
    # Pairs with a bucket's first class, where they are not in one component yet.
    apart = rooted(rooted(through, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b").select("a", "b")
    links = stored(links.unionAll(confirmed(apart, texts, size, percent)), "confirmed")
    roots = components(links)
    # Pairs of classes in one bucket, where they are not in one component yet.
    placed = rooted(members.select("key", "node"), roots, "node", "root")
    split = stored(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key"), "split-buckets")
    rest = stored(placed.join(split, "key").join(classes.select("node", *facts, "u", "v"), "node"), "split-members")
    # A pair is made in one bucket only, that of its first common half keys; this is looked at last, for the few plausible pairs.
    home = F.col("key_a") == F.xxhash64(F.get(F.array_intersect("u_a", "u_b"), F.lit(0)), F.get(F.array_intersect("v_a", "v_b"), F.lit(0)))
    apart = (F.col("key_a") == F.col("key_b")) & (F.col("root_a") < F.col("root_b")) & plausible & home
    more = ["root", "key", "u", "v"]
    cross = side(rest, "a", *more).join(side(rest, "b", *more), apart).select("a", "b").distinct()
    tried = through.select("a", "b").unionAll(through.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = links.unionAll(stored(confirmed(cross.join(tried, ["a", "b"], "left_anti"), texts, size, percent), "confirmed"))
    roots = components(links)

    return marks, stored(rooted(classes.select("node", "head"), roots, "node", "root"), "grouped")


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least `percent` / 100 of their `size`-word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id), one row per
    input row. Texts with one shingle set are one class, and only classes are compared; a class meets others through the
    smallest class of each bucket first, then classes of different components in one bucket meet each other, so no
    link between candidates is lost and a group of n near copies costs about n comparisons. Null, empty and wordless
    texts have no shingles and are linked with nothing. Repeated rows are copies. A null doc_id takes part; it is never
    a component_id unless all of its component are null. Shingles are compared by 64-bit hashes.
    A percent below LEAST_PERCENT is refused.
    """
    marks, classes = grouped(docs, size, percent)
    heads = stored(classes.groupBy("root").agg(F.min("head.doc_id").alias("component_id")), "heads")
    final = stored(classes.join(heads, "root").select("node", "component_id"), "components")
    named = marks.where("node is not null").select("doc_id", "n_shingles", "node").join(final, "node").select("doc_id", "n_shingles", "component_id")
    wordless = marks.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionAll(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_kept(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each component of near_dedup the first by (doc_id, row_id), null ids last, and all wordless rows.

    Of rows alike in doc_id and text one stays. Rows with one doc_id, or none, and texts that are not linked all stay.
    """
    _, classes = grouped(docs, size, percent)
    heads = stored(classes.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.row_id").alias("_row")), "heads")
    rows = docs.withColumn("_row", row_id())
    worded = rows.join(heads, "_row").dropDuplicates(["_row"]).select(*docs.columns)
    return worded.unionAll(docs.where(F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""))
