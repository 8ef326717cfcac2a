"""Hard-negative mining with candidate lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster, the candidates of a slice are sorted once by an upper bound of their
score with any member: the candidate's length times the cosine of its angle to the centre less the cluster's radius. Every
member walks that list and stops where the bound proves that nothing further on can enter its result. Positives are sought
among candidates whose label falls into the anchor's group of labels, negatives among all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.best import FOUND, Best, firsts, listed
from grainmill.llm.common import stored, travels

travels(__name__)

#: Anchors that centres are fitted on, at most; every anchor is then put to its nearest centre.
FIT_ANCHORS = 4096
#: Anchors to a centre, as aimed at, and centres at most.
MEMBERS, CENTRES = 64, 512
#: Bytes of anchors that a round sends to all tasks; more anchors take more rounds.
ROUND_BYTES = 32 << 20
#: Anchors of a cluster that walk a list together; candidates of a slice, and of a step of the walk.
BLOCK, SLICE, STEP = 256, 8192, 1024
#: Room for rounding in angles and bounds.
SLACK = 1e-6
#: Scores stay below this, so that sums of products are whole numbers in doubles; below the other they are in single precision too.
MOST, MOST_SINGLE = 2.0**53, 2.0**24
#: Groups that the labels of anchors are dealt to, at most.
GROUPS = 16
#: Scores of an anchor in a step that are looked at one by one, for each entry sought; of more, the strongest are found first.
FEW = 8
#: Of more than so many candidates with too many such scores, an eighth goes before the others, to raise what they are held against.
FIRST = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> tuple[DataFrame, type]:
    """id, label, q (whole numbers, zeros up to the longest vector's length), row, for rows whose label and components are all there and finite;
    and the type in which their scores are exact."""
    # A table of one row group would be one task's work, and each task compares its rows with all anchors.
    vectors = vectors.select(id_col, vector_col, label_col).repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    wide = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x))
    rows = stored(vectors.where(usable).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), q.alias("q"), F.monotonically_increasing_id().alias("row")), "vectors")
    shape = rows.agg(F.min(F.size("q")), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if (shape[2] or 0) >= MOST:
        raise ValueError(f"squared length {shape[2]:.3g} of a scaled vector: scores up to 2**53 are exact, beyond they are not given")
    if shape[0] != shape[1]:
        rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(shape[1]) - F.size("q"))))
    return rows, np.float32 if (shape[2] or 0) < MOST_SINGLE else np.float64


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=kind)


def directions(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def centres_of(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centres at most, by k-means on directions."""
    units = directions(sample)
    centres = units[np.unique(np.linspace(0, len(units) - 1, min(k, len(units))).astype(int))]
    for _ in range(rounds):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], directions(sums), centres)
    return centres


def blocks_of(anchors: np.ndarray, centres: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows of anchors, centre, radius) for each cluster, large ones in several."""
    nearest, cosine = np.zeros(len(anchors), dtype=int), np.zeros(len(anchors))
    for at in range(0, len(anchors), FIT_ANCHORS):
        part = np.clip(directions(anchors[at : at + FIT_ANCHORS]) @ centres.T, -1, 1)
        nearest[at : at + FIT_ANCHORS], cosine[at : at + FIT_ANCHORS] = part.argmax(axis=1), part.max(axis=1)
    found = []
    for c in np.unique(nearest):
        own = np.flatnonzero(nearest == c)
        own = own[np.argsort(-cosine[own], kind="stable")]  # members at like angles share a block and its radius
        for at in range(0, len(own), BLOCK):
            part = own[at : at + BLOCK]
            found.append((part, centres[c], float(np.arccos(cosine[part].min())) + SLACK))
    return found


def grouped(anchors: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, list]]:
    """For each group of labels, sorted, the labels and the blocks of their anchors."""
    known = np.unique(labels)
    found = []
    for g in range(min(GROUPS, len(known))):
        own = np.flatnonzero(np.isin(labels, known[g::GROUPS]))
        fit = own[np.unique(np.linspace(0, len(own) - 1, min(FIT_ANCHORS, len(own))).astype(int))]
        centres = centres_of(anchors[fit], min(CENTRES, -(-len(own) // MEMBERS)))
        found.append((known[g::GROUPS], [(own[part], centre, radius) for part, centre, radius in blocks_of(anchors[own], centres)]))
    return found


def walked(slice_: tuple[np.ndarray, ...], anchors: np.ndarray, blocks: list, least: Callable[[np.ndarray], np.ndarray], found: Callable[..., None]) -> None:
    """Walk each block's list of the slice. least(rows of anchors): scores that a candidate must reach to matter;
    found(rows of anchors, scores, label, no id, id): takes a step's exact scores."""
    v, *facts = slice_
    length = np.linalg.norm(v.astype(np.float64), axis=1)
    cosines = np.clip(directions(v) @ np.stack([c for _, c, _ in blocks]).T, -1, 1)
    norms = np.linalg.norm(anchors.astype(np.float64), axis=1)
    for k, (own, _, radius) in enumerate(blocks):
        # The cosine of the angle to the centre less the radius, 1 within the radius.
        cosine, near = cosines[:, k], np.cos(min(radius, np.pi))
        nearest = np.where(cosine >= near, 1, cosine * near + np.sqrt(1 - cosine * cosine) * np.sin(min(radius, np.pi)))
        bound = length * (nearest + SLACK)
        needed = least(own)
        own, needed = own[needed < np.inf], needed[needed < np.inf]
        if not len(own):
            continue
        if needed.min() > -np.inf and norms[own].min() * bound.min(initial=np.inf) >= needed.max():
            found(own, anchors[own] @ v.T, *facts)  # nobody would stop before the end of the list
            continue
        order = np.argsort(-bound)
        bound = bound[order]
        for at in range(0, len(order), STEP):
            own = own[norms[own] * bound[at] + SLACK >= least(own)]
            if not len(own):
                break
            step = order[at : at + STEP]
            found(own, anchors[own] @ v[step].T, *(x[step] for x in facts))


def reaching(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the scores that are as high as their row's least."""
    # Rounded up in single precision, so that no comparison is by doubles; scores are whole numbers.
    at = np.flatnonzero(scores >= np.ceil(least).astype(scores.dtype)[:, None])
    return at // scores.shape[1], at % scores.shape[1]


def parted(found: Callable[..., None], own: np.ndarray, scores: np.ndarray, *facts: np.ndarray) -> None:
    """Give an eighth of the candidates first, then the others as a whole."""
    cut = scores.shape[1] // 8
    found(own, scores[:, :cut], *(x[:cut] for x in facts))
    found(own, scores[:, cut:], *(x[cut:] for x in facts), True)


def strongest(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """What fits and is no lower than the row's k-th that fits."""
    if scores.shape[1] <= k:
        return fits
    kept = np.where(fits, scores, -np.inf).astype(scores.dtype)
    return fits & (kept >= np.partition(kept, -k, axis=1)[:, -k, None])


def sliced(batches: Iterator[pa.RecordBatch], dim: int, kind: type) -> Iterator[tuple[np.ndarray, ...]]:
    """(vectors, label, no id, id) of bounded slices."""
    room = max(256, min(SLICE, (32 << 20) // (8 * max(dim, 1))))
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, ...]:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows.column("id").combine_chunks()
        return matrix(rows.column("q").combine_chunks(), kind).reshape(len(rows), dim), rows.column("label").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()

    for batch in batches:
        for at in range(0, batch.num_rows, room):
            part = batch.slice(at, room)
            if held and sum(b.num_rows for b in held) + part.num_rows > room:
                yield joined()
                held.clear()
            held.append(part)
    if held:
        yield joined()


def hard_negatives(
    vectors: DataFrame, anchor: Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor(id) says which rows are
    anchors. A score is the inner product of vectors whose components x have become floor(scale * x); shorter vectors count as
    followed by zeros. Higher scores come first, ties by smaller id, null ids last. Rows with a null label or vector, or a null
    or non-finite component take no part. A positive has another id than its anchor; a null id is another. Repeated rows
    count as often as they come, as anchors too. A negative positive_score has no negatives. An empty table has no results.
    Scores beyond 2**53 are refused. Anchors go to the tasks in rounds of ROUND_BYTES; all candidates are walked in every round.
    """
    spark = vectors.sparkSession
    rows, kind = quantised(vectors, id_col, vector_col, label_col, scale)
    anchors = rows.where(F.coalesce(anchor(F.col("id")), F.lit(False)))
    n, dim = anchors.agg(F.count("*"), F.max(F.size("q"))).first()
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], shape)
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(FIT_ANCHORS).select("q").toArrow()
    centres = centres_of(matrix(sample.column("q").combine_chunks()).reshape(len(sample), dim), min(CENTRES, -(-n // MEMBERS)))
    rounds = -(-n * 8 * max(dim, 1) // ROUND_BYTES)
    # Rows are dealt by the hash of their written number, so no round has many more anchors than another, whatever repeats.
    results = [_round(rows, anchors if rounds == 1 else anchors.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r), dim, kind, centres, positives, negatives, low, high) for r in range(rounds)]
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


def _round(rows: DataFrame, anchors: DataFrame, dim: int, kind: type, centres: np.ndarray, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    table = anchors.toArrow()  # ROUND_BYTES of vectors
    a = matrix(table.column("q").combine_chunks(), kind).reshape(len(table), dim)
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    sent = spark.sparkContext.broadcast((a, ids, labels, blocks_of(a, centres) if len(a) else [], grouped(a, labels)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, ids, labels, _, groups = sent.value
        best = Best(len(a), positives)

        def found(own: np.ndarray, scores: np.ndarray, label: np.ndarray, missing: np.ndarray, id_: np.ndarray, whole: bool = False) -> None:
            r, c = reaching(scores, best.least[own])
            many = len(r) > FEW * positives * len(own)
            if many and not whole and len(label) > FIRST:
                parted(found, own, scores, label, missing, id_)
                return
            if many:
                fits = (label[None] == labels[own, None]) & (missing[None] | (id_[None] != ids[own, None])) & (scores >= best.least[own, None])
                r, c = np.nonzero(strongest(scores, fits, positives))
            else:
                fits = (label[c] == labels[own[r]]) & (missing[c] | (id_[c] != ids[own[r]]))
                r, c = r[fits], c[fits]
            best.add(own[r], scores[r, c], missing[c], id_[c])

        for part in sliced(batches, dim, kind) if len(a) else ():
            for known, blocks in groups:
                own = np.flatnonzero(np.isin(part[1], known))
                if len(own):
                    walked(tuple(x[own] for x in part), a, blocks, lambda own: best.least[own], found)
        yield from listed(best)

    first = stored(firsts(rows.mapInArrow(nearest, FOUND), positives).select("a", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    known = first.select("a", "slot", "positive_score").toArrow()  # `positives` for each anchor of the round
    most, least = np.full((len(a), positives), -np.inf), np.full((len(a), positives), np.inf)
    at = known.column("a").to_numpy(), known.column("slot").to_numpy()
    score = known.column("positive_score").to_numpy()
    most[at], least[at] = high * score // 100, -(-low * score // 100)
    limits = spark.sparkContext.broadcast((most, least))

    def hardest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, _, labels, blocks, _ = sent.value
        most, low_ = limits.value
        best = Best(low_.size, negatives)
        empty = most < low_  # no score is in the band

        def needed(own: np.ndarray) -> np.ndarray:
            return np.where(empty[own], np.inf, np.maximum(low_[own], best.least.reshape(low_.shape)[own])).min(axis=1)

        def found(own: np.ndarray, scores: np.ndarray, label: np.ndarray, missing: np.ndarray, id_: np.ndarray, whole: bool = False) -> None:
            r, c = reaching(scores, needed(own))
            many = len(r) > FEW * negatives * len(own)
            if many and not whole and len(label) > FIRST:
                parted(found, own, scores, label, missing, id_)
                return
            other = label[None] != labels[own, None] if many else label[c] != labels[own[r]]
            near = scores if many else scores[r, c]
            entries = []
            for slot in range(positives):
                row, high_, low = own * positives + slot, most[own, slot], np.maximum(low_[own, slot], best.least.reshape(low_.shape)[own, slot])
                if many:
                    of, at = np.nonzero(strongest(scores, other & (near <= high_[:, None]) & (near >= low[:, None]), negatives))
                else:
                    fits = other & (near <= high_[r]) & (near >= low[r])
                    of, at = r[fits], c[fits]
                entries.append((row[of], scores[of, at], missing[at], id_[at]))
            best.add(*(np.concatenate(x) for x in zip(*entries, strict=True)))

        for part in sliced(batches, dim, kind) if blocks else ():
            walked(part, a, blocks, needed, found)
        yield from listed(best, positives)

    hard = firsts(rows.mapInArrow(hardest, FOUND), negatives).select("a", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = spark.createDataFrame(pa.table({"a": pa.array(np.arange(len(ids))), "anchor_id": pa.array(ids)}))
    return stored(hard.join(first, ["a", "slot"]).join(names, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
