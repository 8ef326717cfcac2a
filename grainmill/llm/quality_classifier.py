"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model fitted by
dual coordinate descent."""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, stored, travels
from grainmill.llm.ngram_model import class_counts, distinct, fit_sample, found_in, labelled_texts, log_ratios, marks_of, remainder, rolled_ngrams

travels(__name__)

#: Characters of an n-gram; case is kept.
SIZES = (1, 2, 3, 4)
#: Runs of words that repeat the word before: as long as this, as indicators.
REPEATS = (1, 2, 4, 8)
#: Labelled texts of each class at most, for fitting the weights. The log-count ratios are counted over all labelled texts.
FIT_ROWS = 3000
#: N-grams whose ratio is nearer to 0 say too little.
LEAST_RATIO = 0.5
#: Of the fitting sample one text in so many gives the margins that become probabilities.
CALIBRATE = 5


def features(text: str | None) -> np.ndarray:
    """Keys of the distinct character n-grams (one blank for white space and at both ends) and of runs of repeated words, sorted."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    low = [w.lower() for w in words]
    same = bytes(map(eq, low, low[1:]))
    runs = np.array([k for k in REPEATS if b"\1" * k in same], dtype=np.uint64)
    return distinct([*rolled_ngrams(points, SIZES), *rolled_ngrams(runs, (1,), salt=1)])


def descended(rows: list[tuple[np.ndarray, int]], values: np.ndarray, costs: tuple[float, float], rounds: int = 30, least: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the features and last the bias: the linear model of least hinge loss, by dual coordinate descent.

    A text's vector has its features' values, at length 1, and a 1 for the bias. Each step sets one dual variable, within
    0 and its class's cost, to where its own gradient is 0; a round visits all in a fresh order. Rounds end when no
    projected gradient is over `least`.
    """
    w = np.zeros(len(values) + 1)
    vectors = []
    for places, y in rows:
        v = values[places]
        vectors.append((np.append(places, len(values)), np.append(v / (np.linalg.norm(v) or 1.0), 1.0), 2.0 * y - 1))
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for k in rng.permutation(len(rows)):
            at, x, sign = vectors[k]
            gradient = sign * (w[at] @ x) - 1
            cost = costs[int(sign > 0)]
            if (alpha[k] > 0 or gradient < 0) and (alpha[k] < cost or gradient > 0):
                worst = max(worst, abs(gradient))
                new = min(max(alpha[k] - gradient / (x @ x), 0.0), cost)
                w[at] += (new - alpha[k]) * sign * x
                alpha[k] = new
        if worst < least:
            break
    return w


def margin(w: np.ndarray, values: np.ndarray, places: np.ndarray) -> float:
    v = values[places]
    return float(w[places] @ v / (np.linalg.norm(v) or 1.0) + w[-1])


def calibrated(margins: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets; classes weigh as in the labels."""
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    x = np.stack([margins, np.ones(len(margins))])
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        gradient = x @ (weight * (p - target)) + 1e-4 * ab
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-4 * np.eye(2), gradient)
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Keys, ratios, weights with bias, and the two numbers that turn a margin into a probability."""
    marks = stored(marks_of(labels, "quality", 5, 0), "marks")
    by_class = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    share = min(max((n1 + 0.5) / (n0 + n1 + 1), 0.01), 0.99)
    nothing = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(1), 0.0, math.log(share / (1 - share))
    if not n0 or not n1:
        return nothing
    counts = stored(class_counts(labelled_texts(docs, marks, 5, 0), features), "class-counts")
    keys, ratios = log_ratios(counts, n0, n1, LEAST_RATIO)
    rows = fit_sample(docs, marks, keys, features, fit_rows)
    # Texts alike in features are kept on one side, so that no copy of a fitted text is calibrated on.
    held = [zlib.crc32(x.tobytes()) % CALIBRATE == 0 for x, _ in rows]
    fitted = [r for r, out in zip(rows, held, strict=True) if not out]
    rest = [r for r, out in zip(rows, held, strict=True) if out] or fitted
    if len({y for _, y in fitted}) < 2:
        return nothing
    n_fit = np.bincount([y for _, y in fitted], minlength=2)
    w = descended(fitted, ratios, costs=(len(fitted) / 2 / n_fit[0], len(fitted) / 2 / n_fit[1]))
    margins = np.array([margin(w, ratios, x) for x, _ in rest])
    return keys, ratios, w, *calibrated(margins, np.array([y for _, y in rest]), share)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score whole texts: doc_id, held_out, score in 0..1 (higher: label 1 likelier), predicted and the columns of `carry`,
    one row per input row.

    held_out: crc32(doc_id as text) mod 5 is 0; such rows never train; a null id is not held out and does not train. Null,
    empty and blank texts have no n-grams and are scored by the bias. Only text enters a score. Repeated rows repeat.
    Where labels of an id differ the higher holds; null labels are left out. Without labels of both classes every text has
    the share of label 1 as its score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))

    def start():
        keys, ratios, w, a, b = sent.value

        def one(doc_id: object, text: str | None) -> tuple:
            z = a * margin(w, ratios, found_in(keys, features(text))) + b
            p = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
            return remainder(doc_id, 5) == 0, p, int(p >= threshold)

        return one

    return by_row(docs, ["doc_id", "text"], ["doc_id", *carry], "held_out boolean, score double, predicted int", start)
