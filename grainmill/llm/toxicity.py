"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from grainmill.llm.common import by_row, stored, travels
from grainmill.llm.ngram_model import class_counts, distinct, fit_sample, found_in, labelled_texts, log_ratios, marks_of, remainder, rolled_ngrams

travels(__name__)

SIZES = (3, 4, 5)
#: Labelled rows of each class at most, for fitting the weights. The log-count ratios are counted over all labelled rows.
FIT_ROWS = 3000
#: N-grams whose log-count ratio is nearer to 0 say too little to be features.
LEAST_RATIO = 1.5


def features(text: str | None) -> np.ndarray:
    """Keys of the distinct character n-grams of the lower-cased words, one blank between words and at both ends, sorted."""
    joined = " " + " ".join((text or "").lower().split()) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return distinct(rolled_ngrams(points, SIZES))


def fit(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, prior: float, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the features, already times their ratio, and last the bias. Logistic loss, Adam over all rows; the
    classes weigh as much as in the labels (`prior`: share of toxic rows there)."""
    labels = np.array([y for _, y in rows], dtype=float)
    flat = np.concatenate([x for x, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    value = ratio[flat]
    weight = np.where(labels == 1, prior / max(labels.sum(), 1), (1 - prior) / max((1 - labels).sum(), 1))
    w, bias = np.zeros(len(ratio)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[flat], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = np.append(np.bincount(flat, value * error[row], minlength=len(w)) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return np.append(w * ratio, bias)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of n-grams, and their weights with the bias, from the labelled documents whose crc32(doc_id) mod 4 is not 2.

    Log-count ratios use all of them; the weights are fitted on at most `fit_rows` of each class, those with the
    smallest hash of the id. Labels of one doc_id that differ count as toxic; null labels are left out.
    Without both classes the result scores every text alike, by the share of toxic rows.
    """
    marks = stored(marks_of(labels, "toxic", 4, 2), "marks")
    by_class = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    clean, toxic = by_class.get(0, 0), by_class.get(1, 0)
    share = min(max(toxic / (clean + toxic) if clean + toxic else 0.0, 0.01), 0.99)
    nothing = np.zeros(0, dtype=np.uint64), np.array([math.log(share / (1 - share))])
    if not clean or not toxic:
        return nothing
    counts = stored(class_counts(labelled_texts(docs, marks, 4, 2), features), "class-counts")
    keys, ratios = log_ratios(counts, clean, toxic, LEAST_RATIO)
    rows = fit_sample(docs, marks, keys, features, fit_rows)
    return (keys, fit(rows, ratios, share)) if len({y for _, y in rows}) == 2 else nothing


def classifier(keys: np.ndarray, weights: np.ndarray) -> Callable[[str | None], float]:
    def score(text: str | None) -> float:
        z = float(weights[found_in(keys, features(text))].sum() + weights[-1])
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score whole texts: doc_id, held_out, score in 0..1, predicted and the columns of `carry`, one row per input row.

    held_out: crc32(doc_id as text) mod 4 is 2; such rows never train; a null id is not held out and does not train.
    Null and empty texts are scored by the blanks alone. Only text enters a score. Repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit_rows))

    def start():
        score = classifier(*shared.value)

        def one(doc_id: object, text: str | None) -> tuple:
            p = score(text)
            return remainder(doc_id, 4) == 2, p, int(p >= threshold)

        return one

    return by_row(docs, ["doc_id", "text"], ["doc_id", *carry], "held_out boolean, score double, predicted int", start)
