"""Hard negatives: tables of one row group are dealt out, positives meet their own labels only, ties and either precision give the same rows."""

import math

import numpy as np
import pytest

from grainmill.llm import hard_negatives as hard


def by_hand(rows, step):
    q = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows]
    out = []
    for i, a, y in q:
        if i % step:
            continue
        scored = [(-sum(p * r for p, r in zip(a, b)), j, z) for j, b, z in q]
        for ps, p, _ in sorted(s for s in scored if s[2] == y and s[1] != i)[:5]:
            band = sorted(s for s in scored if s[2] != y and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(i, p, r, s[1], -ps, -s[0]) for r, s in enumerate(band, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1)


def test_one_partition_is_dealt_out(spark):
    rows = [(k, [float(k), 1.0], k % 3) for k in range(200)]
    found = hard.quantised(frame(spark, rows), "vec_id", "embedding", "label", 256)
    stored = found[0] if isinstance(found, tuple) else found
    assert len(stored.inputFiles()) >= spark.sparkContext.defaultParallelism > 1
    assert sorted(r.id for r in stored.collect()) == list(range(200))


@pytest.mark.parametrize("few", [0, 8, 10**6])
@pytest.mark.parametrize("size", [1, 64])  # scores that are exact in single precision, and others
def test_ties_and_precision(spark, monkeypatch, few, size):
    rng = np.random.default_rng(5)
    kinds = [(rng.normal(size=6) * size).astype(np.float32) for _ in range(12)]
    rows = [(k, [float(x) for x in kinds[int(rng.integers(0, 12)) if k % 3 else 0]], int(rng.integers(0, 20))) for k in range(400)]
    want = by_hand(rows, 10)
    assert len(want) > 100
    monkeypatch.setattr(hard, "FEW", few)
    monkeypatch.setattr(hard, "SLICE", 300)
    got = hard.hard_negatives(frame(spark, rows), anchor=lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_anchors_are_grouped_by_label():
    rng = np.random.default_rng(6)
    anchors, labels = rng.normal(size=(500, 8)), rng.integers(0, 40, 500)
    groups = hard.grouped(anchors, labels)
    assert 1 < len(groups) <= hard.GROUPS
    for known, blocks in groups:
        own = np.concatenate([rows for rows, _, _ in blocks])
        assert sorted(own) == np.flatnonzero(np.isin(labels, known)).tolist()
    assert sorted(np.concatenate([known for known, _ in groups])) == np.unique(labels).tolist()
