"""Lexical search, hard negatives and the quality classifier against brute force and held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from grainmill.llm import hard_negatives as hard
from grainmill.llm import lexical_search as lex
from grainmill.llm import ngram_model
from grainmill.llm import quality_classifier as quality
from grainmill.llm.best import Best


def by_hand(docs, items, k):
    words = [(i, lex.terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in set(items):
        asked = Counter(lex.terms(text))
        scored = []
        for i, w in words:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, q in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def made_docs(rng, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300])))) for k in range(n)]


def test_lexical_search_against_all_documents(spark, docs, odd, monkeypatch):
    rng = random.Random(11)
    table = made_docs(rng, 400) + [r for r in odd] + [(900 + k, "same W7, w8-w9 é") for k in range(30)]
    items = [(k, " ".join(rng.choice(table)[1].split()[:12]) if k % 3 else f"w{k} w7 w7 w9 é") for k in range(12)]
    items = [(k, t) for k, t in items if t] + [(1, "same w7"), (1, "same w7"), (50, None), (51, ""), (None, "one two"), (52, "nothing_of-this zzz")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = by_hand(table, [(i, t) for i, t in items], 10)
    monkeypatch.setattr(lex, "BUCKET", 64)
    got = lex.lexical_search(docs(table), bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    monkeypatch.setattr(lex, "ITEM_BYTES", 200)  # several rounds
    assert sorted((tuple(r) for r in lex.lexical_search(docs(table), bench).collect()), key=repr) == want
    assert lex.lexical_search(docs([]), bench).count() == 0 and lex.lexical_search(docs(table), bench.limit(0)).count() == 0
    assert lex.lexical_search(docs([(1, None), (2, "")]), bench).count() == 0


def test_buckets_leave_out_only_what_cannot_reach(spark):
    rng = np.random.default_rng(5)
    import pyarrow as pa

    size = 50
    t = [np.sort(rng.choice(size, rng.integers(1, 20), replace=False)).astype(np.int32) for _ in range(300)]
    v = [rng.integers(1, 10**9, len(x)) for x in t]
    length = [float(np.sqrt((x.astype(float) ** 2).sum())) for x in v]
    bucket = lex.Bucket(pa.table({"doc_id": pa.array(range(300), pa.int64()), "length": length, "t": pa.array(t, pa.list_(pa.int32())), "v": pa.array(v, pa.list_(pa.int64()))}), size)
    left_out = 0
    for _ in range(50):
        item, q = np.sort(rng.choice(size, 6, replace=False)), rng.integers(1, 4, 6)
        dense = np.zeros(size, dtype=np.int64)
        dense[item] = q
        exact = np.array([(dense[a] * b).sum() for a, b in zip(t, v, strict=True)])
        least = np.sort(exact)[-10]
        kept = bucket.survivors(item, q, least)
        assert set(np.flatnonzero(exact >= least)) <= set(kept)
        assert (bucket.scores(kept, item, q, np.zeros(size, dtype=np.int64)) == exact[kept]).all()
        left_out += 300 - len(kept)
    assert left_out > 5000


def negatives_by_hand(rows, step, positives=5, negatives=3):
    usable = [(i, tuple(math.floor(256 * float(x)) for x in v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, y in usable:
        if i is None or i % step:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j is None, j or 0, z) for j, b, z in usable if j is None or j != i or z != y]
        same = sorted(s for s in scored if s[3] == y and (s[1] or s[2] != i))[:positives]
        for ps, none, p, _ in same:
            band = sorted(s for s in scored if s[3] != y and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:negatives]
            out += [(i, None if none else p, r, None if s[1] else s[2], -ps, -s[0]) for r, s in enumerate(band, 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2.0, 3) for i, v, y in rows], "vec_id bigint, embedding array<float>, label int, a int, score double, slot int")


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(500):
        v = centres[k % 6] * rng.uniform(0.2, 2) + rng.normal(size=8) * (0.05 if k % 5 else 1)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 4))))
    rows += [(7, rows[3][1], 1), (20, rows[20][1], rows[20][2]), (None, rows[0][1], 0), (None, rows[0][1], 1), (600, None, 1), (601, rows[1][1], None), (602, [1.0] * 7 + [float("nan")], 1),
             (603, [1.0, None] + [0.5] * 6, 1), (604, [float("inf")] * 8, 2), (605, [0.0] * 8, 2), (610, [], 1), (620, [0.25, 1.0], 2)]
    want = negatives_by_hand(rows, 10)
    kinds = {"anchor": lambda i: i % 10 == 0}
    assert len(want) > 300
    for room in (32 << 20, 1500):  # in one round, and in several
        monkeypatch.setattr(hard, "ROUND_BYTES", room)
        monkeypatch.setattr(hard, "STEP", 16 if room < 2000 else 1024)
        monkeypatch.setattr(hard, "SLICE", 300)
        got = hard.hard_negatives(vectors(spark, rows), **kinds)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert hard.hard_negatives(vectors(spark, []), **kinds).count() == 0
    assert hard.hard_negatives(vectors(spark, rows[1:9]), **kinds).count() == 0  # no anchors
    assert hard.hard_negatives(vectors(spark, [(0, [1.0], 1)]), **kinds).count() == 0  # nothing but the anchor


def test_walks_stop_early_where_bounds_allow():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 100
    v = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 4)
    anchors = v[::50]
    blocks = hard.blocks_of(anchors, hard.centres_of(anchors, 40))
    best, seen = Best(len(anchors), 5), []

    def found(own, scores, missing, ids):
        seen.append(scores.size)
        r, c = np.nonzero(scores >= best.least[own, None])
        best.add(own[r], scores[r, c], missing[c], ids[c])

    hard.walked((v, np.zeros(4000, dtype=bool), np.arange(4000)), anchors, blocks, lambda own: best.least[own], found)
    assert sum(seen) < 0.6 * len(anchors) * len(v)
    row, score, _, ids = best.entries
    exact = anchors @ v.T
    for a in range(len(anchors)):
        order = np.lexsort((np.arange(4000), -exact[a]))[:5]
        assert ids[row == a].tolist() == order.tolist() and score[row == a].tolist() == exact[a, order].tolist()


def test_quality_classifier(spark, docs, odd):
    rng = random.Random(4)
    good = [(1000 + k, " ".join(rng.choice(["the", "cat", "river", "stone", "walks", "slowly"]) + rng.choice(["", "s", "er"]) for _ in range(40))) for k in range(150)]
    symbols = [(2000 + k, " ".join(w + rng.choice(["###", "$$$"]) for w in t.split())) for k, (_, t) in enumerate(good[:40])]
    repeats = [(3000 + k, " ".join([t.split()[0]] * 40)) for k, (_, t) in enumerate(good[:40])]
    table = good + symbols + repeats
    labels = spark.createDataFrame([(i, int(i < 2000), 5) for i, _ in table] + [(None, 0, 5), (1001, None, 5), (1002, 0, 5), (77, 1, 5)], "doc_id bigint, quality int, text int")
    found = {(r.doc_id, r.held_out): r for r in quality.quality_scores(docs(table + odd), labels, carry=("lang",)).collect()}
    assert found[1000, zlib.crc32(b"1000") % 5 == 0].lang == "en"
    for i, _ in table:
        r = found[i, zlib.crc32(str(i).encode()) % 5 == 0]
        assert r.predicted == int(i < 2000) and 0 <= r.score <= 1
    assert not found[None, False].held_out
    assert quality.quality_scores(docs([]), labels).count() == 0
    assert {round(r.score, 6) for r in quality.quality_scores(docs(table), labels.limit(0)).collect()} == {0.5}
    assert len(quality.features(None)) == 0 == len(quality.features(" \n"))


def test_dual_coordinate_descent_reaches_the_least_loss():
    rng = np.random.default_rng(9)
    values = rng.normal(size=30)
    rows = [(np.sort(rng.choice(30, 8, replace=False)), int(rng.integers(0, 2))) for _ in range(60)]
    costs = (1.5, 0.7)
    w = quality.descended(rows, values, costs, rounds=2000, least=1e-8)
    x = np.zeros((60, 31))
    for k, (places, _) in enumerate(rows):
        x[k, places] = values[places] / np.linalg.norm(values[places])
    x[:, 30] = 1
    y = np.array([2 * r[1] - 1 for r in rows])
    c = np.where(y > 0, costs[1], costs[0])
    loss = lambda w: w @ w / 2 + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    for _ in range(300):
        assert loss(w) <= loss(w + rng.normal(size=31) * 0.01) + 1e-9


def test_counts_of_ngrams_by_class(spark):
    texts = spark.createDataFrame([("ab", 0), ("abc", 1), ("ab ab", 1), (None, 0), ("", 1)], "text string, y int")
    want = {}
    for text, y in texts.collect():
        for key in quality.features(text).tolist():
            want.setdefault(key, [0, 0])[y] += 1
    got = {r.key % 2**64: [r.n0, r.n1] for r in ngram_model.class_counts(texts, quality.features).collect()}
    assert got == want
