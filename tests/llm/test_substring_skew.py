"""Repeated byte strings where one passage is in a third of all documents and rows lie in many partitions."""

import random

from grainmill.llm import substring_dedup as sub


def test_hot_passage_over_many_partitions_against_all_windows(docs, monkeypatch):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    hot, rare = letters(900), letters(500)
    texts = []
    for k in range(300):
        parts = [letters(rng.randint(0, 500))]
        if k % 3 == 0:
            a = rng.randint(0, 300)
            parts += [hot[a : a + rng.randint(380, 600)], letters(rng.randint(0, 60))]
        if k % 50 == 0:
            parts += [rare, letters(10), rare[20:470]]
        texts.append((k, "".join(parts)))
    seen = {}
    raws = [(i, t.encode()) for i, t in texts]
    for _, b in raws:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    want = []
    for i, b in raws:
        gone = {q for p in range(len(b) - 399) if seen[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        want.append((i, len(b), len(gone), sum(q - 1 not in gone for q in gone), bytes(x for q, x in enumerate(b) if q not in gone)))
    assert sum(w[2] > 0 for w in want) > 60
    for limit in (2000, 40):  # the hot passage by suffix arrays, and by counting windows
        monkeypatch.setattr(sub, "ARRAY_RUNS", limit)
        found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in sub.substring_dedup(docs(texts).repartition(60)).collect()]
        assert sorted(found) == sorted(want)
