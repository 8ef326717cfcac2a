"""The near-dedup stage of the pipeline against brute force, with null and repeated ids."""

import random

import pytest

from corpus_pipeline import COLUMNS, near_duplicates
from grainmill.llm import near_dedup as near


def test_stage_against_all_pairs(spark, docs):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(80)] for _ in range(5)]
    texts = []
    for k in range(30):
        text = list(base[k % 5])
        if k % 3:
            text[rng.randrange(80)] = f"x{k}"
        texts.append((rng.choice([None, None, 1, 2, 3, 40 + k]), " ".join(text)))
    texts += [(i, " ".join(f"u{rng.randint(0, 9999)}" for _ in range(30))) for i in (None, None, None, 1, 1, 2, 77)]
    texts += [(77, "same words here"), (77, "same words here"), (None, "same  words here"), (None, None), (3, ""), (3, " \n")]
    rows = [(i, t) for i, t in texts]
    sets = [set(near.shingles(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[group[k]] = min(least.get(group[k], (True, 0)), (i is None, i or 0))
    kept = near_duplicates(spark, docs(texts), "")
    assert kept.columns == COLUMNS
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    left = {}
    for row in found:
        assert row in rows
        left.setdefault(group[rows.index(row)], []).append(row)
    assert len(found) == len(set(group)) == len(left)
    assert all((own[0][0] is None, own[0][0] or 0) == least[g] for g, own in left.items())
    assert sum(i is None for i, _ in found) >= 4


def test_percent_beyond_the_constants_is_refused(docs):
    for percent in (50, 65, 79, 101):
        with pytest.raises(ValueError):
            near.near_dedup(docs([(1, "a b c")]), percent=percent)
