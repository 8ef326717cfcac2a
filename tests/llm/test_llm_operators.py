"""Operators over small tables: odd rows, brute force, pipeline."""

import hashlib
import random
import zlib

import numpy as np

from grainmill.llm import near_dedup as near
from grainmill.llm import substring_dedup as sub
from grainmill.llm.decontaminate import decontaminate
from grainmill.llm.licenses import license_scan
from grainmill.llm.line_dedup import line_dedup
from grainmill.llm.main_text import extract
from grainmill.llm.packing import pack
from grainmill.llm.quality import quality_rules
from grainmill.llm.token_files import token_files
from grainmill.llm.tokens import tokenizer_path
from grainmill.llm.toxicity import toxicity


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_line_dedup(docs, odd):
    table = docs([(2, "A shared line here\nown two\n a SHARED line here "), (1, "a shared line here\nx\na shared line here"), (3, "short\nshort"), *odd])
    found = {(r.doc_id, r.kept_text): (r.n_lines, r.n_dropped) for r in line_dedup(table).collect()}
    assert found[2, "own two"] == (3, 2) and found[1, "a shared line here\nx\na shared line here"] == (3, 0) and found[3, "short\nshort"] == (2, 0)
    assert found[3, ""] == (1, 0) and found[1, "one two three four"] == (1, 0) and found[None, ""] == (1, 0)
    assert line_dedup(docs([])).count() == 0


def test_decontaminate(spark, docs, odd):
    bench = spark.createDataFrame([(9, "One, two THREE"), (10, None), (None, "here it is")], "item_id bigint, text string")
    found = {(r.doc_id, r.n_words): r for r in decontaminate(docs(odd), bench, size=10).collect()}
    assert found[1, 4].n_hit == 3 and found[1, 4].items_sha256 == hashlib.sha256(b"9").hexdigest() and found[1, 4].hit_spans == [[0, 3]]
    assert found[None, 5].contaminated and found[None, 5].n_items == 0 and not found[2, 0].contaminated
    assert decontaminate(docs([]), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(docs(odd), bench.limit(0)).collect())


def test_near_dedup_against_all_pairs(docs, odd):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(60)] for _ in range(6)]
    made = []
    for k in range(60):
        text = list(base[k % 6])
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
        made.append((100 + k, " ".join(text)))
    made += [(500, made[0][1]), (501, made[0][1].upper())]
    made += [r for r in odd if r[0] is not None]
    sets = [(i, near.shingles(t, 2)) for i, t in made]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a][1].tolist()), set(sets[b][1].tolist())
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))
    assert sorted(tuple(r) for r in near.near_dedup(docs(made), size=2).collect()) == want
    assert near.near_dedup(docs([])).count() == 0
    assert {(r.doc_id, r.component_id, r.kept) for r in near.near_dedup(docs([(None, "a b c"), (None, None)])).collect()} == {(None, None, True)}


def test_substring_dedup_against_all_windows(docs, odd, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh éß") for _ in range(700))
    texts = [(k, "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 200) : rng.randint(300, 700)] + "z" * rng.randint(0, 500)) for k in range(25)]
    texts += [r for r in odd if len(r[1] or "") < 1000]
    want = []
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in texts]
    for _, b in raws:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    for i, b in raws:
        gone = {q for p in range(len(b) - 399) if seen[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        spans = sum(1 for q in gone if q - 1 not in gone)
        want.append((i, len(b), len(gone), spans, bytes(x for q, x in enumerate(b) if q not in gone)))
    for limit in (2000, 0):  # by suffix arrays, and by counting windows
        monkeypatch.setattr(sub, "ARRAY_RUNS", limit)
        found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in sub.substring_dedup(docs(texts)).collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sub.substring_dedup(docs([])).count() == 0


def test_quality_rules(docs, odd):
    rng = random.Random(1)
    good = [(100 + k, " ".join(rng.choice(["the", "cat", "sat", "on", "some", "mats", "with", "dogs"]) + rng.choice(["", "s", "ly"]) for _ in range(60))) for k in range(30)]
    junk = [(900, "".join(chr(rng.randint(33, 126)) for _ in range(3000)).replace("!", " "))]
    found = {(r.doc_id, r.n_words): r for r in quality_rules(docs(good + junk + odd)).collect()}
    assert all(found[i, 60].kept for i, _ in good)
    assert not next(r for (i, _), r in found.items() if i == 900).kept
    assert found[2, 0].base_failed and found[5, 30000].n_repeat_words == 30000 and found[5, 30000].base_failed
    assert quality_rules(docs([])).count() == 0


def test_toxicity(spark, docs, odd):
    rng = random.Random(3)
    texts, marks = [], []
    for k in range(200):
        toxic = k % 4 == 0
        texts.append((k + 10, " ".join([rng.choice(["nice", "calm", "tree", "river"]) for _ in range(20)] + (["hateful", "vile"] if toxic else []))))
        marks.append((k + 10, int(toxic)))
    labels = spark.createDataFrame([*marks, (None, 1), (11, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity(docs(texts + odd), labels).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in marks)
    assert all(found[i].predicted == t for i, t in marks)
    assert not found[None].held_out and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity(docs([]), labels).count() == 0
    assert {r.predicted for r in toxicity(docs(texts), labels.limit(0)).collect()} == {0}


def test_licenses(spark, docs, odd):
    found = {r.doc_id: r for r in license_scan(docs([(70, "RELEASED under the MIT Licence"), (71, "Text.\nLicensed under CC BY-NC 4.0.\nMore"), *[r for r in odd if r[0] != 1]])).collect()}
    assert found[70].license_id == "MIT" and found[71].license_id is None and found[71].notice_ids == ["CC-BY-NC-4.0"] and found[3].license_id is None
    known = spark.createDataFrame([("own", "one two three four"), (None, "x"), ("empty", "")], "license_id string, text string")
    assert [r.license_id for r in license_scan(docs(odd), known).where("doc_id = 1").collect()] == ["own", "own"]
    assert license_scan(docs([])).count() == 0


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a  b<p>c"), (2, None, None), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string")
    assert rows(extract(pages).drop("n_blocks")) == sorted([(1, "u", "a b\nc", 5), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_token_files_and_packing(docs, odd):
    from tokenizers import Tokenizer

    table = [*odd, (7, "It's  a 'test'\n\nof\tthings <|endoftext|> été"), (8, "word " * 900 + "end")]
    word, byte = (Tokenizer.from_file(tokenizer_path(f)) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    coded = {(i, t): (word.encode(t or "", add_special_tokens=False).ids + [2], byte.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in table}
    index = sorted(token_files(docs(table)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == sorted([i for i, _ in table], key=lambda i: -1 if i is None else i)
    assert [r.start for r in index] == [sum(r.n_tokens for r in index[:k]) for k in range(len(index))]
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in index) == sorted((i or -1, len(coded[i, t][0]), crc(coded[i, t][0])) for i, t in table)
    packed = pack(docs(table)).collect()
    want = []
    for i, t in table:
        ids = coded[i, t][1]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i or -1, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(bins) == -(-sum(w[3] for w in want) // 1024)
    assert pack(docs([])).count() == 0 and token_files(docs([])).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count() <= docs.count()
        docs = kept.cache()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
