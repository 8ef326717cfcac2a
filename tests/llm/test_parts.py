"""Operators' plain parts against brute force."""

import random
import zlib

import numpy as np
import pytest

from grainmill.llm import near_dedup
from grainmill.llm.decontaminate import scan, windows, words
from grainmill.llm.licenses import canonical, digest
from grainmill.llm.main_text import main_blocks
from grainmill.llm.packing import fullest, pieces, plan
from grainmill.llm.quality import repeated_words
from grainmill.llm.range_coder import BLOCK, decode, encode
from grainmill.llm.substring_dedup import least_places
from grainmill.llm.suffix_array import common_prefixes, smaller_than_next, suffix_array
from grainmill.llm.token_files import joined_crc


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(5)
    for _ in range(500):
        s = bytes(rng.choice(rng.choice([b"ab", b"a", b"\0\xff", bytes(range(256))])) for _ in range(rng.randint(0, 60)))
        a = np.frombuffer(s, dtype=np.uint8)
        assert suffix_array(a, 100).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert smaller_than_next(a).tolist() == [s[i:] < s[i + 1 :] for i in range(len(s))]


def test_common_prefixes_stop_at_the_end():
    s = np.frombuffer(b"abcabd", dtype=np.uint8)
    assert common_prefixes(s, np.array([0, 3, 5]), 4).tolist() == [2, 0]


def test_least_places_takes_the_last_of_equals():
    values = np.array([5, 3, 3, 9, 1, 1], dtype=np.uint64) << np.uint64(30)
    assert least_places(values, 3).tolist() == [2, 2, 4, 5]


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 49408, n) for n in (0, 1, 2, 100, BLOCK)] + [np.tile([5, 9, 49407, 0], 500), np.zeros(BLOCK, int), np.minimum(rng.zipf(1.3, 3000) - 1, 49407)]
    coded = encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode(coded), strict=True))
    assert decode([coded[3]])[0].tolist() == blocks[3].tolist()  # a block stands alone
    assert len(coded[6]) < 100 < len(coded[4]) < 3 * BLOCK
    for damaged in (coded[3][:-2], b"", coded[3][:40] + bytes([coded[3][40] ^ 1]) + coded[3][41:]):
        with pytest.raises(ValueError):
            decode([damaged])
    with pytest.raises(ValueError):
        encode([np.array([49408])])
    assert encode([]) == [] and decode([]) == []


def test_joined_crc():
    a, b = b"some bytes", b"and more of them" * 9
    assert joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        chosen = fullest(counts, room)
        assert sum(chosen) == max(sums) and all(chosen.count(x) <= counts[x] for x in chosen)


def test_plan_places_each_piece_once_without_gaps():
    counts = {1024: 3, 700: 5, 324: 4, 300: 9, 24: 7, 1: 30}
    bins = {}
    placed = dict.fromkeys(counts, 0)
    for length, first, per_bin, first_bin, times, offset in plan(counts, 1024):
        assert first == placed[length]
        placed[length] += per_bin * times
        for b in range(first_bin, first_bin + times):
            bins.setdefault(b, []).extend((offset + k * length, length) for k in range(per_bin))
    assert placed == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == -(-sum(k * n for k, n in counts.items()) // 1024)


def test_only_long_documents_are_cut():
    assert [p[2] for p in pieces(bytes(4 * 10), 4)] == [2, 4, 4]
    assert [p[2] for p in pieces(bytes(4 * 8), 4)] == [4, 4]
    assert [p[:3] for p in pieces(bytes(4 * 3), 4)] == [(0, 0, 3)]


def test_repeated_words_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        own = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        found = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        hit = {j for i, w in enumerate(found) if found.count(w) > 1 for j in range(i, i + 8)}
        assert repeated_words(own) == len(hit)


def test_scan_against_brute_force():
    from grainmill.llm.decontaminate import automaton
    import pickle

    rng = random.Random(4)
    for _ in range(200):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for k in range(4)]
        text = " ".join(rng.choice(["a", "B", "c", "é"]) for _ in range(rng.randint(0, 30)))
        own = [w.decode() for w in words(text)]
        hit, ids = set(), set()
        for item, t in items:
            for w in windows(t, 3):
                w = w.split(" ")
                for i in range(len(own) - len(w) + 1):
                    if own[i : i + len(w)] == w:
                        hit |= set(range(i, i + len(w)))
                        ids.add(str(item))
        assert scan(text, pickle.loads(automaton(items, 3))) == (len(own), sorted(hit), sorted(ids))
    assert scan("a b", None) == (2, [], []) and scan(None, None) == (0, [], [])


def test_canonical_licence_text():
    assert canonical("Copyright (c) 2020 A B\nAll rights reserved.\n1. The  Licence, “quoted” – COLOR\n") == b"the license quoted colour"
    assert digest("Released under the MIT Licence") == digest("released under  the MIT license.")
    assert digest(None) == digest("  ") and digest(None)[0] == 0


def test_main_text_of_pages():
    page = (
        '<html><body><header><h1>Site</h1></header><div class="nav"><a href=x>Home</a></div><div id="content"><h2>Title</h2><p>First, with text; <i>more</i>\n text.'
        "<p>Second &amp; last one, folks. It is long.<script>x='<p>'</script></div><div class=sidebar><p>Buy now, please.</p></div>"
        "<div id='comments'><p>Great post! I like it, a lot.</p></div><form>Name</form></body>"
    )
    assert main_blocks(page) == ["Title", "First, with text; more text.", "Second & last one, folks. It is long."]
    assert main_blocks(None) == [] and main_blocks("<p></p>") == [] and main_blocks("<!-- x") == []
    assert main_blocks("<body><nav>m</nav><article><h1>H</h1><p><b>Bold.<br><p>Next</article><footer>f</footer>") == ["H", "Bold.", "Next"]


def test_parities_differ_at_most_as_often_as_shingles():
    words = [f"w{k}" for k in range(1500)]
    for n in (3, 40, 300, 1400):
        for changed in (0, 1, n // 10, n // 2):
            other = [w if k >= changed else f"x{k}" for k, w in enumerate(words[:n])]
            one, two = near_dedup.shingles(" ".join(words[:n])), near_dedup.shingles(" ".join(other))
            odds = [near_dedup.signature(s)[2][near_dedup.WORDS :] for s in (one, two)]
            differ = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(*odds, strict=True))
            alone = len(np.setxor1d(one, two))
            assert len(odds[0]) == near_dedup.ODD_WORDS
            assert differ <= alone and (differ - alone) % 2 == 0
