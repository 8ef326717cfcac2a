"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, travels

travels(__name__)

#: Bytes to bytes: A-Z lowered; digits, a-z and all bytes of characters beyond ASCII stay; the rest is a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows(text: str | None, size: int) -> list[str]:
    """Each `size` consecutive words, blank-separated; a shorter item is one window, one without words none."""
    found = words(text)
    joined = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    return [w.decode("utf-8", "replace") for w in joined]


def automaton(items: list[tuple[object, str | None]], size: int) -> bytes:
    """The automaton over all windows of all items, pickled; a window's value is (its words, the items that have it)."""
    owners: dict[str, set] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(f" {w} ", (w.count(" ") + 1, tuple(sorted(str(i) for i in ids if i is not None))))
    if owners:
        found.make_automaton()
    return pickle.dumps(found if owners else None)


def scan(text: str | None, found: ahocorasick.Automaton | None) -> tuple[int, list[int], list[str]]:
    """Words of the text, the indices of hit words in order, and the items with an occurrence, sorted.
    The normalised text has one blank before, between and after words, so blanks before an offset count words."""
    own = words(text)
    if not own or found is None:
        return len(own), [], []
    normal = " " + b" ".join(own).decode("utf-8", "replace") + " "
    hit: set[int] = set()
    items: set[str] = set()
    at = counted = 0
    for end, (n, ids) in found.iter(normal):
        counted += normal.count(" ", at, end)
        at = end
        hit.update(range(counted - n, counted))
        items.update(ids)
    return len(own), sorted(hit), sorted(items)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, max_benchmark_mb: int = 256, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Scan documents once for windows of `size` words that a benchmark item also has.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per input row, then hit_spans (word
    index ranges, end exclusive) and the columns of `carry`. Null or empty texts have no words and no hits; an empty
    benchmark hits nothing; items with a null id count hits but are not listed; repeated rows repeat.
    The benchmark is broadcast as one automaton; one above `max_benchmark_mb` of text is refused.
    """
    items = benchmark.select("item_id", "text")
    mb = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 2**20
    if mb > max_benchmark_mb:
        raise ValueError(f"the benchmark has {mb:.0f} MB of text, over max_benchmark_mb={max_benchmark_mb}: scan it in parts")
    shared = docs.sparkSession.sparkContext.broadcast(automaton([(r[0], r[1]) for r in items.collect()], size))

    def start():
        found = pickle.loads(shared.value)

        def one(text: str | None) -> tuple:
            n, hit, ids = scan(text, found)
            breaks = [i for i in range(1, len(hit)) if hit[i] != hit[i - 1] + 1]
            spans = [[hit[a], hit[b - 1] + 1] for a, b in zip([0, *breaks], [*breaks, len(hit)], strict=True)] if hit else []
            return n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), spans

        return one

    return by_row(docs, ["text"], ["doc_id", *carry], "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<array<bigint>>", start)
