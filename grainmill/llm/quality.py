"""Quality rules: plain counts of a text, and the perplexity of a modified Kneser-Ney model of byte n-grams.

The model is counted by Spark over all documents, per language. Its probabilities lie in the shared folder, in files
sorted by language and n-gram, as many as the n-grams need; scoring tasks map them, and nothing of them passes the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from grainmill.llm.common import by_row, shared_folder, stored, travels

travels(__name__)

#: Bytes of an n-gram: at most 7, so that it is a 64-bit integer itself and no two share one.
ORDER = 5
#: Bytes of a text at which chance and what is peculiar to the text move its mean log probability alike.
EVEN_BYTES = 7000.0
#: N-grams in a file of the model.
FILE_GRAMS = 1 << 20
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1 << 21
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more. Windows are compared by 64-bit hashes."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, dtype=bool)
    twice[:-1] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    starts = order[twice[:-1]]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(raw: bytes, words: list[bytes], text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK_BYTES)]
    blanks = len(raw) - len(raw.translate(None, BLANK_BYTES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def grams(stream: bytes, order: int) -> np.ndarray:
    """The stream's n-grams as integers, one byte of them to eight bits, the first byte highest; none with a zero byte."""
    b = np.frombuffer(stream, dtype=np.uint8)
    n = len(b) - order + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    out = b[:n].astype(np.int64)
    for k in range(1, order):
        out <<= 8
        out |= b[k : k + n]
    if 0 in stream:
        zeros = np.concatenate([[0], np.cumsum(b == 0)])
        out = out[zeros[order:] == zeros[:-order]]
    return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def language(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) >> 1


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """language, gram, n: how often each n-gram of bytes occurs in the words of the documents, joined by one blank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        apart = bytes(order - 1)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for at in range(0, len(keys), 65536):
                    part = slice(at, at + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), lang)), pa.array(keys[part]), pa.array(n[part])], names=["language", "gram", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                streams: dict[int, list[bytes]] = {}
                for lang, text in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("lang", "text")), strict=True):
                    streams.setdefault(language(lang), []).append(b" " + b" ".join((text or "").encode().split()) + b" ")
                for lang, texts in streams.items():
                    new = counted(grams(apart.join(texts), order))
                    held.setdefault(lang, []).append(new)
                    size += len(new[0])
            if size > HELD:  # merge what is held; what is still too much goes on
                held = {lang: [counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))] for lang, parts in held.items()}
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > HELD // 2:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    each = docs.select("lang", "text").mapInArrow(count, "language bigint, gram bigint, n bigint")
    return each.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def _discounts(levels: DataFrame) -> DataFrame:
    """language, k and what counts of 1, 2 and more give up (d1, d2, d3), from how many of the language's n-grams of that order
    occur once to four times. Counts of counts of small corpora can be zero or out of order; a discount stays between 0 and its count."""
    times = levels.where("n <= 4").groupBy("language", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def discount(i: int) -> Column:
        a, b = F.col(f"n{i}"), F.col(f"n{i + 1}")
        return F.when(a > 0, F.greatest(F.least(i - (i + 1) * y * b / F.nullif(a, F.lit(0)), F.lit(i - 0.05)), F.lit(0.05))).otherwise(0.5)

    return times.select("language", "k", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """language, gram, log_p: the interpolated log probability of each n-gram's last byte after the others, from n-gram counts.

    Lower orders count the distinct bytes before a gram. Discounts of each language and order for counts 1, 2 and more follow
    from the counts of counts.
    """
    top = stored(counts, "grams")
    shorter = [F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("longer")) for k in range(1, order)]
    longer = top.select("language", F.inline(F.array(*shorter))).distinct()
    lower = longer.groupBy("language", "k", F.expr("longer & (shiftleft(1L, 8 * k) - 1)").alias("gram")).agg(F.count("*").alias("n"))
    levels = stored(top.select("language", F.lit(order).alias("k"), "gram", "n").unionAll(lower), "levels")
    n = F.col("n")
    discount = F.coalesce(F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")), F.lit(0.5))
    levels = levels.join(stored(_discounts(levels), "discounts"), ["language", "k"], "left")
    seen = levels.withColumn("context", F.shiftright("gram", 8))
    weights = seen.groupBy("language", "k", "context").agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
    table = stored(seen.join(weights, ["language", "k", "context"]).select("language", "k", "gram", "weight", ((n - discount) / F.col("total")).alias("own")), "weights")

    below = table.where("k = 1").select("language", "gram", (F.col("own") + F.col("weight") / 256).alias("p"))
    for k in range(2, order + 1):
        rest = below.select("language", F.col("gram").alias("rest"), F.col("p").alias("below"))
        level = table.where(F.col("k") == k).withColumn("rest", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        below = level.join(rest, ["language", "rest"]).select("language", "gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
    return below.select("language", "gram", F.log("p").cast("float").alias("log_p"))


def model_files(model: DataFrame, file_grams: int = FILE_GRAMS) -> tuple[str, list[Row]]:
    """Write the model to the shared folder: each range of (language, gram) to files of sorted grams and their values.

    Returns the folder and a row per file: language, least (its first gram), n, name. A task that runs twice writes other names.
    """
    folder = f"{shared_folder(model.sparkSession)}/kneser-ney-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("language", "gram", "log_p")] for batch in batches]
        if not parts:
            return
        langs, keys, values = (np.concatenate(column) for column in zip(*parts, strict=True))
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        made = []
        for lang in np.unique(langs):
            own, name = langs == lang, uuid.uuid4().hex
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(keys[own].astype("<i8").tobytes())
                out.write(values[own].astype("<f4").tobytes())
            made.append((int(lang), int(keys[own][0]), int(own.sum()), name))
        columns = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=["language", "least", "n", "name"])

    model = stored(model, "model")
    dealt = model.repartitionByRange(model.count() // file_grams + 1, "language", "gram").sortWithinPartitions("language", "gram")
    return folder, dealt.mapInArrow(write, "language bigint, least bigint, n bigint, name string").orderBy("language", "least").collect()


def scorer(folder: str, files: list[Row], order: int) -> Callable[[list[bytes], str | None], float | None]:
    """A function from a text's words and language to its log perplexity per byte; None if it has no whole n-gram.

    The texts are those that were counted. Files on a mounted folder are mapped, others read, when a text first needs them.
    """
    store, path = fs.FileSystem.from_uri(folder)
    own: dict[int, list[Row]] = {}
    for row in files:
        own.setdefault(row["language"], []).append(row)
    leasts = {lang: np.array([r["least"] for r in rows], dtype=np.int64) for lang, rows in own.items()}
    opened: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def arrays(row: Row) -> tuple[np.ndarray, np.ndarray]:
        if row["name"] not in opened:
            name, n = f"{path}/{row['name']}", row["n"]
            if isinstance(store, fs.LocalFileSystem):
                raw = np.memmap(name, dtype=np.uint8, mode="r")
            else:
                with store.open_input_file(name) as file:
                    raw = np.frombuffer(file.read(), dtype=np.uint8)
            opened[row["name"]] = np.asarray(raw[: 8 * n]).view("<i8"), np.asarray(raw[8 * n :]).view("<f4")
        return opened[row["name"]]

    def score(words: list[bytes], lang: str | None) -> float | None:
        keys, times = counted(grams(b" " + b" ".join(words) + b" ", order))
        if not len(keys):
            return None
        code = language(lang)
        logs = np.zeros(len(keys))
        edges = [0, *np.searchsorted(keys, leasts[code][1:]).tolist(), len(keys)]
        for row, start, end in zip(own[code], edges, edges[1:], strict=False):
            if start < end:
                known, values = arrays(row)
                at = np.minimum(np.searchsorted(known, keys[start:end]), len(known) - 1)
                if (known[at] != keys[start:end]).any():
                    raise ValueError("a text has n-grams that were not counted")
                logs[start:end] = values[at]
        return float(-(logs * times).sum() / times.sum())

    return score


def measured(docs: DataFrame, carry: tuple[str, ...] = (), order: int = ORDER) -> DataFrame:
    """The counts of BASE, base_failed, and log_ppl under the model of all `docs`."""
    folder, files = model_files(kneser_ney(gram_counts(docs, order), order))
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def start():
        score = scorer(folder, shared.value, order)

        def one(text: str | None, lang: str | None) -> tuple:
            raw = (text or "").encode()
            words = raw.split()
            found = base_counts(raw, words, text or "")
            return *found, found[0] < 20 or 100 * found[4] > 30 * found[0], score(words, lang) if words else None

        return one

    return by_row(docs, ["text", "lang"], list(dict.fromkeys(["doc_id", "lang", *carry])), f"{BASE}, base_failed boolean, log_ppl double", start)


def scale_of(size: Column, even_bytes: float) -> Column:
    """How much wider than those of a very long text a text's deviations are: what is peculiar to a text does not shrink with its
    length, chance does, and at `even_bytes` they weigh alike."""
    return F.sqrt(1 + even_bytes / F.greatest(size, F.lit(1)))


def perplexity_bands(scored: DataFrame, least_spread: float = 0.005, even_bytes: float = EVEN_BYTES) -> DataFrame:
    """_lang, middle, low, high: the median log perplexity of a language's documents that pass the base rules, and the spread
    on either side of it, that of a normal distribution with the same quartile on that side of the deviations over their scale.

    Values are rounded to 0.001, so the exact quartiles need a few thousand counters whatever the number of documents.
    """
    lang = F.coalesce("lang", F.lit("")).alias("_lang")
    passed = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select(lang, "log_ppl", scale_of(F.col("word_chars") + F.col("n_words"), even_bytes).alias("scale"))
    middles = stored(passed.groupBy("_lang").agg(F.percentile(F.round("log_ppl", 3), 0.5).alias("middle")), "middles")
    deviations = passed.join(middles, "_lang").withColumn("d", F.round((F.col("log_ppl") - F.col("middle")) / F.col("scale"), 3))
    quartiles = deviations.groupBy("_lang", "middle").agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    low, high = (F.greatest((F.col("q")[k + 1] - F.col("q")[k]) / 0.6745, F.lit(least_spread)) for k in (0, 1))
    return quartiles.select("_lang", "middle", low.alias("low"), high.alias("high"))


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = (), below: float = 2.6, above: float = 2.3, even_bytes: float = EVEN_BYTES) -> DataFrame:
    """Base counts of every document and the verdict of language-specific perplexity bands.

    Returns doc_id, lang, the columns of BASE, base_failed, log_ppl, lower, upper, kept and the columns of `carry`, one row per input row.
    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that recur in the text. kept: not
    base_failed, and log_ppl within its language's band: `below` spreads under the median, since text that repeats itself or is
    made of one symbol lies there, and `above` over it, for gibberish and text in quite another language, wider for short texts;
    a text without a whole n-gram (zero bytes break them) is not kept. Null or empty text has no words and fails; a null language
    is one language of its own; repeated rows count and repeat.
    """
    scored = stored(measured(docs, carry), "quality")
    bands = stored(perplexity_bands(scored, even_bytes=even_bytes), "bands")
    scale = scale_of(F.col("word_chars") + F.col("n_words"), even_bytes)
    joined = scored.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(bands, "_lang", "left")
    joined = joined.withColumn("lower", F.col("middle") - below * F.col("low") * scale).withColumn("upper", F.col("middle") + above * F.col("high") * scale)
    within = F.col("log_ppl").between(F.col("lower"), F.col("upper"))
    names = [line.split()[0] for line in BASE.split(", ")]
    return joined.select("doc_id", "lang", *names, "base_failed", "log_ppl", "lower", "upper", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), *(c for c in carry if c != "lang"))
