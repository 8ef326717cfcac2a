"""Similarity of labels: the matching-blocks ratio and an exact candidate join."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio_function():
    def ratio(source: pd.Series, candidate: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(source, candidate)], dtype="float64")

    return ratio


# 2 * matched characters / total length. Not symmetric: the source goes first. Only called on
# distinct label pairs that passed edit_filter(). Built inside a function so that it travels by value and
# workers need not import this package.
similarity_ratio = F.pandas_udf(_ratio_function(), T.DoubleType())


def edit_filter(source: Column, candidate: Column, min_ratio: float) -> Column:
    """Necessary condition for ratio >= min_ratio, evaluated in the JVM.

    The unmatched characters number at least the edit distance, so the distance cannot
    exceed (1 - min_ratio) * total length.
    """
    return F.levenshtein(source, candidate) <= _budget(source, candidate, min_ratio)


def _budget(source: Column, candidate: Column, min_ratio: float) -> Column:
    slack = round((1 - min_ratio) * 100)
    return F.floor((F.length(source) + F.length(candidate)) * slack / 100).cast("int")


def _numbered_letters(key: Column) -> Column:
    """The letters of a key; the nth repeat of a letter carries n, so they form a set."""
    letters = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.substr(key, i, F.lit(1)))
    return F.transform(
        letters,
        lambda p, i: F.concat(p, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda q: q == p)).cast("string")),
    )


def _shared_letters(length: Column, other: Column, min_ratio: float) -> Column:
    """Letters that keys of these lengths have in common at least: as many as are matched."""
    return F.ceil((length + other) * F.lit(min_ratio / 2) - F.lit(1e-9)).cast("int")


def similar_pairs(sources: DataFrame, candidates: DataFrame, min_ratio: float, within: Sequence[str] = ()) -> DataFrame:
    """Every (source_key, candidate_key, ratio) with ratio >= min_ratio and keys that differ.

    Both inputs have one distinct `key` column, not empty; min_ratio is over 0. With `within`, both also have those columns,
    keys are distinct for them, and only keys that agree in them are paired. Matched characters are
    letters that both keys have, so two keys this close share a computable number of numbered letters; with letters
    ordered from rare to common, they share one within a computable prefix. Keys are joined on such a letter and on the
    candidate's length, which finds every pair at any ratio without comparing all with all.
    """
    shortest = min_ratio / (2 - min_ratio)
    letters = {side: keys.select(*within, "key", F.explode(_numbered_letters(F.col("key"))).alias("letter")) for side, keys in (("s", sources), ("c", candidates))}
    counts = letters["s"].select("letter").unionAll(letters["c"].select("letter")).groupBy("letter").agg(F.count("*").alias("uses"))

    def ordered(side: str) -> DataFrame:
        # One row per numbered letter: else Spark, which expects few letters of the keys too, may broadcast those.
        return letters[side].join(F.broadcast(counts), "letter").groupBy(*within, "key").agg(F.array_sort(F.collect_list(F.struct("uses", "letter"))).alias("letters"))

    def prefix(shared: Column) -> Column:
        return F.slice("letters", F.lit(1), F.greatest(F.lit(1), F.length("key") - shared + 1).cast("int"))["letter"]

    size = F.length("key")
    least = F.greatest(F.lit(1), F.ceil(size * F.lit(shortest) - F.lit(1e-9))).cast("int")
    most = F.floor(size / F.lit(shortest) + F.lit(1e-9)).cast("int")
    left = (
        ordered("s").withColumn("length", F.explode(F.sequence(least, most)))
        .select(*within, F.col("key").alias("source_key"), "length", prefix(_shared_letters(size, F.col("length"), min_ratio)).alias("source_prefix"))
        .withColumn("letter", F.explode("source_prefix"))
    )
    right = (
        ordered("c").select(*within, F.col("key").alias("candidate_key"), size.alias("length"), prefix(_shared_letters(size, least, min_ratio)).alias("candidate_prefix"))
        .withColumn("letter", F.explode("candidate_prefix"))
    )
    source, candidate = F.col("source_key"), F.col("candidate_key")
    # Two keys meet once per common letter; only the meeting on the first common one counts.
    first_common = F.get(F.array_intersect("source_prefix", "candidate_prefix"), F.lit(0))
    found = (
        # Hinted, since a key becomes a row for each letter and length: Spark expects a small part of that and would broadcast it.
        left.join(right.hint("merge"), [*within, "letter", "length"])
        .where((source != candidate) & (F.col("letter") == first_common))
        .where(edit_filter(source, candidate, min_ratio))
        .select(*within, "source_key", "candidate_key")
    )
    return found.withColumn("ratio", similarity_ratio(source, candidate)).where(F.col("ratio") >= F.lit(min_ratio))
