"""Label harmonisation: one spelling per label, found on the table of distinct labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.similarity import edit_filter, similar_pairs, similarity_ratio
from grainmill.functions.text import normalize_text, text_or_null
from grainmill.operators.roles import label_role, quoted
from grainmill.plans.checkpoints import saved

# Similarity needed to merge a label, and to call it a variant.
MERGE_RATIO = 0.86
VARIANT_RATIO = 0.88

MAP_SCHEMA = "source string, target string, reason string, rows bigint"


def cell_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct cells as they are: cell, n. The only pass over the rows; saved for what follows."""
    return saved(df.groupBy(quoted(column).cast("string").alias("cell")).agg(F.count("*").alias("n")))


def cell_counts_of(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """cell_counts() of several columns from one pass over the rows."""
    if len(columns) < 2:
        return {c: cell_counts(df, c) for c in columns}
    cells = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("cell")) for c in columns])
    counts = saved(df.select(F.inline(cells)).groupBy("name", "cell").agg(F.count("*").alias("n")))
    return {c: counts.where(F.col("name") == c).select("cell", "n") for c in columns}


def label_counts(cells: DataFrame) -> DataFrame:
    """Distinct trimmed labels: value, n, key (normalised spelling)."""
    counts = cells.groupBy(text_or_null(F.col("cell")).alias("value")).agg(F.sum("n").alias("n"))
    return counts.where(F.col("value").isNotNull()).withColumn("key", normalize_text(F.col("value")))


def harmonisation_map(
    df: DataFrame, column: str, role: str | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """source, target, reason and rows for each label to rewrite.

    In order: another spelling of the same normalised label that is more frequent, the known
    label of the column's role, then the closest frequent label. A label of the known list that
    occurs in the data is preferred to any other candidate, and is never rewritten itself.
    """
    role = role or label_role(column)
    if role is None:
        return df.sparkSession.createDataFrame([], MAP_SCHEMA)
    known = V.KNOWN_LABELS[role]
    protected = sorted(set(known.values()))
    labels = label_counts(cells if cells is not None else cell_counts(df, column))
    leaders = labels.groupBy("key").agg(
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value")).alias("leader")
    )
    leaders = leaders.select("key", F.col("leader.value").alias("leader"), F.col("leader.n").alias("leader_n"))
    known_map = F.create_map(*[F.lit(x) for x in chain(*known.items())])

    open_labels = labels.where(~F.col("value").isin(protected)).join(leaders, "key")
    alias = F.try_element_at(known_map, F.col("key"))
    decided = open_labels.select(
        "key", F.col("value").alias("source"), F.col("n").alias("rows"),
        F.when(F.col("leader") != F.col("value"), F.col("leader"))
        .when(alias != F.col("value"), alias).alias("target"),
        F.when(F.col("leader") != F.col("value"), "spelling").when(alias != F.col("value"), "known").alias("reason"),
    )
    direct = decided.where(F.col("target").isNotNull()).select("source", "target", "reason", "rows")
    # An undecided label is the leader of its key, so (source, key) is one to one from here on.
    undecided = decided.where(F.col("target").isNull() & (F.length("key") >= 4)).select("source", "key", "rows")
    # The protected list has at most four values, so this brings back at most four rows.
    anchors = leaders.where(F.col("leader").isin(protected)).collect()
    if anchors:
        options = F.array(*[
            F.struct(F.lit(r["key"]).alias("key"), F.lit(r["leader"]).alias("target"), F.lit(r["leader_n"]).alias("n"))
            for r in anchors
        ])
        pairs = undecided.withColumn("option", F.explode(options)).select(
            "source", "key", "rows", F.col("option.key").alias("other"), F.col("option.target").alias("target"),
            F.col("option.n").alias("n"),
        )
        # Protected candidates outrank the others even when too far, so nothing else is tried.
        close = pairs.where(edit_filter(F.col("key"), F.col("other"), MERGE_RATIO))
        close = close.withColumn("ratio", similarity_ratio("key", "other")).where(F.col("ratio") >= MERGE_RATIO)
    else:
        frequent = leaders.where(F.col("leader_n") >= 2).where(F.length("key") >= 2)
        found = similar_pairs(undecided.select("key"), frequent.select("key"), MERGE_RATIO)
        close = (
            found.join(undecided, F.col("source_key") == F.col("key")).drop("key")
            .join(frequent, F.col("candidate_key") == F.col("key"))
            .select("source", "rows", F.col("leader").alias("target"), F.col("leader_n").alias("n"), "ratio")
        )
    best = close.groupBy("source", "rows").agg(
        F.min_by("target", F.struct(-F.col("ratio"), -F.col("n"), "target")).alias("target")
    )
    return direct.unionByName(best.select("source", "target", F.lit("similar").alias("reason"), "rows"))


def harmonise(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Rewrite the labels of one column; the mapping holds distinct labels only."""
    renamed = mapping.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    joined = df.join(renamed, quoted(column) == F.col("_source"), "left")
    fixed = F.coalesce(F.col("_target"), quoted(column))
    return joined.select(*[fixed.alias(c) if c == column else quoted(c) for c in df.columns])


def affected_rows(cells: DataFrame, mapping: DataFrame) -> int:
    """Rows whose exact cell is a label to rewrite."""
    hit = cells.join(mapping.select(F.col("source").alias("cell")), "cell", "left_semi")
    return hit.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# -- variants (a check, not a fix) -----------------------------------------------------------------


def variant_map(df: DataFrame, column: str, cells: DataFrame | None = None) -> DataFrame:
    """Labels that are a variant of a more frequent one: source, target, rows.

    Labels are visited from frequent to rare. The first of its normalised spelling becomes
    canonical unless its key is close to an earlier canonical key, in which case it is a variant
    of the earliest such one. Being canonical depends on earlier decisions, so they are taken in
    rounds: a key with no undecided earlier neighbour is settled, until none is left.
    """
    ranked = saved(label_counts(cells if cells is not None else cell_counts(df, column)))
    rank = F.struct(-F.col("n"), F.col("value"))
    heads = ranked.groupBy("key").agg(F.min(rank).alias("rank"), F.min_by("value", rank).alias("head"))
    near = similar_pairs(heads.where(F.length("key") >= 5).select("key"), heads.where(F.length("key") >= 2).select("key"), VARIANT_RATIO)
    order = heads.select("key", "rank")
    earlier = (
        near.join(order.toDF("source_key", "source_rank"), "source_key")
        .join(order.toDF("candidate_key", "candidate_rank"), "candidate_key")
        .where(F.col("candidate_rank") < F.col("source_rank"))
        .select("source_key", "candidate_key", "candidate_rank")
    )
    earlier = saved(earlier)
    followers = earlier.select(F.col("source_key").alias("key")).distinct()
    settled = heads.select("key").join(followers, "key", "left_anti").withColumn("canonical", F.lit(True))
    settled = saved(settled)
    open_keys = saved(followers)
    while not open_keys.isEmpty():
        # Known state of every earlier neighbour of an open key.
        state = earlier.join(open_keys.withColumnRenamed("key", "source_key"), "source_key", "left_semi").join(
            settled.withColumnRenamed("key", "candidate_key"), "candidate_key", "left"
        )
        # One canonical neighbour makes a key a variant; with none and none undecided it is canonical.
        verdict = state.groupBy("source_key").agg(
            F.max(F.coalesce(F.col("canonical"), F.lit(False))).alias("near_canonical"),
            F.count_if(F.col("canonical").isNull()).alias("waiting"),
        )
        done = verdict.where("near_canonical or waiting = 0").select(
            F.col("source_key").alias("key"), (~F.col("near_canonical")).alias("canonical")
        )
        settled = saved(settled.unionByName(done))
        open_keys = saved(open_keys.join(settled, "key", "left_anti"))
    chosen = (
        earlier.join(settled.where("canonical").select(F.col("key").alias("candidate_key")), "candidate_key", "left_semi")
        .groupBy("source_key").agg(F.min_by("candidate_key", "candidate_rank").alias("candidate_key"))
    )
    names = heads.select("key", "head")
    # A later spelling of a canonical key is a variant of its head; a follower key, of its leader.
    target = (
        ranked.join(chosen.withColumnRenamed("source_key", "key"), "key", "left")
        .withColumn("target_key", F.coalesce("candidate_key", "key")).drop("candidate_key")
        .join(names.toDF("target_key", "target"), "target_key")
    )
    return target.where(F.col("value") != F.col("target")).select(
        F.col("value").alias("source"), "target", F.col("n").alias("rows")
    )


def label_variants(df: DataFrame, column: str, cells: DataFrame | None = None) -> DataFrame:
    """One row: variant_rows and up to three examples, from known labels first."""
    cells = cells if cells is not None else cell_counts(df, column)
    found = saved(harmonisation_map(df, column, cells=cells).select("source", "target", "rows"))
    if found.isEmpty():
        found = saved(variant_map(df, column, cells))
    shown = found.orderBy(F.desc("rows"), "source").limit(3)
    examples = shown.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("o"), "source", "target"))),
                lambda x: F.concat(x["source"], F.lit(" → "), x["target"]),
            ), ", ",
        ).alias("examples")
    )
    total = found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("variant_rows"))
    return total.select("variant_rows", examples.scalar().alias("examples"))
