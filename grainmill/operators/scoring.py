"""Scores of proposed document lines against the lines that were expected.

Expected lines are served in their order: each takes the proposal whose name is nearest among those not yet taken. No loop
visits them here. Every line first claims its best proposal as if it were alone, then counts how many earlier lines of its
document claim the same name, and claims anew; a line is settled once all before it are, and rounds end when no claim
changes. Proposals of one name in one document are a class with a capacity, so a name repeated n times takes two rounds, not n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.numbers import round_even
from grainmill.functions.similarity import similar_pairs
from grainmill.functions.text import plain, strip
from grainmill.operators.roles import quoted
from grainmill.plans.checkpoints import saved

# Least name ratio of a match, and how far an exact amount may be off.
MATCH_RATIO = 0.6
AMOUNT_ERROR = 0.005

#: Lines of a running count that share a window; longer groups are counted in parts.
PART_LINES = 10_000


def shuffled(df: DataFrame) -> DataFrame:
    """The frame as one side of a join that deals out both. Lines are read from texts that may be stored in a small part of their
    size, by which Spark would take them for small and broadcast every line through the driver."""
    return df.hint("merge")


def line_name(c: Column) -> Column:
    """The name as compared: no accents, no other characters beyond ASCII, lower case, single blanks."""
    ascii_only = F.regexp_replace(plain(F.coalesce(c.cast("string"), F.lit(""))), r"[^\x00-\x7f]", "")
    return strip(F.regexp_replace(ascii_only, r"[\s\x1c-\x1f]+", " "))


def amount_of(c: Column) -> Column:
    """The amount as a number, a comma read as the decimal mark; NULL when it is none."""
    return F.regexp_replace(F.btrim(c.cast("string")), ",", ".").try_cast("double")


def earlier(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The sum of `value` over the rows of a group before this one, by windows of a bounded number of whole-number places."""
    part = F.floor(F.col(order) / PART_LINES)
    marked = df.withColumn("_part", part).withColumn("_value", value.cast("bigint"))
    sums = marked.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return marked.join(shuffled(starts), [*group, "_part"]).withColumn(name, total).drop("_part", "_value", "_start")


def matched_lines(expected: DataFrame, found: DataFrame, doc: str = "doc_id", line: str = "line_no", product: str = "product") -> DataFrame:
    """doc, expected_line, found_line, ratio of the expected lines that got a proposal.

    Both tables have one row per line, `line` being distinct whole numbers inside a document. Lines are served by `line`;
    equal ratios go to the smaller found line. A line without a document, or without a number, takes no part.
    """
    def named(df: DataFrame) -> DataFrame:
        return df.select(quoted(doc).alias("doc"), quoted(line).cast("bigint").alias("line"), line_name(quoted(product)).alias("name")).dropna(subset=["doc", "line"])

    wanted, offered = saved(named(expected)), named(found)
    places = saved(earlier(offered, ["doc", "name"], "line", F.lit(1), "place").withColumnRenamed("line", "found_line"))
    names = [df.select("doc", F.col("name").alias("key")).distinct() for df in (wanted, places)]
    # The expected name is the second one of the ratio, as the ratio is not symmetric.
    near = similar_pairs(names[1].where("key <> ''"), names[0].where("key <> ''"), MATCH_RATIO, within=["doc"])
    near = near.select("doc", F.col("candidate_key").alias("wanted"), F.col("source_key").alias("name"), "ratio")
    same = names[0].join(shuffled(names[1]), ["doc", "key"]).select("doc", F.col("key").alias("wanted"), F.col("key").alias("name"), F.lit(1.0).alias("ratio"))
    pairs = wanted.withColumnRenamed("name", "wanted").join(shuffled(near.unionByName(same)), ["doc", "wanted"]).select("doc", "line", "name", "ratio")
    claims = saved(pairs.withColumn("claimed", F.lit(False)))
    taken = ["doc", "name", "place"]
    while True:
        counted = earlier(claims, ["doc", "name"], "line", F.col("claimed"), "place").join(shuffled(places.select(*taken, "found_line")), taken, "left")
        rank = F.struct(F.col("ratio"), -F.col("found_line"))
        best = counted.where("found_line is not null").groupBy("doc", "line").agg(F.max_by(F.struct("name", "found_line"), rank).alias("best"))
        new = counted.drop("place", "found_line").join(shuffled(best), ["doc", "line"], "left").select(
            "doc", "line", "name", "ratio", F.col("claimed").alias("before"), F.coalesce(F.col("best.name") == F.col("name"), F.lit(False)).alias("claimed"), F.col("best.found_line").alias("found_line"))
        new = saved(new)
        if new.where("before <> claimed").isEmpty():
            return new.where("claimed").select(F.col("doc").alias(doc), F.col("line").alias("expected_line"), "found_line", "ratio")
        claims = new.drop("before", "found_line")


def accuracy(expected: DataFrame, found: DataFrame, doc: str = "doc_id", line: str = "line_no", product: str = "product", amount: str = "amount") -> DataFrame:
    """One row per document: expected_rows, proposed_rows, rows_found, recall_pct, exact_amounts, amount_accuracy_pct, extra_rows,
    expected_total, proposed_total. Shares of a document that expects nothing are NULL; unreadable amounts add nothing."""
    # Lines may come from texts that are costly to read: saved, since the matching, the comparison and the totals each read them.
    needed = [quoted(c) for c in dict.fromkeys([doc, line, product, amount])]
    expected, found = saved(expected.select(*needed)), saved(found.select(*needed))
    matches = matched_lines(expected, found, doc, line, product)
    own = [quoted(doc).alias("doc"), quoted(line).cast("bigint").alias("line"), amount_of(quoted(amount)).alias("amount")]
    wanted, offered = expected.select(*own), found.select(*own)
    exact = F.abs(F.col("f.amount") - F.col("e.amount")) < AMOUNT_ERROR
    compared = (
        matches.withColumnRenamed(doc, "doc").alias("m").join(shuffled(wanted.alias("e")), (F.col("m.doc") == F.col("e.doc")) & (F.col("expected_line") == F.col("e.line")))
        .join(shuffled(offered.alias("f")), (F.col("m.doc") == F.col("f.doc")) & (F.col("found_line") == F.col("f.line")))
    )
    scores = compared.groupBy(F.col("m.doc").alias("doc")).agg(F.count("*").alias("rows_found"), F.count_if(exact).alias("exact_amounts"))

    def totals(df: DataFrame, rows: str, total: str) -> DataFrame:
        return df.groupBy("doc").agg(F.count("*").alias(rows), F.sum("amount").alias(total))

    both = totals(wanted, "expected_rows", "expected_total").join(shuffled(totals(offered, "proposed_rows", "proposed_total")), "doc", "full")
    both = both.join(shuffled(scores), "doc", "left")
    both = both.fillna(0, ["expected_rows", "proposed_rows", "rows_found", "exact_amounts", "expected_total", "proposed_total"])

    def share(part: str) -> Column:
        return round_even(F.when(F.col("expected_rows") > 0, F.col(part) / F.col("expected_rows") * 100), 1)

    return both.select(
        F.col("doc").alias(doc), "expected_rows", "proposed_rows", "rows_found", share("rows_found").alias("recall_pct"), "exact_amounts",
        share("exact_amounts").alias("amount_accuracy_pct"), (F.col("proposed_rows") - F.col("rows_found")).alias("extra_rows"),
        round_even(F.col("expected_total"), 2).alias("expected_total"), round_even(F.col("proposed_total"), 2).alias("proposed_total"),
    )
