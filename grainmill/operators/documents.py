"""Documents to rows: sale lines in text, OCR boxes to reading lines, review of proposals.

A document is one row, so its lines stay in an array and are read with higher-order
functions: no shuffle, and a very long document costs no more than its own length.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.binding import bound
from grainmill.functions.dates import as_date, page_date
from grainmill.functions.numbers import parse_strict_amount, round_even
from grainmill.functions.text import strip
from grainmill.operators.counting import grouped_median
from grainmill.operators.roles import pick, quoted

# Line breaks, and the shapes of a sale line and of lines that are never a sale.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
AMOUNT_ONLY = r"^\d+(?:[,.]\d{1,2})?$"
LABELLED_AMOUNT = r"(?iU)^(.*?)(?:\s+|\s*[:=]\s*)(\d+(?:[,.]\d{1,2})?)\s*(?:MAD|DH|DHS)?$"
PURE_LABEL = r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ '-]{1,79}$"
# What ends every labelled amount: a line without it needs no search for a label.
AMOUNT_END = r"(?iU)\d\s*(?:MAD|DH|DHS)?$"
SUMMARY_START = r"(?U)^(?:sous[- ]?total|subtotal|total|tva|taxe|solde|balance|net[ -]?[aà]?[ -]?payer)\b"
HEADER_START = r"(?U)^(?:ventes?|date|journ[ée]e|recettes?|carnet|caisse|sales|page)\b"
HEADER_END = r"(?U)\b(?:du|le|au|of|on)$"
NOT_A_SALE = "|".join([SUMMARY_START, HEADER_START, HEADER_END])

SALE_FIELDS = ["line_no", "date", "product", "quantity", "amount", "confidence"]


def text_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def is_summary(name: Column) -> Column:
    """Totals, taxes and page headers."""
    return strip(F.lower(name)).rlike(NOT_A_SALE)


def _amount_text(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def sale_line_array(lines: Column, scores: Column | None = None) -> Column:
    """Array of proposed sales: line_no, product, amount, confidence.

    A sale is a label and an amount on one line, or a label line directly followed by an amount
    line. The label waiting for an amount is always the previous kept line, so no state is
    carried along the document.
    """
    kept = F.filter(
        F.transform(lines, lambda raw, i: F.struct(strip(raw).alias("text"), i.alias("i"))),
        lambda x: F.length(x["text"]) >= 3,
    )

    def score(i: Column) -> Column:
        return F.get(scores, i) if scores is not None else F.lit(None).cast("double")

    def propose(x: Column, before: Column) -> Column:
        line, label = x["text"], before["text"]
        two_lines = F.coalesce(line.rlike(AMOUNT_ONLY) & label.rlike(PURE_LABEL) & ~is_summary(label), F.lit(False))
        ends, part = line.rlike(AMOUNT_END), lambda group: F.regexp_extract(line, LABELLED_AMOUNT, group)
        name = F.when(ends, F.btrim(part(1), F.lit(" -:;.")))
        read = F.struct(two_lines.alias("two_lines"), F.when(two_lines, label).otherwise(name).alias("product"), F.when(two_lines, line).when(ends, part(2)).alias("amount"))
        return bound(read, lambda r: F.when(r["two_lines"] | named(r["product"], r["amount"]), sale(x, before, r)))

    def named(name: Column, amount: Column) -> Column:
        return (amount != "") & name.rlike(r"[A-Za-zÀ-ÿ]") & (F.length(name) <= 80) & ~is_summary(name)

    def sale(x: Column, before: Column, r: Column) -> Column:
        lowest = F.when(r["two_lines"], F.least(score(before["i"]), score(x["i"]))).otherwise(score(x["i"]))
        return bound(parse_strict_amount(r["amount"]), lambda amount: F.when(amount.isNotNull(), F.struct(
            (x["i"] + 1).alias("line_no"), r["product"].alias("product"), _amount_text(amount).alias("amount"), round_even(lowest, 3).alias("confidence"),
        )))

    # The kept lines are named, or each line would find all of them anew to look at the one before it.
    return bound(kept, lambda k: F.filter(F.transform(k, lambda x, i: propose(x, F.get(k, i - 1))), lambda s: s.isNotNull()))


def sale_lines(
    df: DataFrame, doc: str, text: str, current_year: int | None = None, scores: str | None = None, dated: bool = False
) -> DataFrame:
    """Proposed sales of each document; with `dated`, lines take the date at the top of the page."""
    lines = text_lines(quoted(text))
    source = df.select(quoted(doc).alias(doc), lines.alias("lines"), *([quoted(scores).alias("scores")] if scores else []))
    found = sale_line_array(F.col("lines"), F.col("scores") if scores else None)
    date = page_date(F.col("lines"), current_year or dt.date.today().year) if dated else F.lit("")
    rows = source.select(doc, date.alias("date"), F.inline(found))
    return rows.select(doc, "line_no", "date", "product", F.lit("1").alias("quantity"), "amount", "confidence")


def canonical_sales(df: DataFrame, source: str) -> DataFrame:
    """Any sales-like table as proposed sales; empty when no amount column is recognised."""
    amount = pick(df.columns, V.CAPTURE_AMOUNT_PRIORITY)
    if amount is None:
        return df.sparkSession.createDataFrame([], "date string, product string, quantity string, amount string, source string")
    product = pick(df.columns, V.CAPTURE_PRODUCT_PRIORITY)
    quantity = pick(df.columns, V.CAPTURE_QUANTITY_PRIORITY)
    date = pick(df.columns, V.CAPTURE_DATE_PRIORITY)

    def shown(name: str | None, default: str) -> Column:
        if name is None:
            return F.lit(default)
        return F.coalesce(strip(quoted(name).cast("string")), F.lit(default))

    def whole(name: str | None) -> Column:
        if name is None or df.schema[name].dataType.typeName() not in ("double", "float", "decimal"):
            return shown(name, "1")
        number = quoted(name).cast("double")
        text = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
        return F.coalesce(text, F.lit("1"))

    when = F.date_format(as_date(quoted(date), df.schema[date].dataType), "yyyy-MM-dd") if date else F.lit("")
    return df.where(quoted(amount).isNotNull()).select(
        F.coalesce(when, F.lit("")).alias("date"), shown(product, "").alias("product"), whole(quantity).alias("quantity"),
        strip(quoted(amount).cast("string")).alias("amount"), F.lit(source).alias("source"),
    )


def document_batch(parts: list[DataFrame]) -> DataFrame:
    """One proposal table from several kinds of documents: source, date, product, quantity, amount."""
    fields = ["source", "date", "product", "quantity", "amount"]
    return reduce(DataFrame.unionByName, [p.select(*fields) for p in parts])


def review_counts(batch: DataFrame) -> DataFrame:
    return batch.groupBy("source").agg(F.count("*").alias("suggested_rows"))


# -- review -------------------------------------------------------------------------------------------


def validate_sales(df: DataFrame, date: str, product: str, quantity: str, amount: str) -> DataFrame:
    """Add reject_reason (NULL when accepted) and the typed values of accepted rows."""
    name, count, day = strip(quoted(product)), strip(quoted(quantity)), F.coalesce(quoted(date), F.lit(""))
    pieces = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    number = F.when(count.rlike(r"^\d{1,4}$"), count.try_cast("int"))
    price = parse_strict_amount(quoted(amount))
    reason = (
        F.when(F.coalesce(name, F.lit("")) == "", "product").when(F.length(name) > 80, "product")
        .when((day != "") & (~day.rlike(pieces) | day.try_cast("date").isNull()), "date")
        .when(number.isNull() | (number < 1), "quantity")
        .when(price.isNull(), "amount")
    )
    ok = reason.isNull()
    return df.withColumns({
        "reject_reason": reason,
        "sale_date": F.when(ok, F.nullif(day, F.lit(""))),
        "sale_product": F.when(ok, name),
        "sale_quantity": F.when(ok, number),
        "sale_amount": F.when(ok, price),
    })


def review_overlay(posted: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop posted rows without product and amount; an unknown source becomes a manual entry."""
    kept = posted.where((strip(F.coalesce("product", F.lit(""))) != "") | (strip(F.coalesce("amount", F.lit(""))) != ""))
    known = documents.select(F.col("source").alias("_known")).distinct()
    joined = kept.join(known, F.col("source") == F.col("_known"), "left")
    return joined.withColumn("source", F.coalesce("_known", F.lit(V.MANUAL_SOURCE_LABEL))).drop("_known")


# -- OCR boxes -------------------------------------------------------------------------------------------

BOX_COLUMNS = ["page_id", "box_id", *[f"{axis}{i}" for i in range(4) for axis in "xy"], "text", "score"]

# Fixed value: distance to a line, in typical box heights, within which a box joins it.
LINE_REACH = 0.55
BUCKET_LINES = 64


def reading_lines(boxes: DataFrame) -> DataFrame:
    """Rebuild the lines of a scanned page: page_id, line_no, text, score.

    The page is straightened by the median angle of its wide boxes. Boxes are then visited from top
    to bottom; one joins the current line when close to the mean height of its boxes. That mean never
    exceeds the last box visited, so a gap wider than the reach always starts a new line: pages are cut
    at such gaps first, and only the boxes between two gaps are folded in order. Gaps are found in
    slices of a page, so that one huge page does not become one task.
    """
    hypot = lambda ax, ay, bx, by: F.hypot(F.col(bx) - F.col(ax), F.col(by) - F.col(ay))
    items = boxes.where(strip(F.col("text")) != "").select(
        "page_id", "box_id", strip(F.col("text")).alias("text"), F.col("score").cast("double").alias("score"),
        (sum((F.col(f"x{i}") for i in range(1, 4)), F.col("x0")) / 4).alias("cx"),
        (sum((F.col(f"y{i}") for i in range(1, 4)), F.col("y0")) / 4).alias("cy"),
        hypot("x0", "y0", "x1", "y1").alias("w"),
        F.greatest(hypot("x0", "y0", "x3", "y3"), F.lit(1.0)).alias("h"),
        F.when(hypot("x0", "y0", "x1", "y1") > 1, F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
        .otherwise(0.0).alias("angle"),
    )
    angle = grouped_median(items.where(F.col("w") >= 2 * F.col("h")), [F.col("page_id")], F.col("angle"), ["page_id"])
    height = grouped_median(items, [F.col("page_id")], F.col("h"), ["page_id"])
    pages = height.withColumnRenamed("median", "height").join(angle.withColumnRenamed("median", "theta"), "page_id", "left")
    theta = F.coalesce(F.col("theta"), F.lit(0.0))
    placed = items.join(pages, "page_id").select(
        "page_id", "box_id", "text", "score", (F.col("height") * LINE_REACH).alias("reach"),
        (F.col("cx") * F.cos(-theta) - F.col("cy") * F.sin(-theta)).alias("x"),
        (F.col("cx") * F.sin(-theta) + F.col("cy") * F.cos(-theta)).alias("y"),
    )
    placed = placed.withColumn("slice", F.floor(F.col("y") / (F.col("reach") * BUCKET_LINES)))
    # First box of a slice: compare with the lowest box of the slice before it.
    slices = placed.groupBy("page_id", "slice").agg(F.max("y").alias("bottom"))
    by_page = Window.partitionBy("page_id").orderBy("slice")
    slices = slices.select("page_id", "slice", F.lag("bottom").over(by_page).alias("above"))
    in_slice = Window.partitionBy("page_id", "slice").orderBy("y", "x", "box_id")
    stepped = placed.join(slices, ["page_id", "slice"]).withColumn("before", F.coalesce(F.lag("y").over(in_slice), F.col("above")))
    starts = F.coalesce((F.col("y") - F.col("before") > F.col("reach")).cast("int"), F.lit(1))
    stepped = stepped.withColumn("start", starts)
    numbered = stepped.withColumn("islands", F.sum("start").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = stepped.groupBy("page_id", "slice").agg(F.sum("start").alias("starts"))
    upto = by_page.rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("page_id", "slice", F.coalesce(F.sum("starts").over(upto), F.lit(0)).alias("offset"))
    islands = numbered.join(offsets, ["page_id", "slice"]).withColumn("island", F.col("offset") + F.col("islands"))
    box = F.struct("y", "x", "box_id", "text", "score")
    grouped = islands.groupBy("page_id", "island", "reach").agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def step(state: Column, b: Column) -> Column:
        joins = F.coalesce(F.abs(b["y"] - F.try_divide(state["total"], state["n"])) <= F.col("reach"), F.lit(False))
        line = F.when(joins, state["line"]).otherwise(state["line"] + 1)
        return F.struct(
            line.alias("line"),
            (F.when(joins, state["total"]).otherwise(0.0) + b["y"]).alias("total"),
            (F.when(joins, state["n"]).otherwise(F.lit(0)) + 1).alias("n"),
            F.array_append(state["lines"], line).alias("lines"),
        )

    empty = F.struct(
        F.lit(0).alias("line"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("lines")
    )
    folded = grouped.withColumn("lines", F.aggregate("boxes", empty, step, lambda s: s["lines"]))
    placed_boxes = folded.select("page_id", "island", F.inline(F.arrays_zip("boxes", "lines")))
    lines = placed_boxes.groupBy("page_id", "island", F.col("lines").alias("line")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("boxes.x"), F.col("boxes.box_id"), F.col("boxes.text")))).alias("words"),
        F.min("boxes.score").alias("score"),
    )
    # The island number follows the page from top to bottom, the line number an island.
    return lines.select("page_id", "island", "line", F.array_join(F.col("words.text"), " ").alias("text"), "score")
