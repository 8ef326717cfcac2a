import re

from pyspark.sql import functions as F

from grainmill.functions.binding import bound
from grainmill.functions.text import fold_lines, plain
from grainmill.operators import documents, invoices


def _count(frame, what):
    """How often an expression stands in the optimized plan."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(what, plan))


def test_kept_lines_are_found_once(spark):
    df = spark.createDataFrame([(1, "Pain 2,50\nHuile\n12\nTotal 14")], "d int, t string")
    got = documents.sale_lines(df, "d", "t")
    assert [(r.line_no, r["product"], r.amount) for r in got.orderBy("line_no").collect()] == [(1, "Pain", "2.50")]
    # The filter that keeps lines of three characters stood in the plan for each use of the line before.
    assert _count(got, r">= 3\)") == 1


def test_two_line_sales_over_dropped_lines(spark):
    text = "Ventes du 03/02/2025\nHuile\n\n 125 \nLait : 10.00 DH\nCafe noir\n7\n150,50\nTotal 300\nRiz basmati\n200"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string")
    got = documents.sale_lines(df, "d", "t", current_year=2026, dated=True).orderBy("d", "line_no").collect()
    assert [(r.d, r.line_no, r.date, r["product"], r.amount) for r in got] == [
        (1, 4, "2025-02-03", "Huile", "125.00"), (1, 5, "2025-02-03", "Lait", "10.00"), (1, 8, "2025-02-03", "Cafe noir", "150.50"), (1, 11, "2025-02-03", "Riz basmati", "200.00")]


def test_bound_computes_once(spark):
    doubled = bound(F.upper("t"), lambda u: F.concat(u, u, u))
    df = spark.createDataFrame([("a",)], "t string").select(doubled.alias("v"))
    assert df.first().v == "AAA" and _count(spark.createDataFrame([("a",)], "t string").repartition(1).select(doubled.alias("v")), r"upper\(") == 1


def test_lines_folded_together(spark):
    rows = [["Facture N° É", "Σας ΟΔΟΣ", "½ ﬁn €"], ["A", "b"], [], None, ["ligne ΟΔΟΣ", "́", "é😀"]]
    df = spark.createDataFrame([(r,) for r in rows], "l array<string>").repartition(1)
    for r in df.select(fold_lines(F.col("l")).alias("a"), F.transform("l", plain).alias("b")).collect():
        assert r.a == r.b


def test_invoice_lines_are_read_once(spark):
    text = "Atlas Négoce SARL\nInvoice No: F-77/2\nDate d'échéance : 01/03/2025\nInvoice date: 2025-02-01\nSubtotal excluding tax 1.000,50 EUR\nVAT 20 % : 200,10 EUR\nAmount due 1.200,60 EUR"
    df = spark.createDataFrame([(1, text), (2, None), (3, " | \n"), (4, "Réf: 12-A\nDate : 5 février 2024\nTotal TTC 12 345,00 DH")], "d int, t string")
    got = {r.d: r for r in invoices.invoice_finds(df, "d", "t").collect()}
    value = lambda d: [got[d][f].value if got[d][f] else None for f in invoices.FIELDS]
    assert value(1) == ["Atlas Négoce SARL", "F-77/2", "2025-02-01", 1000.5, 1200.6, 200.1, 20.0, "EUR"]
    assert value(4) == [None, "12-A", "2024-02-05", None, 12345.0, None, None, "MAD"]
    assert value(2) == value(3) == [None] * 8
    assert _count(invoices.invoice_finds(df, "d", "t"), re.escape("facture|invoice|r[ée]f")) == 1
