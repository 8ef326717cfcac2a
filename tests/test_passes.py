"""Cells stop at the first test that settles them, and label columns share one pass over the rows."""

import datetime as dt

from pyspark.sql import functions as F

from grainmill.functions.dates import parse_local_date
from grainmill.functions.numbers import MAYBE_NUMBER, parse_local_number
from grainmill.operators import cleaning, contract, harmonise

AS_OF = dt.date(2026, 1, 1)


def test_usual_cells_read_as_before(spark):
    cells = {
        "12": 12.0, "-3,5": -3.5, "+1.": 1.0, "12\n": 12.0, "12 ": 12.0, " 7 ": 7.0, "1 234,50 DH": 1234.5, "1.234,5": 1234.5, "5 %": 5.0, ",5": 0.5,
        "1e3": 1000.0, "2024-01-02": None, "10:30": None, "3/4": None, "1-2": None, "": None, "V-1": None, "- 4": -4.0, "١٢": None, None: None,
    }
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", parse_local_number(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in rows} == cells
    days = {
        "2024-03-01": "2024-03-01", "01/03/2024": "2024-03-01", "03/13/2024": "2024-03-13", "13.03.2024": "2024-03-13", "31/02/2024": None,
        "2024-13-01": None, "00/00/2024": None, "01-02/2024": "2024-02-01", "01/02/2024\n": "2024-02-01", "1/2/24": "2024-02-01", "2024/1/2": "2024-01-02",
        "2024-03-01 10:00": "2024-03-01", "abcdefghij": None, "1234567890": None, "mars 2024": "2024-03-01", None: None,
    }
    rows = spark.createDataFrame([(c,) for c in days], "c string").select("c", parse_local_date(F.col("c")).cast("date").cast("string").alias("d")).collect()
    assert {r["c"]: r["d"] for r in rows} == days


def test_dates_stop_before_number_clean_up(spark):
    stopped, read = ["2024-01-02", "02/01/2024", "10:30"], ["1 234,50 DH", "'12", "-3", "1.234,5", "12e-3"]
    cells = spark.createDataFrame([(c,) for c in stopped + read], "c string")
    assert [r["c"] for r in cells.where(~F.col("c").rlike(MAYBE_NUMBER)).collect()] == stopped


def test_label_columns_share_one_pass(spark, monkeypatch):
    rows = [("Rabat" if i % 3 else "rabat", "Web" if i % 2 else "Shop", None if i % 5 == 0 else "Livrée") for i in range(60)]
    df = spark.createDataFrame(rows, "city string, channel string, status string")
    alone = {c: {(r["cell"], r["n"]) for r in harmonise.cell_counts(df, c).collect()} for c in df.columns}
    together = harmonise.cell_counts_of(df, df.columns)
    assert {c: {(r["cell"], r["n"]) for r in counts.collect()} for c, counts in together.items()} == alone

    def refuse(*_):
        raise AssertionError("a pass of its own for one column")

    monkeypatch.setattr(harmonise, "cell_counts", refuse)
    rules = contract.infer_contract(df)
    assert sum(r.categorical for r in rules) == 2
    checks = {r["id"]: r["failing_rows"] for r in contract.run_checks(df, rules, AS_OF).collect()}
    assert checks["city.consistent"] == 20
    found = {r["id"]: r["impact"] for r in cleaning.suggest_cleaning(df).collect()}
    assert found["harmonize_values::city"] == 20
