"""Usual cells skip the long way through the parsers and give the same values."""

from pyspark.sql import functions as F

from grainmill.functions.numbers import parse_local_number
from grainmill.functions.text import WHITESPACE, strip, strip_cell
from grainmill.operators import cleaning


def test_priced_numbers_and_words(spark):
    cells = {
        "12,50 DH": 12.5, "12.50dhs": 12.5, "7 MAD": 7.0, "-3€": -3.0, "5. $": 5.0, "5 Dirhams": 5.0, "5  DH": 5.0, "DH 5": 5.0, "mad5": 5.0, "€ 5": 5.0,
        "1,5,2 DH": None, "5 DHX": None, "Rabat 5": None, "dix": None, "Marrakech": None, "D": None, "DH": None, "5 DH\n": 5.0, "V-1": None, "zéro": None, None: None,
    }
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", parse_local_number(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in rows} == cells


def test_cells_are_stripped_alike(spark):
    texts = ["", "a", "ab", " ", "é", " é", "~", "!", "\x7f", "a\x7f", None, "a b", "a\n"]
    texts += [t for w in WHITESPACE for t in (w, w + "a", "a" + w, w + "é" + w, "a" + w + "b")]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select(strip(F.col("c")).alias("a"), strip_cell(F.col("c")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_a_stripped_cell_is_made_once_for_the_suggestions(spark):
    df = spark.createDataFrame([(" a ", "1,5 DH"), ("", "2"), ("b", "x")], "city string, note string")
    stripped, aggregates, _ = cleaning._measured(df)
    assert len(stripped) == 2 and not any("trim" in str(a) for a in aggregates)
    found = {r["id"]: r["impact"] for r in cleaning.suggest_cleaning(df, harmonised=False).collect()}
    assert (found["normalize_blanks"], found["strip_text"]) == (1, 1)
