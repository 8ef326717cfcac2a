import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from grainmill.functions import dates, numbers, similarity, text


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_normalize_text_folds_accents_forms_and_marks(spark):
    got = apply(spark, [" Été ﬁn ½ ", "مُحَمَّد", "straße", "ＡＢ１", None], text.normalize_text)
    assert got == ["ete fin 1 2", "محمد", "straße", "ab1", None]
    assert text.normalize_name(" Été ﬁn ½ ") == got[0]


def test_local_numbers(spark):
    cells = ["1.234,50", "1,234.50", "1 234,50 DH", "'12", "5%", "5 % DH", "N/A", "12,5e3", "3 unités", "58 MAD", "1,234,567", " ", None, "-114.0"]
    assert apply(spark, cells, numbers.parse_local_number) == [
        1234.5, 1234.5, 1234.5, 12.0, 5.0, 5.0, None, 12500.0, None, 58.0, None, None, None, -114.0,
    ]
    assert apply(spark, ["Gratuit", "offert", "10"], lambda c: numbers.parse_local_number(c, True)) == [0.0, 0.0, 10.0]


def test_invoice_amounts(spark):
    cells = ["1 000,00", "1.000", "1,000,000.50", "12,5", "12,555", "-7.25"]
    assert apply(spark, cells, numbers.parse_invoice_amount) == [1000.0, 1000.0, 1000000.5, 12.5, 12555.0, -7.25]


def test_strict_amounts(spark):
    assert apply(spark, ["25,50", "0", "100000000", "100000001", "1,234", "a"], numbers.parse_strict_amount) == [25.5, None, 1e8, None, None, None]


def test_dates(spark):
    cells = ["2026-07-05", "05/07/2026", "30-06-26", "03/14/2026", "31/02/2026", "mars 2026", "2026/03/14", "5.7.2026", "2026-07-05T10:30:00", "17 July 2026", "2026", "x"]
    d = dt.datetime
    assert apply(spark, cells, dates.parse_local_date) == [
        d(2026, 7, 5), d(2026, 7, 5), d(2026, 6, 30), d(2026, 3, 14), None, d(2026, 3, 1), d(2026, 3, 14), d(2026, 7, 5), d(2026, 7, 5, 10, 30), d(2026, 7, 17), None, None,
    ]


def test_spreadsheet_text(spark):
    cells = ["=CMD()", "  @SUM(A1:A2)", "-114.0", "+12,50", "normal"]
    assert apply(spark, cells, text.safe_spreadsheet_text) == ["'=CMD()", "'  @SUM(A1:A2)", "-114.0", "+12,50", "normal"]
    assert text.safe_spreadsheet_name("=texte") == "'=texte"


def test_transliteration(spark):
    assert apply(spark, ["رمز", "خاص"], text.arabic_to_latin) == ["rmz", "khas"]
    assert apply(spark, ["warehouse", "bin"], text.latin_to_arabic) == ["واريهوس", "بين"]


@pytest.mark.parametrize("ratio", [0.6, 0.7, 0.86, 0.88])
def test_similar_pairs_finds_exactly_the_pairs_of_brute_force(spark, ratio):
    base = ["casablanca", "marrakech", "essaouira", "tanger ville", "rabat"]
    keys = sorted({b[:i] + x + b[i + j:] for b in base for i in range(0, len(b), 2) for j in (0, 1) for x in ("", "e", "zz")})
    keys = [k for k in keys if len(k) >= 4] + ["abc", "axbxc", "ab", "aab"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r[0], r[1]) for r in similarity.similar_pairs(df, df, ratio).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and SequenceMatcher(None, a, b).ratio() >= ratio}
