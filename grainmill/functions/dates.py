"""Date expressions: day-first parsing, invoice dates, page dates and time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import vocabulary as V
from grainmill.functions.binding import bound
from grainmill.functions.text import plain, strip

# What a date looks like in a cell.
CLEANING_DATE_SHAPE = r"^(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[A-Za-zÀ-ÿ]+\s+\d{4})(?:[ T].*)?$"
TYPING_DATE_SHAPE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T].*)?$"

# Rewrites that bring a numeric date to year-month-day, applied in order: two-digit years, month
# first when day first is impossible, day first, and any separator in a year-first date.
REST = r"(?=$|[ T])"
NUMERIC_REWRITES = [
    (r"^(?<dm>\d{1,2}[-/.]\d{1,2}[-/.])(?<y>[0-6]\d)" + REST, "${dm}20${y}"),
    (r"^(?<dm>\d{1,2}[-/.]\d{1,2}[-/.])(?<y>[7-9]\d)" + REST, "${dm}19${y}"),
    (r"^(0?[1-9]|1[0-2])[-/.](1[3-9]|2\d|3[01])[-/.](\d{4})" + REST, "$3-$1-$2"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + REST, "$3-$2-$1"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + REST, "$1-$2-$3"),
]
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
# The two shapes most dates have; they need no rewriting.
ISO_DAY = r"^\d{4}-\d\d-\d\d\z"
SLASHED_DAY = r"^\d\d[-/.]\d\d[-/.]\d{4}\z"
NUMERIC_SHAPE = r"(?U)^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
NAMED_SHAPE = r"(?U)^\s*(?:\d{1,2}\s+)?\p{L}{3,}\.?\s.*\d{4}\s*$"
MONTH_WORD = r"^(?:(\d{1,2})\s+)?([\p{L}]+)\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})$"


def _month_table(*tables: dict[str, int]) -> Column:
    merged = {name: number for table in tables for name, number in table.items()}
    return F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day)


def parse_local_date(c: Column, stripped: Column | None = None) -> Column:
    """Day-first date or date-time from text; unreadable text gives NULL.

    Accepted: year first, day first with / - or . (month first only when day first is
    impossible), two-digit years (70 and above are 19xx), "month year" in French and "day month
    year", "month day, year" or "month year" in English. Each is rewritten to ISO and cast with
    try_cast, which rejects impossible days without raising. `stripped` is the stripped text, where there is one.
    """
    stripped = strip(c) if stripped is None else stripped

    def numeric(text: Column) -> Column:
        for pattern, rewritten in NUMERIC_REWRITES:
            text = F.regexp_replace(text, pattern, rewritten)
        return F.regexp_extract(text, ISO_DATE, 0).try_cast("timestamp_ntz")

    # Ten characters and a digit first, which costs little, spare the other cells the tests of the two usual shapes.
    usual_cell = (F.length(c) == 10) & (c >= "0") & (c < ":")
    usual = F.when(usual_cell & c.rlike(ISO_DAY), c.try_cast("timestamp_ntz")).when(usual_cell & c.rlike(SLASHED_DAY), _slashed_day(c))
    # Cells of neither shape, the common case in a text column, stop at these two tests. What follows stands in lambdas: compiled
    # in line, dozens of parsed columns make one method too long for the JVM to compile.
    return usual.when(c.rlike(NUMERIC_SHAPE), bound(stripped, numeric)).when(c.rlike(NAMED_SHAPE), bound(stripped, _named_date))


def _slashed_day(text: Column) -> Column:
    """Day first, or month first when day first is impossible."""
    first, second, year = text.substr(1, 2), text.substr(4, 2), text.substr(7, 4)
    month_first = second.between("13", "31") & first.between("01", "12")
    return F.when(month_first, _iso(year, first, second)).otherwise(_iso(year, second, first)).try_cast("timestamp_ntz")


def _named_date(text: Column) -> Column:
    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(text, MONTH_WORD, group), F.lit(""))

    word = F.translate(F.lower(part(2)), "éèêûùüôâà", "eeeuuuoaa")
    day = F.coalesce(part(1), part(3))
    english = F.try_element_at(_month_table(V.ENGLISH_MONTHS, _english_short_months()), word)
    french = F.try_element_at(_month_table(V.FRENCH_MONTHS), word)
    month = F.coalesce(english, F.when(day.isNull(), french)).cast("string")
    return _iso(part(4), month, F.coalesce(day, F.lit("1"))).try_cast("timestamp_ntz")


def _english_short_months() -> dict[str, int]:
    return {name[:3]: number for name, number in V.ENGLISH_MONTHS.items()}


def is_date_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_date(c: Column, data_type: T.DataType) -> Column:
    return c.cast("timestamp_ntz") if is_date_type(data_type) else parse_local_date(c.cast("string"))


# -- invoices and notes -----------------------------------------------------------------------

NUMERIC_DATE = r"\b(\d{1,4})[./\-](\d{1,2})[./\-](\d{1,4})\b"
WORD_DATE = r"\b(\d{1,2})\s+([a-z]+)\s+(\d{4})\b"
PAGE_DATE = r"\b(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?\b"


def _padded_year(year: Column) -> Column:
    return F.lpad(year.cast("string"), 4, "0")


def parse_invoice_date(c: Column, folded: bool = False) -> Column:
    """struct(value, confidence): year first 0.98, day first 0.90, month in words 0.95."""
    def read(pattern: str, text: Column) -> Column:
        return F.struct(*[F.regexp_extract(text, pattern, i).alias(name) for i, name in enumerate(("first", "second", "third"), 1)])

    def numeric(p: Column) -> Column:
        year_first = F.length(p["first"]) == 4
        day_first = bound(p["third"].try_cast("int"), lambda y: _iso(
            _padded_year(y + F.when(y < 70, 2000).when(y < 100, 1900).otherwise(0)), p["second"], p["first"]))
        written = F.when(year_first, _iso(p["first"], p["second"], F.nullif(p["third"], F.lit("")))).otherwise(day_first)
        fits = F.when(year_first, F.length(p["third"]) <= 2).otherwise(F.length(p["first"]) <= 2)
        return F.struct(
            F.when(fits, written.try_cast("date")).cast("string").alias("value"), F.when(year_first, 0.98).otherwise(0.90).alias("confidence"))

    def words(p: Column) -> Column:
        month = F.try_element_at(_month_table(V.FRENCH_MONTHS, V.ENGLISH_MONTHS), p["second"]).cast("string")
        return F.struct(_iso(p["third"], month, p["first"]).try_cast("date").cast("string").alias("value"), F.lit(0.95).alias("confidence"))

    return F.when(c.rlike(NUMERIC_DATE), bound(read(NUMERIC_DATE, c), numeric)).otherwise(bound(read(WORD_DATE, c if folded else plain(c)), words))


def page_date(lines: Column, current_year: int) -> Column:
    """First readable day/month[/year] in the first three lines, as ISO text, '' when none."""

    def read(line: Column) -> Column:
        parts = F.struct(*[F.regexp_extract(line, PAGE_DATE, i).alias(name) for i, name in enumerate(("day", "month", "year"), 1)])
        return F.when(line.rlike(PAGE_DATE), bound(parts, lambda p: dated(p, F.when(p["year"] == "", current_year).otherwise(p["year"].try_cast("int")))))

    def dated(p: Column, number: Column) -> Column:
        full = F.when(number < 100, number + 2000).otherwise(number)
        return _iso(_padded_year(full), p["month"], p["day"]).try_cast("date").cast("string")

    found = F.filter(F.transform(F.slice(lines, 1, 3), read), lambda d: d.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


# -- time buckets ---------------------------------------------------------------------------------


def time_unit(df: DataFrame, date: Column) -> Column:
    """'day', 'week' or 'month' by the span of the whole column, as a scalar subquery."""
    span = F.timestamp_diff("DAY", F.min(date), F.max(date))
    unit = F.when(span <= 62, "day").when(span <= 730, "week").otherwise("month")
    return df.agg(F.coalesce(unit, F.lit("day")).alias("unit")).scalar()


def time_bucket(date: Column, unit: Column) -> Column:
    """Start of the bucket; weeks start on Monday."""
    return (
        F.when(unit == "day", F.date_trunc("day", date))
        .when(unit == "week", F.date_trunc("week", date))
        .otherwise(F.date_trunc("month", date))
        .cast("date")
    )


def bucket_label(bucket: Column, unit: Column, week_range: bool = False) -> Column:
    """ISO day or month; a week shows its first day, or both ends when week_range is set."""
    day = F.date_format(bucket, "yyyy-MM-dd")
    week = F.concat(day, F.lit("/"), F.date_format(F.date_add(bucket, 6), "yyyy-MM-dd")) if week_range else day
    return F.when(unit == "day", day).when(unit == "week", week).otherwise(F.date_format(bucket, "yyyy-MM"))
