"""Number expressions: locale-aware parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import vocabulary as V
from grainmill.functions.binding import bound
from grainmill.functions.text import PLAIN_NUMBER, SPACES, strip

WIDE_SPACES = " \u00a0"

# Currency words and signs dropped from a typed number, and the number that must remain.
CURRENCY = r"mad|dhs?|dirhams?|[€$]"
DOTTED_NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"

# Text escape, currency, separators of thousands, and a percent sign that ends the number.
NUMBER_NOISE = rf"(?i)^'|{CURRENCY}|[ \u00a0\u202f]|%(?=(?:[ \u00a0\u202f]|{CURRENCY})*$)"

# A number as most are typed, which needs no clean-up.
TYPED_NUMBER = r"^[+-]?\d+(?:[.,]\d*)?\z"

# What may stand before the first digits; words and codes stop here without further work, and so do dates and times, whose
# marks no number has behind a digit.
MAYBE_NUMBER = rf"(?iU)^(?:[\s'+\-.,]|{CURRENCY})*\d++(?![-/:])"

# A mark that is followed by a later, different mark which ends the marks.
THOUSANDS_MARK = r"\.(?=.*,[^.]*$)|,(?=.*\.[^,]*$)"


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled double. rint() keeps the sign of zero, hence + 0.0."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / scale + F.lit(0.0)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# These parsers are chains in which each step is used once: an expression used twice is
# computed and compiled twice.


def _double(text: Column) -> Column:
    """Number from text with ',' and '.'; the last of the two is the decimal mark."""
    return cast_number(F.translate(F.regexp_replace(text, THOUSANDS_MARK, ""), ",", "."))


def cast_number(text: Column) -> Column:
    """Double from dotted text, NULL otherwise.

    Casting unreadable text raises and catches an exception for every cell, so only what matches
    the pattern reaches the cast.
    """
    return F.get(F.regexp_extract_all(text, F.lit(DOTTED_NUMBER), 0), F.lit(0)).try_cast("double")


def parse_local_number(c: Column, allow_free: bool = False, stripped: Column | None = None) -> Column:
    """Read a typed number; text that is not one gives NULL.

    Words for "missing" need no list of their own: none of them reads as a number. `stripped` is the stripped text, where there is one.
    """
    typed = F.when(c.rlike(TYPED_NUMBER), F.translate(c, ",", ".").try_cast("double"))
    # The clean-up stands in a lambda: compiled in line, dozens of parsed columns make one method too long for the JVM to compile.
    number = typed.when(c.rlike(MAYBE_NUMBER), bound(strip(c) if stripped is None else stripped, lambda text: _double(F.regexp_replace(text, NUMBER_NOISE, ""))))
    if allow_free:
        word = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
        number = F.coalesce(number, F.when(word.isin(V.FREE_WORDS), F.lit(0.0)))
    return number


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def as_number(c: Column, data_type: T.DataType, allow_free: bool = False) -> Column:
    """The column as double: cast when already numeric, parsed when text."""
    if is_numeric_type(data_type):
        return finite(c.cast("double")) if isinstance(data_type, (T.FloatType, T.DoubleType)) else c.cast("double")
    if isinstance(data_type, T.BooleanType):
        return c.cast("double")
    return parse_local_number(c.cast("string"), allow_free)


def is_plain_number(c: Column) -> Column:
    """True when the cell needs no unit, currency or percent clean-up; missing counts as plain."""
    return F.coalesce(F.translate(strip(c), SPACES, "").rlike(PLAIN_NUMBER), F.lit(True))


def parse_strict_amount(c: Column) -> Column:
    """Positive amount of at most 100 million with at most two decimals, else NULL."""
    text = F.translate(F.regexp_replace(c, r"(?U)\s", ""), ",", ".")
    # Nine digits at most before the mark: a longer number is above the limit anyway.
    amount = F.get(F.regexp_extract_all(text, F.lit(r"^0*(\d{1,9}(?:\.\d{1,2})?)$"), 1), F.lit(0)).try_cast("double")
    return F.when(amount.between(0.01, 100_000_000), amount)


def parse_invoice_amount(c: Column) -> Column:
    """Amount printed on an invoice. A lone kind of mark is decimal only before one or two digits."""
    text = F.regexp_replace(c, r"(?U)[\s']", "")
    both = text.rlike(r",.*\.|\..*,")
    # Drop every mark but a last one with one or two digits behind it.
    single = F.regexp_replace(text, r"[.,](?!\d{1,2}$)", "")
    return _double(F.when(both, text).otherwise(single))


def parse_optional_number(c: Column) -> Column:
    """Number typed in an optional field; blank and unreadable both give NULL."""
    return _double(F.translate(strip(c), WIDE_SPACES, ""))


def is_bad_optional_number(c: Column) -> Column:
    """True when an optional field holds something that is not a number."""
    text = F.coalesce(F.translate(strip(c), WIDE_SPACES, ""), F.lit(""))
    return (text != "") & parse_optional_number(text).isNull()


def display_number(c: Column) -> Column:
    return round_even(finite(c.cast("double")), 2)


def result_value(c: Column, data_type: T.DataType) -> Column:
    """One console cell: four decimals, no NaN, ISO dates, other types as text."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return round_even(F.when(~F.isnan(c), c), 4)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(data_type, (T.IntegralType, T.StringType, T.BooleanType)):
        return c
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")
