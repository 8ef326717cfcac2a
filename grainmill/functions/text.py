"""Text expressions. All run inside the JVM; none needs a Python worker."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V

# Every character a Unicode-aware strip removes, including no-break spaces.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Ordinary, no-break and narrow no-break space: separators inside a typed number.
SPACES = " \u00a0\u202f"

# Fixed value: a plain signed number with one optional decimal mark and exponent.
PLAIN_NUMBER = r"^[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_cell(c: Column) -> Column:
    """strip(), for columns in which most cells begin and end with printable ASCII characters, which are left as they are."""
    def printable(end: Column) -> Column:
        return end.between("!", "~")

    return F.when(printable(F.left(c, F.lit(1))) & printable(F.right(c, F.lit(1))), c).otherwise(strip(c))


def is_blank(c: Column) -> Column:
    """True for a text made only of white space; NULL stays NULL."""
    return strip(c) == ""


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


# -- character folding -----------------------------------------------------------------------


def _folding_rules(fold_one) -> tuple[str, str, dict[str, str]]:
    """Split a per-character rule into a translate pair and a few one-to-many replacements.

    Ideographs and Hangul (0x2E80-0xFAFF) keep their composed form: composing is one to one
    there, so equality between labels does not change.
    """
    source, target, dropped, longer = [], [], [], {}
    for code in chain(range(0x41, 0x2E80), range(0xFB00, 0x10000)):
        ch = chr(code)
        folded = fold_one(ch)
        if folded == ch:
            continue
        if not folded:
            dropped.append(ch)
        elif len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            longer[ch] = folded
    # translate() deletes the characters that have no counterpart, so marks go last.
    return "".join(source + dropped), "".join(target), longer


@lru_cache(maxsize=None)
def _accent_rules():
    def fold(ch: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))

    return _folding_rules(fold)


@lru_cache(maxsize=None)
def _case_rules():
    return _folding_rules(lambda ch: unicodedata.normalize("NFKC", ch).casefold())


NOT_ASCII = r"[^\x00-\x7f]"


def _letter_class(letters: str) -> str:
    """Regex class of the letters as ranges; thousands of single letters would match slowly."""
    codes = sorted(map(ord, letters))
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]"


def _apply_rules(c: Column, rules: tuple[str, str, dict[str, str]]) -> Column:
    source, target, longer = rules
    # Two texts that Spark splits while planning: a literal for each of the letters takes seconds to hand over.
    table = F.map_from_arrays(*[F.split(F.lit("\x01".join(side)), "\x01") for side in (longer.keys(), longer.values())])
    expanded = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    return F.translate(F.when(_holds_letter(c, longer), expanded).otherwise(c), source, target)


def _holds_letter(c: Column, letters: dict[str, str]) -> Column:
    """Whether the text has one of the letters, none of them ASCII: hundreds of ranges, so they only meet what is left without ASCII."""
    return F.regexp_replace(c, r"[\x00-\x7f]+", "").rlike(_letter_class("".join(letters)))


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks. ASCII text skips the tables."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _apply_rules(c, _accent_rules())).otherwise(c)


def casefold(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7f]"), _apply_rules(c, _case_rules())).otherwise(F.lower(c))


def plain(c: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.lower(fold_accents(c))


def fold_lines(lines: Column) -> Column:
    """plain() of every line of an array of non-empty lines without line feeds, folded as one text where that is the same."""
    source, target, longer = _accent_rules()
    whole = F.array_join(lines, "\n")
    folded = F.lower(F.when(whole.rlike(NOT_ASCII), F.translate(whole, source, target)).otherwise(whole))
    together = F.when(F.size(lines) == 0, lines).otherwise(F.split(folded, "\n"))
    # One-to-many letters are replaced letter by letter, which is left to the lines that hold one.
    return F.when(_holds_letter(whole, longer), F.transform(lines, plain)).otherwise(together)


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(plain(c), r"[^\p{L}\p{N}]+", " "))


# -- the same rules for column names, on the driver -------------------------------------------


def normalize_name(name: object) -> str:
    decomposed = unicodedata.normalize("NFKD", str(name))
    folded = "".join(ch for ch in decomposed if not unicodedata.combining(ch)).lower()
    return re.sub(r"[\W_]+", " ", folded).strip()


def name_key(name: object) -> str:
    return unicodedata.normalize("NFKC", str(name).strip()).casefold()


def is_sensitive_name(name: object) -> bool:
    return re.search(V.SENSITIVE_NAME, normalize_name(name), re.IGNORECASE) is not None


def is_sensitive(c: Column) -> Column:
    return normalize_text(c).rlike(V.SENSITIVE_NAME)


# -- phrases -----------------------------------------------------------------------------------


def padded(c: Column) -> Column:
    """Normalised words with a space on both sides, the form has_phrase() expects."""
    return F.concat(F.lit(" "), normalize_text(c), F.lit(" "))


def has_phrase(padded_text: Column, phrase: str) -> Column:
    """Whole-word phrase test on the output of padded()."""
    return F.contains(padded_text, F.lit(f" {normalize_name(phrase)} "))


# -- display and export -------------------------------------------------------------------------


def safe_spreadsheet_text(c: Column) -> Column:
    """Quote a cell a spreadsheet would run as a formula; signed numbers stay as they are."""
    lead = F.ltrim(c, F.lit(WHITESPACE))
    compact = F.translate(lead, SPACES, "")
    risky = lead.rlike(r"^[=+\-@]") & ~compact.rlike(PLAIN_NUMBER)
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def safe_spreadsheet_name(name: str) -> str:
    lead = name.lstrip()
    compact = re.sub(f"[{SPACES}]", "", lead)
    risky = lead[:1] in ("=", "+", "-", "@") and not re.match(PLAIN_NUMBER, compact)
    return "'" + name if risky else name


def clean_label(c: Column, limit: int = 100) -> Column:
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " ")
    return F.substring(strip(flat), 1, limit)


def split_identifier(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    words = F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}\u0600-\u06FF]+", " "), " ")
    return F.filter(words, lambda w: w != "")


# -- transliteration -----------------------------------------------------------------------------


def arabic_to_latin(c: Column) -> Column:
    out = fold_accents(c)
    for letter, latin in V.ARABIC_TO_LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {a: b for a, b in V.ARABIC_TO_LATIN.items() if len(b) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def latin_to_arabic(c: Column) -> Column:
    pairs = "|".join(V.LATIN_PAIRS_TO_ARABIC)
    letters = F.regexp_extract_all(F.replace(normalize_text(c), F.lit(" "), F.lit("")), F.lit(f"({pairs}|.)"), 1)
    # A lone final "e" is silent.
    spoken = F.when(F.get(F.reverse(letters), F.lit(0)) == "e", F.slice(letters, F.lit(1), F.size(letters) - 1))
    table = {**V.LATIN_PAIRS_TO_ARABIC, **V.LATIN_TO_ARABIC}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(
        F.transform(F.coalesce(spoken, letters), lambda p: F.coalesce(F.try_element_at(lookup, p), p)), ""
    )
