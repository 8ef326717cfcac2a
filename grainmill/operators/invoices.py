"""Invoice fields from text. One invoice is one row; every rule is a search over its array of lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.binding import bound
from grainmill.functions.dates import parse_invoice_date
from grainmill.functions.numbers import is_bad_optional_number, parse_invoice_amount, parse_optional_number, round_even
from grainmill.functions.text import fold_lines, strip
from grainmill.operators.documents import LINE_BREAK
from grainmill.operators.roles import quoted

# Search patterns of each field with the confidence of a find.
SUPPLIER_LABEL = r"(?iU)^(?:fournisseur|prestataire|vendeur|[ée]metteur|supplier|vendor)\s*[:\-]\s*(.+)$"
SUPPLIER_FORBIDDEN = r"(?iU)\b(?:client|facture|invoice|total|tva|vat|date|adresse|address|ice|if|rc)\b"
LEGAL_FORM = r"(?iU)\b(?:sarl(?:\s+au)?|s\.?a\.?|sas(?:u)?|eurl|llc|ltd\.?|inc\.?|gmbh)\b"
NO_LETTER = r"(?U)^[\d\W]+$"
NUMBER_PATTERNS = [
    (r"(?iU)\b(?:facture|invoice)\s*(?:num[ée]ro|number|n[°ºo]|no\.?|#)\s*[:#\-]?\s*([a-z0-9][a-z0-9._/\-]{1,})", 0.98),
    (r"(?iU)\b(?:num[ée]ro|number|n[°ºo]|no\.?)\s*(?:de\s+(?:la\s+)?)?(?:facture|invoice)\s*[:#\-]\s*([a-z0-9][a-z0-9._/\-]{1,})", 0.98),
    (r"(?iU)\b(?:r[ée]f(?:[ée]rence)?(?:\s+facture)?|invoice\s+id)\s*[:#\-]\s*([a-z0-9][a-z0-9._/\-]{1,})", 0.93),
    (r"(?iU)^\s*(?:facture|invoice)\s*[:#]\s*([a-z0-9][a-z0-9._/\-]{1,})", 0.86),
]
# Stands in every line that one of the number patterns finds.
NUMBER_WORD = r"(?iU)facture|invoice|r[ée]f"
NUMBER_STOPWORDS = ["date", "numero", "number", "facture", "invoice", "du", "de", "the"]
DATE_LABELS = [
    (r"date\s+(?:de\s+(?:la\s+)?)?facture", 0.98),
    (r"date\s+d['’]?emission", 0.96),
    (r"invoice\s+date", 0.98),
    (r"(?:emise|issued)\s+(?:le|on)", 0.93),
    (r"date", 0.82),
]
DATE_WORDS = ["date", "emise", "issued"]
DUE_DATE = r"(?U)\b(?:echeance|due\s+date|date\s+limite|payment\s+date)\b"
ISSUE_DATE = r"(?U)\b(?:facture|invoice\s+date|emission)\b"
WRITTEN_DATE = r"(\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}|\d{1,2}\s+[A-Za-zÀ-ÿ]+\s+\d{4})"
PRINTED_AMOUNT = r"(?U)((?<!\w)[-+]?\d(?:[\d \u00a0\u202f.,']*\d)?(?!\w))(\s*%)?"
TOTAL_WORDS = ["total", "montant", "net", "due"]
TOTAL_LABELS = [
    r"\btotal\s+t\.?t\.?c\.?(?:\b|\s|:)", r"\bmontant\s+(?:ttc|total)\b", r"\bnet\s+a\s+payer\b",
    r"\bgrand\s+total\b", r"\bamount\s+due\b", r"\btotal\s+including\s+tax\b",
]
SUBTOTAL_WORDS = ["total"]
SUBTOTAL_LABELS = [
    r"\bsous[\s-]*total\s+h\.?t\.?(?:\b|\s|:)", r"\btotal\s+h\.?t\.?(?:\b|\s|:)", r"\bsubtotal\s+excluding\s+tax\b",
]
VAT_WORDS = ["tva", "vat", "taxe"]
VAT_LINE = r"(?U)\b(?:tva|vat|taxe\s+sur\s+(?:la\s+)?valeur\s+ajoutee)\b"
VAT_RATE = r"(?iU)\b(?:TVA|VAT)\b[^\n]{0,40}?(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
CURRENCY_PATTERNS = [
    (r"(?iU)\bMAD\b", "MAD", 0.99), (r"(?iU)\b(?:DHS?|DIRHAMS?)\b", "MAD", 0.92), (r"(?iU)\bEUR\b|€", "EUR", 0.99),
    (r"(?iU)\bUSD\b", "USD", 0.99), (r"(?iU)\bCAD\b", "CAD", 0.99), (r"(?iU)\bAUD\b", "AUD", 0.99),
    (r"(?iU)\bGBP\b|£", "GBP", 0.99), (r"\$", "$", 0.72),
]

# Fields in order, the required ones, and their names in the invoice table.
FIELDS = [
    "supplier", "invoice_number", "invoice_date", "subtotal_excluding_tax", "total_including_tax",
    "vat_amount", "vat_rate", "currency",
]
REQUIRED_FIELDS = ["supplier", "invoice_number", "invoice_date", "total_including_tax", "currency"]
TABLE_NAMES = {
    "supplier": "fournisseur", "invoice_number": "numero_facture", "invoice_date": "date_facture",
    "subtotal_excluding_tax": "total_ht", "vat_amount": "tva", "total_including_tax": "total_ttc",
    "currency": "devise", "vat_rate": "taux_tva",
}
TEXT_FIELDS = ["fournisseur", "numero_facture", "date_facture", "devise"]
NUMBER_FIELDS = ["total_ht", "tva", "taux_tva", "total_ttc"]


def clean_lines(text: Column) -> Column:
    """Non-empty lines with single spaces and no table bars at the ends."""
    spaced = F.regexp_replace(F.translate(text, "\x00", " "), "[\t \u00a0\u202f]+", " ")
    return F.filter(F.transform(F.split(spaced, LINE_BREAK), lambda l: F.btrim(l, F.lit(" |"))), lambda l: l != "")


def with_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc and `lines`: array of (raw, folded), folded being lower case without accents."""
    raw = df.select(quoted(doc).alias(doc), clean_lines(quoted(text)).alias("raw"))
    return raw.select(doc, "raw", fold_lines(F.col("raw")).alias("folded")).select(doc, F.arrays_zip("raw", "folded").alias("lines"))


def _find(value: Column, confidence: Column | float, evidence: Column, raw: Column | None = None) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        value.alias("value"), (value if raw is None else raw).cast("string").alias("raw_value"),
        confidence.alias("confidence"), evidence.alias("evidence"),
    )


def _first(lines: Column, rule: Callable[[Column], Column], may: Callable[[Column], Column] | None = None) -> Column:
    """First line for which the rule gives a find. `may` is a cheap test that every such line passes."""
    return F.get(F.filter(F.transform(F.filter(lines, may) if may else lines, rule), lambda x: x.isNotNull()), F.lit(0))


def _holds(words: Sequence[str]) -> Callable[[Column], Column]:
    """Whether the folded line holds one of the words anywhere."""
    return lambda line: reduce(or_, [F.contains(line["folded"], F.lit(w)) for w in words])


def supplier(lines: Column) -> Column:
    def sized(c: Column) -> Column:
        return F.length(c).between(2, 120) & ~c.rlike(NO_LETTER)

    def labelled(line: Column) -> Column:
        name = F.btrim(F.regexp_extract(line["raw"], SUPPLIER_LABEL, 1), F.lit(" :-"))
        return bound(name, lambda n: F.when(sized(n), _find(n, 0.97, line["raw"])))

    def by_legal_form(line: Column) -> Column:
        raw = line["raw"]
        return F.when(sized(raw) & raw.rlike(LEGAL_FORM) & ~raw.rlike(SUPPLIER_FORBIDDEN), _find(raw, 0.74, raw))

    return F.coalesce(
        _first(F.slice(lines, 1, 20), labelled, lambda line: line["raw"].rlike(SUPPLIER_LABEL)),
        _first(F.slice(lines, 1, 10), by_legal_form),
    )


def invoice_number(lines: Column) -> Column:
    def rule(line: Column) -> Column:
        finds = []
        for pattern, confidence in NUMBER_PATTERNS:
            candidate = F.btrim(F.regexp_extract(line["raw"], pattern, 1), F.lit(" .,:;#"))
            finds.append(bound(candidate, lambda c: F.when((c != "") & ~F.lower(c).isin(NUMBER_STOPWORDS), _find(c, confidence, line["raw"]))))  # noqa: B023
        return F.coalesce(*finds)

    return _first(lines, rule, lambda line: line["raw"].rlike(NUMBER_WORD))


def invoice_date(lines: Column) -> Column:
    def rule(line: Column) -> Column:
        folded = line["folded"]
        finds = []
        for label, confidence in DATE_LABELS:
            rest = F.regexp_extract(folded, label + r"\s*[:\-]?\s*(.+)$", 1)
            finds.append(bound(rest, lambda r: F.when(r != "", dated(line, r, confidence))))  # noqa: B023
        due = folded.rlike(DUE_DATE) & ~folded.rlike(ISSUE_DATE)
        return F.when(~due, F.coalesce(*finds))

    def dated(line: Column, rest: Column, confidence: float) -> Column:
        parsed = parse_invoice_date(F.regexp_replace(F.btrim(rest, F.lit(" .,:;")), r"\s+", " "), folded=True)
        raw = bound(F.regexp_extract(line["raw"], WRITTEN_DATE, 1), lambda w: F.when(w != "", w).otherwise(strip(rest)))
        return bound(parsed, lambda p: F.when(p["value"].isNotNull(), _find(p["value"], F.least(F.lit(confidence), p["confidence"]), line["raw"], raw)))

    return _first(lines, rule, _holds(DATE_WORDS))


def last_amount(raw: Column) -> Column:
    """struct(text, number) of the last amount of a line that is not a percentage."""
    printed = F.filter(F.regexp_extract_all(raw, F.lit(PRINTED_AMOUNT), 0), lambda m: ~m.endswith("%"))
    parsed = F.transform(printed, lambda m: F.struct(strip(m).alias("text"), parse_invoice_amount(m).alias("number")))
    return F.try_element_at(F.filter(parsed, lambda p: p["number"].isNotNull()), F.lit(-1))


def labelled_amount(lines: Column, labels: Sequence[str], confidence: float, words: Sequence[str] = ()) -> Column:
    """`words`: plain words of which every label holds one."""
    pattern = "(?U)" + "|".join(labels)

    def rule(line: Column) -> Column:
        return F.when(line["folded"].rlike(pattern), bound(last_amount(line["raw"]), lambda amount: F.when(
            amount.isNotNull(), _find(amount["number"], confidence, line["raw"], amount["text"]),
        )))

    return _first(lines, rule, _holds(words) if words else None)


def vat_rate(vat_lines: Column) -> Column:
    def rule(line: Column) -> Column:
        text = F.regexp_extract(line["raw"], VAT_RATE, 1)
        read = F.struct(text.alias("text"), parse_invoice_amount(text).alias("rate"))
        return bound(read, lambda r: F.when(r["rate"].between(0, 100), _find(r["rate"], 0.96, line["raw"], F.concat(r["text"], F.lit("%")))))

    return _first(vat_lines, rule)


def currency(lines: Column, total_evidence: Column) -> Column:
    def rule(raw: Column) -> Column:
        return F.coalesce(*[
            F.when(raw.rlike(p), _find(F.lit(code), c, raw, F.regexp_extract(raw, p, 0))) for p, code, c in CURRENCY_PATTERNS
        ])

    return F.coalesce(rule(total_evidence), _first(lines, lambda line: rule(line["raw"])))


def invoice_finds(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per invoice with a struct (value, raw_value, confidence, evidence) per field."""
    lines = F.col("lines")
    base = with_lines(df, doc, text)
    vat_lines = F.filter(lines, lambda l: _holds(VAT_WORDS)(l) & l["folded"].rlike(VAT_LINE))
    found = base.withColumns({
        "supplier": supplier(lines),
        "invoice_number": invoice_number(lines),
        "invoice_date": invoice_date(lines),
        "subtotal_excluding_tax": labelled_amount(lines, SUBTOTAL_LABELS, 0.95, SUBTOTAL_WORDS),
        "total_including_tax": labelled_amount(lines, TOTAL_LABELS, 0.97, TOTAL_WORDS),
        "vat_amount": labelled_amount(vat_lines, ["."], 0.91),
        "vat_rate": vat_rate(vat_lines),
    })
    return found.withColumn("currency", currency(lines, F.col("total_including_tax.evidence")))


def invoice_fields(finds: DataFrame, doc: str) -> DataFrame:
    """Long form: doc, field, value, raw_value, confidence, evidence, status, review_priority."""
    cells = []
    for name in FIELDS:
        c = F.col(name)
        detected = c.isNotNull()
        cells.append(F.struct(
            F.lit(name).alias("field"), c["value"].cast("string").alias("value"), c["raw_value"].alias("raw_value"),
            F.coalesce(c["confidence"], F.lit(0.0)).alias("confidence"), c["evidence"].alias("evidence"),
            F.when(detected, "to_confirm").otherwise("missing").alias("status"),
            F.when(detected, F.when(c["confidence"] < 0.8, "high").otherwise("normal")).alias("review_priority"),
        ))
    return finds.select(doc, F.inline(F.array(*cells)))


def invoice_review(finds: DataFrame, doc: str) -> DataFrame:
    """Per invoice: status, detected and missing fields, average confidence."""
    count = lambda names: sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    detected = count(FIELDS)
    missing = lambda names: F.array_join(F.filter(
        F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()), ",")
    confidence = sum((F.coalesce(F.col(n)["confidence"], F.lit(0.0)) for n in FIELDS), F.lit(0.0))
    return finds.select(
        doc,
        F.when(F.size("lines") == 0, "no_text").otherwise("needs_review").alias("status"),
        detected.alias("fields_to_confirm"),
        missing(FIELDS).alias("missing_fields"),
        missing(REQUIRED_FIELDS).alias("missing_required_fields"),
        F.coalesce(round_even(F.try_divide(confidence, detected), 2), F.lit(0.0)).alias("average_confidence"),
        count(REQUIRED_FIELDS).alias("required_fields_detected"),
    )


def invoice_table(finds: DataFrame, doc: str) -> DataFrame:
    """One row per invoice with the values of its fields and its review state."""
    detected = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(True)) for n in FIELDS], F.lit(False))
    return finds.select(
        doc, *[F.col(n)["value"].alias(name) for n, name in TABLE_NAMES.items()],
        F.when(detected, V.TO_CHECK_LABEL).otherwise(V.TO_COMPLETE_LABEL).alias("etat"),
    )


def confirm_invoices(table: DataFrame, corrections: DataFrame, doc: str) -> DataFrame:
    """Overlay typed corrections: they replace every field of their invoice, blank meaning none.

    `bad_number` flags an invoice whose correction holds an unreadable number.
    """
    typed = corrections.select(
        F.col(doc).alias("_doc"),
        *[F.nullif(F.substring(strip(F.col(c).cast("string")), 1, 160), F.lit("")).alias(f"_{c}") for c in TEXT_FIELDS],
        *[parse_optional_number(F.col(c).cast("string")).alias(f"_{c}") for c in NUMBER_FIELDS],
        F.greatest(*[is_bad_optional_number(F.col(c).cast("string")) for c in NUMBER_FIELDS]).alias("_bad"),
    )
    joined = table.join(typed, F.col(doc) == F.col("_doc"), "left")
    present = F.col("_doc").isNotNull()
    return joined.select(
        doc, *[F.when(present, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in [*TEXT_FIELDS, *NUMBER_FIELDS]],
        F.when(present, V.CONFIRMED_LABEL).otherwise(F.col("etat")).alias("etat"),
        F.coalesce("_bad", F.lit(False)).alias("bad_number"),
    )
