"""Sale lines, OCR lines, invoices and business vocabulary in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainmill.functions import vocabulary as V
from grainmill.functions.text import normalize_name, padded
from grainmill.operators import documents, invoices as inv_ops, phrases, scoring
from grainmill.sources import files
from workload.base import invoices, on_invoices, on_sales, query, sales, sql_normal, table

# A notebook page per order: a dated header, one-line sales, a two-line sale, and a total.
PAGES = """pages as (select o_orderkey as doc_id, concat('Ventes du ', strftime(o_orderdate, '%d/%m/%Y'), chr(10), 'Pain ', o_custkey + 1, ',50', chr(10), 'Huile', chr(10),
  o_custkey + 2, chr(10), 'Lait : ', (o_custkey % 90) + 10, '.00 DH', chr(10), 'Total ', o_custkey + 100) as text from orders)"""


def pages(spark, sf_dir):
    return spark.sql(
        "select o_orderkey doc_id, o_custkey, o_orderdate, concat('Ventes du ', date_format(o_orderdate, 'dd/MM/yyyy'), chr(10), 'Pain ', o_custkey + 1, ',50', chr(10), 'Huile', "
        "chr(10), o_custkey + 2, chr(10), 'Lait : ', (o_custkey % 90) + 10, '.00 DH', chr(10), 'Total ', o_custkey + 100) text from {orders}",
        orders=table(spark, sf_dir, "orders"),
    )


SALE_LINES = """
select o_orderkey as doc_id, 2::int as line_no, '{date}' as date, 'Pain' as product, '1' as quantity, concat(o_custkey + 1, '.50') as amount, cast(null as double) as confidence from orders
union all select o_orderkey, 4, '{date}', 'Huile', '1', concat(o_custkey + 2, '.00'), null from orders where o_custkey + 2 >= 100
union all select o_orderkey, 5, '{date}', 'Lait', '1', concat((o_custkey % 90) + 10, '.00'), null from orders
"""


@query("doc1_sale_lines", SALE_LINES.format(date=""))
def sale_lines(spark, sf_dir):
    return documents.sale_lines(pages(spark, sf_dir), "doc_id", "text")


@query("doc2_summary_lines", f"""
with {PAGES}, l as (select doc_id, unnest(string_split(text, chr(10))) as line from pages)
select line like 'Total%' or line like 'Ventes%' as summary, count(*) as lines from l group by 1
""")
def summary_lines(spark, sf_dir):
    lines = files.document_lines(pages(spark, sf_dir), ["doc_id"])
    return lines.groupBy(documents.is_summary(F.col("line")).alias("summary")).agg(F.count("*").alias("lines"))


@query("doc3_page_dates", SALE_LINES.replace("'{date}'", "strftime(o_orderdate, '%Y-%m-%d')"))
def page_dates(spark, sf_dir):
    return documents.sale_lines(pages(spark, sf_dir), "doc_id", "text", current_year=2026, dated=True)


def _boxes(spark, sf_dir):
    """Every word of a conversation as a box on a tilted page, one page per conversation."""
    words = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), "turn", F.posexplode(documents.text_lines(F.col("text"))).alias("row", "line")
    ).select("page_id", "turn", "row", F.posexplode(F.split("line", " ")).alias("col", "text"))
    x, y = F.col("col") * 100.0, F.col("turn") * 6000.0 + F.col("row") * 40.0
    tilt = 0.05
    corner = lambda dx, dy: (
        (x + dx) * F.cos(F.lit(tilt)) - (y + dy) * F.sin(F.lit(tilt)), (x + dx) * F.sin(F.lit(tilt)) + (y + dy) * F.cos(F.lit(tilt)),
    )
    corners = [corner(0, 0), corner(90, 0), corner(90, 20), corner(0, 20)]
    return words.select(
        "page_id", (F.col("turn") * 10_000_000 + F.col("row") * 10_000 + F.col("col")).alias("box_id"), "text", F.lit(0.9).alias("score"),
        *[c.alias(f"{axis}{i}") for i, pair in enumerate(corners) for axis, c in zip("xy", pair)],
    )


@query("doc4_reading_lines", """
select conv_id as page_id, cast(row_number() over (partition by conv_id order by turn, r) as int) as place, line as text, 0.9::double as score from (
  select conv_id, turn, r, array_to_string(list_filter(string_split(raw, ' '), lambda w: trim(w) <> ''), ' ') as line from (
    select conv_id, turn, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as r from conversations))
where line <> ''
""")
def reading_lines(spark, sf_dir):
    """The lines of each page from top to bottom."""
    order = Window.partitionBy("page_id").orderBy("island", "line")
    return documents.reading_lines(_boxes(spark, sf_dir)).select("page_id", F.row_number().over(order).alias("place"), "text", "score")


@query("jn8_line_accuracy", """
select o_orderkey as doc_id, 4::bigint as expected_rows, n as proposed_rows, n as rows_found, round_even(n / 4 * 100, 1) as recall_pct, n - (o_custkey % 3 = 0)::int as exact_amounts,
  round_even((n - (o_custkey % 3 = 0)::int) / 4 * 100, 1) as amount_accuracy_pct, 0::bigint as extra_rows,
  round_even(o_custkey + 1.5 + (o_custkey % 3 = 0)::int + o_custkey + 2 + o_custkey % 90 + 10 + 7::double, 2) as expected_total,
  round_even(o_custkey + 1.5 + (case when o_custkey + 2 >= 100 then o_custkey + 2 else 0 end) + o_custkey % 90 + 10::double, 2) as proposed_total
from (select *, 2 + (o_custkey + 2 >= 100)::bigint as n from orders)
""")
def line_accuracy(spark, sf_dir):
    """Lines read from the notebook pages against what was sold: misspelt names, one amount in three off, one line nobody wrote down."""
    c = F.col("o_custkey")
    lines = [("Pains", c + 1.5 + F.when(c % 3 == 0, 1).otherwise(0)), ("huille", c + 2), ("LAIT", c % 90 + 10), ("Zzyzx", F.lit(7))]
    sold = F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(name).alias("product"), amount.cast("string").alias("amount")) for k, (name, amount) in enumerate(lines, 1)])
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(sold))
    # A table of one row group is one task's work, so the pages are dealt out before they are read.
    notes = pages(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scoring.accuracy(expected, documents.sale_lines(notes, "doc_id", "text"))


@query("doc5_document_batch", on_sales("""
select 'sales.csv' as source, count(*) as suggested_rows from sales
union all select 'notes', (select count(*) * 2 + count(*) filter (o_custkey + 2 >= 100) from orders)
"""))
def document_batch(spark, sf_dir):
    renamed = sales(spark, sf_dir).withColumnRenamed("amount", "montant")
    notes = documents.sale_lines(pages(spark, sf_dir), "doc_id", "text").withColumn("source", F.lit("notes"))
    return documents.review_counts(documents.document_batch([documents.canonical_sales(renamed, "sales.csv"), notes]))


@query("src8_canonical_sales", on_sales("""
select '' as date, product, cast(quantity as varchar) as quantity, cast(amount as varchar) as amount, 'sales.csv' as source from sales
"""))
def canonical_sales(spark, sf_dir):
    renamed = sales(spark, sf_dir).withColumnRenamed("amount", "montant")
    return documents.canonical_sales(renamed, "sales.csv")


@query("flt1_validate_sales", """
with p as (select o_orderkey, case when o_custkey % 11 = 0 then '' else o_orderpriority end as product, case when o_custkey % 13 = 0 then '0' else cast(o_custkey % 50 + 1 as varchar) end as quantity,
  case when o_custkey % 17 = 0 then '12,345' else concat(o_custkey + 1, ',50') end as amount, case when o_custkey % 19 = 0 then '2026-02-30' else strftime(o_orderdate, '%Y-%m-%d') end as date from orders)
select o_orderkey, case when product = '' then 'product' when date = '2026-02-30' then 'date' when quantity = '0' then 'quantity' when amount = '12,345' then 'amount' end as reject_reason,
  case when not (product = '' or date = '2026-02-30' or quantity = '0' or amount = '12,345') then try_cast(replace(amount, ',', '.') as double) end as sale_amount from p
""")
def validate_sales(spark, sf_dir):
    c = F.col("o_custkey")
    posted = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("product"),
        F.when(c % 13 == 0, "0").otherwise((c % 50 + 1).cast("string")).alias("quantity"),
        F.when(c % 17 == 0, "12,345").otherwise(F.concat(c + 1, F.lit(",50"))).alias("amount"),
        F.when(c % 19 == 0, "2026-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
    )
    return documents.validate_sales(posted, "date", "product", "quantity", "amount").select("o_orderkey", "reject_reason", "sale_amount")


@query("flt2_review_overlay", """
select o_orderkey, case when o_orderstatus = 'F' then 'F' else 'Saisie manuelle' end as source from orders where not (o_custkey % 7 = 0 and o_custkey % 5 = 0)
""")
def review_overlay(spark, sf_dir):
    c = F.col("o_custkey")
    posted = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("source"), F.when(c % 7 == 0, "  ").otherwise("x").alias("product"), F.when(c % 5 == 0, "").otherwise("1").alias("amount"),
    )
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderstatus").alias("source"))
    return documents.review_overlay(posted, known).select("o_orderkey", "source")


@query("src5_text_lines", """
select doc_id, line_no, line from (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line_no, unnest(string_split(text, chr(10))) as line from documents)
""")
def text_lines(spark, sf_dir):
    return files.document_lines(table(spark, sf_dir, "documents"), ["doc_id"])


# -- invoices ---------------------------------------------------------------------------------------------------

# What each order's invoice says.
FACTS = """from orders join customer on c_custkey = o_custkey"""
TOTAL = "cast(cast(cast(o_totalprice as decimal(18,2)) + o_custkey as decimal(20,2)) as double)"
HT = "cast(cast(o_totalprice as decimal(18,2)) as double)"
DATE = "strftime(o_orderdate, '%Y-%m-%d')"


@query("inv1_clean_lines", on_invoices("""
select doc_id, len(string_split(text, chr(10))) as lines, list_extract(string_split(text, chr(10)), 2) as second from inv
"""))
def clean_lines(spark, sf_dir):
    lines = inv_ops.clean_lines(F.col("text"))
    return invoices(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", F.size("l").cast("bigint").alias("lines"), F.get("l", F.lit(1)).alias("second"))


def _field(key, name, value, sql_type="varchar"):
    @query(key, f"select o_orderkey as doc_id, {value} as value, {CONFIDENCE[name]}::double as confidence {FACTS}")
    def one_field(spark, sf_dir):
        finds = inv_ops.invoice_finds(invoices(spark, sf_dir), "doc_id", "text")
        return finds.select("doc_id", F.col(f"{name}.value").alias("value"), F.col(f"{name}.confidence").alias("confidence"))


CONFIDENCE = {
    "supplier": 0.97, "invoice_number": 0.98, "invoice_date": 0.90, "total_including_tax": 0.97, "subtotal_excluding_tax": 0.95, "vat_amount": 0.91,
    "vat_rate": 0.96, "currency": 0.99,
}
_field("inv2_supplier", "supplier", "concat(c_name, ' SARL')")
_field("inv3_invoice_number", "invoice_number", "concat('FA-', o_orderkey)")
_field("inv4_invoice_date", "invoice_date", DATE)
_field("inv5_total", "total_including_tax", TOTAL)
_field("inv5_subtotal", "subtotal_excluding_tax", HT)
_field("inv6_vat_amount", "vat_amount", "o_custkey::double")
_field("inv6_vat_rate", "vat_rate", "20.0::double")
_field("inv7_currency", "currency", "'MAD'")


@query("inv8_review", f"""
select o_orderkey as doc_id, 'needs_review' as status, 8 as fields_to_confirm, '' as missing_fields, '' as missing_required_fields,
  round_even((0.97 + 0.98 + 0.9 + 0.95 + 0.97 + 0.91 + 0.96 + 0.99) / 8, 2) as average_confidence, 5 as required_fields_detected {FACTS}
""")
def invoice_review(spark, sf_dir):
    return inv_ops.invoice_review(inv_ops.invoice_finds(invoices(spark, sf_dir), "doc_id", "text"), "doc_id")


RAW_TOTAL = "replace(cast(cast(o_totalprice as decimal(18,2)) + o_custkey as varchar), '.', ',')"
RAW_HT = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"
SHOWN = "strftime(o_orderdate, '%d/%m/%Y')"
#: Field, value, what stood in the text, line it stood on.
FOUND = [
    ("supplier", "concat(c_name, ' SARL')", "concat(c_name, ' SARL')", "concat('Supplier: ', c_name, ' SARL')"),
    ("invoice_number", "concat('FA-', o_orderkey)", "concat('FA-', o_orderkey)", "concat('Facture N° FA-', o_orderkey)"),
    ("invoice_date", DATE, SHOWN, f"concat('Date de facture : ', {SHOWN})"),
    ("subtotal_excluding_tax", f"cast({HT} as varchar)", RAW_HT, f"concat('Sous-total HT : ', {RAW_HT}, ' MAD')"),
    ("vat_amount", "cast(o_custkey::double as varchar)", "concat(o_custkey, ',00')", "concat('TVA 20 % : ', o_custkey, ',00 MAD')"),
    ("vat_rate", "'20.0'", "'20%'", "concat('TVA 20 % : ', o_custkey, ',00 MAD')"),
    ("total_including_tax", f"cast({TOTAL} as varchar)", RAW_TOTAL, f"concat('TOTAL TTC : ', {RAW_TOTAL}, ' MAD')"),
    ("currency", "'MAD'", "'MAD'", f"concat('TOTAL TTC : ', {RAW_TOTAL}, ' MAD')"),
]


@query("inv8_fields", " union all ".join(
    f"select o_orderkey as doc_id, '{field}' as field, {value} as value, {raw} as raw_value, {CONFIDENCE[field]}::double as confidence, {line} as evidence, "
    f"'to_confirm' as status, 'normal' as review_priority {FACTS}" for field, value, raw, line in FOUND))
def invoice_fields(spark, sf_dir):
    return inv_ops.invoice_fields(inv_ops.invoice_finds(invoices(spark, sf_dir), "doc_id", "text"), "doc_id")


TABLE = f"""select o_orderkey as doc_id, concat(c_name, ' SARL') as fournisseur, concat('FA-', o_orderkey) as numero_facture, {DATE} as date_facture, {HT} as total_ht,
  o_custkey::double as tva, {TOTAL} as total_ttc, 'MAD' as devise, 20.0::double as taux_tva, 'À vérifier' as etat {FACTS}"""


@query("inv9_invoice_table", TABLE)
def invoice_table(spark, sf_dir):
    return inv_ops.invoice_table(inv_ops.invoice_finds(invoices(spark, sf_dir), "doc_id", "text"), "doc_id")


@query("flt3_confirm_invoices", f"""
with t as ({TABLE}) select doc_id, case when total_ttc > 200000 then null else fournisseur end as fournisseur, case when total_ttc > 200000 then 12.5 else total_ttc end as total_ttc,
  case when total_ttc > 200000 then 'Confirmé par vous' else etat end as etat, false as bad_number from t
""")
def confirm_invoices(spark, sf_dir):
    found = inv_ops.invoice_table(inv_ops.invoice_finds(invoices(spark, sf_dir), "doc_id", "text"), "doc_id")
    typed = found.where("total_ttc > 200000").select(
        "doc_id", F.lit("  ").alias("fournisseur"), "numero_facture", "date_facture", "devise", F.lit("12,5").alias("total_ttc"),
        *[F.col(c).cast("string").alias(c) for c in ("total_ht", "tva", "taux_tva")],
    )
    return inv_ops.confirm_invoices(found, typed, "doc_id").select("doc_id", "fournisseur", "total_ttc", "etat", "bad_number")


# -- vocabulary ----------------------------------------------------------------------------------------------------


def _has(text: str, phrase: str) -> str:
    return f"contains({text}, ' {normalize_name(phrase)} ')"


def _first(text: str, terms) -> str:
    ordered = sorted(terms, key=lambda p: -len(normalize_name(p).split()))
    return "case " + " ".join(f"when {_has(text, p)} then '{p}'" for p in ordered) + " end"


# Questions made from the names of the parts, the customers' segments and the words of each text.
ASKED = f"""asked as (select doc_id, concat(' ', {sql_normal("concat(text, ' total du chiffre d''affaires par ', lang, ' et par ville')")}, ' ') as p from documents)"""


def _asked(spark, sf_dir):
    text = F.concat("text", F.lit(" total du chiffre d'affaires par "), "lang", F.lit(" et par ville"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("txt1_concepts", f"with {ASKED} select * from (" + " union all ".join(
    f"select doc_id, '{concept}' as concept, {_first('p', terms)} as matched_term from asked" for concept, terms in V.BUSINESS_CONCEPTS.items())
    + ") where matched_term is not null")
def concepts(spark, sf_dir):
    return phrases.tag_concepts(_asked(spark, sf_dir), ["doc_id"], "text")


CATALOGUE = [("order_date", "date"), ("city", "category"), ("product", "category"), ("amount", "number"), ("ventes", "number"), ("quantity", "number")]
ALIASES = {"amount": ["chiffre d'affaires"]}


def _match(place: int, name: str, kind: str) -> str:
    shared = sorted(phrases.column_concepts(name, kind))
    terms = [f"case when {_has('p', t)} then '{t.replace(chr(39), chr(39) * 2)}' end" for t in [name, *ALIASES.get(name, [])]] + [_first("p", V.BUSINESS_CONCEPTS[c]) for c in shared]
    cases = [f"when {_has('p', name)} then 1.0"]
    cases += [f"when {_has('p', a)} then 0.95" for a in ALIASES.get(name, [])]
    cases += [f"when {' or '.join(_has('p', t) for c in shared for t in V.BUSINESS_CONCEPTS[c])} then 0.85"] if shared else []
    return f"select doc_id, {place} as place, '{name}' as column_name, '{kind}' as kind, (case {' '.join(cases)} end)::double as confidence, coalesce({', '.join(terms)}, null) as matched_term from asked"


@query("txt2_resolve_columns", f"""with {ASKED}
select doc_id, column_name, kind, confidence, matched_term, cast(row_number() over (partition by doc_id order by confidence desc, place) as int) as rank from (
""" + " union all ".join(_match(i, n, k) for i, (n, k) in enumerate(CATALOGUE)) + ") where confidence is not null")
def resolve_columns(spark, sf_dir):
    return phrases.resolve_columns(_asked(spark, sf_dir), ["doc_id"], "text", CATALOGUE, ALIASES)


def _choice(groups) -> str:
    return "case " + " ".join(f"when {' or '.join(_has('p', t) for t in terms)} then '{name}'" for name, terms in groups.items()) + " end"


@query("txt3_asked_aggregation", f"with {ASKED} select doc_id, {_choice(V.AGGREGATION_PHRASES)} as aggregation from asked")
def asked_aggregation(spark, sf_dir):
    words = _asked(spark, sf_dir).select("doc_id", padded(F.col("text")).alias("p"))
    return words.select("doc_id", phrases.asked_aggregation(F.col("p")).alias("aggregation"))


@query("txt4_asked_chart", f"with {ASKED} select doc_id, coalesce({_choice(V.CHART_PHRASES)}, 'auto') as chart_type, "
       + " or ".join(_has("p", m) for m in V.GROUPING_MARKERS) + " as grouped from asked")
def asked_chart(spark, sf_dir):
    words = _asked(spark, sf_dir).select("doc_id", padded(F.col("text")).alias("p"))
    return words.select("doc_id", phrases.asked_chart_type(F.col("p")).alias("chart_type"), phrases.is_grouped(F.col("p")).alias("grouped"))


@query("txt5_chart_specs")
def chart_specs(spark, sf_dir):
    specs = phrases.chart_specs(_asked(spark, sf_dir), ["doc_id"], "text", CATALOGUE[:4], ALIASES)
    return phrases.charts_for_texts(sales(spark, sf_dir), specs)


@query("txt6_dictionary_aliases", """
select p_brand as "column", term from (select distinct p_brand, unnest([p_brand, lower(p_brand), p_type, concat('x ', p_type)]) as term from part)
""")
def dictionary_aliases(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("column"), F.col("p_brand").alias("display_name"), F.lower("p_brand").alias("label_fr"), F.lit("").alias("label_ar"),
        F.concat("p_type", F.lit("; x "), "p_type", F.lit(" ,")).alias("synonyms"),
    )
    return phrases.dictionary_aliases(entries).distinct()
