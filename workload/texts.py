"""Text, number and date expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import dates, numbers, text, vocabulary
from grainmill.operators import charts, cleaning, roles
from workload.base import dirty, messy, on_invoices, on_messy, on_sales, query, sales, sql_date, sql_normal, sql_number, table
from workload.base import invoices


@query("str1_normalize_text", f"""
select conv_id, turn, {sql_normal('text')} as normalized from conversations
""")
def normalize_text(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", text.normalize_text(F.col("text")).alias("normalized"))


@query("str1_normalize_documents", f"""
select doc_id, length({sql_normal('text')}) as chars, md5({sql_normal('text')}) as digest from documents
""")
def normalize_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return df.select("doc_id", F.length("n").cast("bigint").alias("chars"), F.md5("n").alias("digest"))


@query("str2_trim_or_null", on_messy("""
select nullif(trim(city), '') as city, count(*) as cells from messy group by 1
"""))
def trim_or_null(spark, sf_dir):
    return messy(spark, sf_dir).groupBy(text.text_or_null(F.col("city")).alias("city")).agg(F.count("*").alias("cells"))


@query("str3_blank_cells", on_messy("""
select k, order_id, trim(city) = '' as city_blank, trim(order_date) = '' as date_blank from messy
"""))
def blank_cells(spark, sf_dir):
    return messy(spark, sf_dir).select(
        "k", "order_id", text.is_blank(F.col("city")).alias("city_blank"), text.is_blank(F.col("order_date")).alias("date_blank")
    )


@query("str4_whole_phrase", f"""
select conv_id, turn, contains(concat(' ', {sql_normal('text')}, ' '), ' la ') as has_la,
  contains(concat(' ', {sql_normal('text')}, ' '), ' de la ') as has_de_la from conversations
""")
def whole_phrase(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.padded(F.col("text")).alias("p"))
    return df.select("conv_id", "turn", text.has_phrase(F.col("p"), "la").alias("has_la"), text.has_phrase(F.col("p"), "de la").alias("has_de_la"))


@query("str5_known_labels", on_messy(f"""
select city, case {sql_normal('city')} when 'casa' then 'Casablanca' when 'casblanca' then 'Casablanca'
  when 'marrakesh' then 'Marrakech' when 'fes' then 'Fès' end as known, count(*) as cells from messy group by 1, 2
"""))
def known_labels(spark, sf_dir):
    labels = vocabulary.KNOWN_LABELS[roles.label_role("city")]
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    known = F.try_element_at(lookup, text.normalize_text(F.col("city")))
    return messy(spark, sf_dir).groupBy("city", known.alias("known")).agg(F.count("*").alias("cells"))


RISKY = r"^\s*[=+\-@]"
SIGNED = r"[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?"


@query("str6_safe_spreadsheet_text", on_messy(f"""
with cells as (select order_id, unnest([concat('=', product), concat('-', amount), concat('  @', city), quantity, concat('+', rating)]) as cell from messy)
select order_id, cell, case when regexp_matches(cell, '{RISKY}') and not regexp_full_match(replace(ltrim(cell), ' ', ''), '{SIGNED}')
  then concat('''', cell) else cell end as safe from cells
"""))
def safe_cells(spark, sf_dir):
    cells = F.array(
        F.concat(F.lit("="), "product"), F.concat(F.lit("-"), "amount"), F.concat(F.lit("  @"), "city"), F.col("quantity"),
        F.concat(F.lit("+"), "rating"),
    )
    df = messy(spark, sf_dir).select("order_id", F.explode(cells).alias("cell"))
    return df.select("order_id", "cell", text.safe_spreadsheet_text(F.col("cell")).alias("safe"))


@query("str7_similarity_ratio")
def similarity(spark, sf_dir):
    from grainmill.functions.similarity import similar_pairs

    names = table(spark, sf_dir, "part").select(text.normalize_text(F.col("p_name")).alias("key")).distinct()
    return similar_pairs(names, names, 0.6)


def _letters(table) -> str:
    pairs = ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items())
    return f"map {{{pairs}}}"


def _mapped(parts: str, table) -> str:
    return f"array_to_string(list_transform({parts}, lambda p: coalesce({_letters(table)}[p], p)), '')"


def _arabic(cell: str) -> str:
    """SQL for Latin text in Arabic letters: pairs first, a lone final e is silent."""
    parts = f"regexp_extract_all(replace({sql_normal(cell)}, ' ', ''), '{'|'.join(vocabulary.LATIN_PAIRS_TO_ARABIC)}|.')"
    spoken = f"list_slice({parts}, 1, len({parts}) - (case when {parts}[-1] = 'e' then 1 else 0 end))"
    return _mapped(spoken, {**vocabulary.LATIN_PAIRS_TO_ARABIC, **vocabulary.LATIN_TO_ARABIC})


@query("str8_arabic_to_latin", f"""
with a as (select conv_id, turn, strip_accents({_arabic('text')}) as arabic from conversations)
select conv_id, turn, {_mapped("regexp_extract_all(arabic, '.')", vocabulary.ARABIC_TO_LATIN)} as latin from a
""")
def arabic_to_latin(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.latin_to_arabic(F.col("text")).alias("arabic"))
    return df.select("conv_id", "turn", text.arabic_to_latin(F.col("arabic")).alias("latin"))


@query("str9_latin_to_arabic", f"""
with w as (select distinct unnest(list_filter(string_split_regex(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as word from conversations)
select word, {_arabic('word')} as arabic from w
""")
def latin_to_arabic(spark, sf_dir):
    words = F.explode(text.split_identifier(F.col("text")))
    df = table(spark, sf_dir, "conversations").select(words.alias("word")).distinct()
    return df.select("word", text.latin_to_arabic(F.col("word")).alias("arabic"))


@query("str10_split_identifier", """
select p_partkey, len(parts) as pieces, array_to_string(parts, '|') as joined from (
  select p_partkey, list_filter(string_split_regex(regexp_replace(concat('p', p_name, p_brand, '_', p_type), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
    '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as parts from part)
""")
def split_identifier(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("parts", text.split_identifier(F.concat(F.lit("p"), "p_name", "p_brand", F.lit("_"), "p_type")))
    return df.select("p_partkey", F.size("parts").cast("bigint").alias("pieces"), F.array_join("parts", "|").alias("joined"))


@query("str11_clean_label", """
select conv_id, turn, substring(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]+', ' ', 'g')), 1, 100) as label from conversations
""")
def clean_label(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_label(F.col("text")).alias("label"))


@query("str12_sensitive_words", f"""
select conv_id, turn, regexp_matches({sql_normal('text')}, '{vocabulary.SENSITIVE_NAME}') as sensitive from conversations
""")
def sensitive_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_sensitive(F.col("text")).alias("sensitive"))


# -- numbers -----------------------------------------------------------------------------------------


@query("num1_local_number", on_messy(f"""
select order_id, k, {sql_number('amount')} as amount, {sql_number('unit_price')} as unit_price, {sql_number('quantity')} as quantity from messy
"""))
def local_number(spark, sf_dir):
    parse = lambda c: numbers.parse_local_number(F.col(c)).alias(c)
    return messy(spark, sf_dir).select("order_id", "k", parse("amount"), parse("unit_price"), parse("quantity"))


@query("num2_plain_number", on_messy(f"""
select order_id, k, amount, regexp_full_match(replace(trim(amount), ' ', ''), '{SIGNED}') as plain from messy
"""))
def plain_number(spark, sf_dir):
    return messy(spark, sf_dir).select("order_id", "k", "amount", numbers.is_plain_number(F.col("amount")).alias("plain"))


@query("num3_strict_amount", on_messy("""
with c as (select order_id, k, amount, replace(regexp_replace(amount, '\\s', '', 'g'), ',', '.') as t from messy)
select order_id, k, amount, case when regexp_full_match(t, '\\d+(\\.\\d{1,2})?') and try_cast(t as double) > 0 and try_cast(t as double) <= 100000000
  then try_cast(t as double) end as value from c
"""))
def strict_amount(spark, sf_dir):
    return messy(spark, sf_dir).select("order_id", "k", "amount", numbers.parse_strict_amount(F.col("amount")).alias("value"))


@query("num4_invoice_amount", on_sales("""
with c as (select k, unnest([cast(amount as varchar), replace(cast(amount as varchar), '.', ','),
    concat(cast(cast(floor(amount / 1000) as bigint) as varchar), '.', lpad(cast(cast(floor(amount) as bigint) % 1000 as varchar), 3, '0'), ',50'),
    concat(cast(cast(floor(amount / 1000) as bigint) as varchar), ',', lpad(cast(cast(floor(amount) as bigint) % 1000 as varchar), 3, '0'))]) as cell,
  unnest([cast(amount as double), cast(amount as double), cast(floor(amount) as double) + 0.5, cast(floor(amount) as double)]) as value from sales)
select k, cell, value from c
"""))
def invoice_amount(spark, sf_dir):
    whole = F.floor("amount")
    thousands, rest = F.floor(F.col("amount") / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    cells = F.array(
        F.col("amount").cast("string"), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(",")),
        F.concat(thousands, F.lit("."), rest, F.lit(",50")), F.concat(thousands, F.lit(","), rest),
    )
    df = sales(spark, sf_dir).select("k", F.explode(cells).alias("cell"))
    return df.select("k", "cell", numbers.parse_invoice_amount(F.col("cell")).alias("value"))


@query("num5_optional_number", on_messy(f"""
with c as (select k, order_id, unit_price, amount, regexp_replace(replace(trim(amount), ' ', ''), ',', '.') as a from messy)
select k, order_id, try_cast(replace(unit_price, ',', '.') as double) as price,
  case when regexp_full_match(a, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') then try_cast(a as double) end as amount_value,
  not regexp_full_match(a, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)') as bad from c
"""))
def optional_number(spark, sf_dir):
    return messy(spark, sf_dir).select(
        "k", "order_id", numbers.parse_optional_number(F.col("unit_price")).alias("price"),
        numbers.parse_optional_number(F.col("amount")).alias("amount_value"), numbers.is_bad_optional_number(F.col("amount")).alias("bad"),
    )


@query("num6_display_number", """
select l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * (1 - l_discount), 2) as shown from lineitem
""")
def display_number(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.display_number(net).alias("shown"))


@query("num7_result_value", """
select o_orderkey, o_orderstatus, round_even(o_totalprice / 7, 4) as share, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate from orders
""")
def result_value(spark, sf_dir):
    from grainmill.plans.console import displayed

    return displayed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 7).alias("share"), "o_orderdate"))


@query("mth1_math", """
select l_orderkey, l_linenumber, l_partkey, abs(l_quantity - 25) as distance, l_orderkey % 7 as remainder,
  greatest(least(l_quantity, 40), 10) as clamped, greatest(l_discount - 0.05, 0) as clipped, floor(sqrt(l_quantity)) as root from lineitem
""")
def math_functions(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(q - 25).alias("distance"), (F.col("l_orderkey") % 7).alias("remainder"),
        F.greatest(F.least(q, F.lit(40.0)), F.lit(10.0)).alias("clamped"), F.greatest(d - 0.05, F.lit(0.0)).alias("clipped"),
        F.floor(F.sqrt(q)).cast("double").alias("root"),
    )


# -- dates ---------------------------------------------------------------------------------------------


@query("dat1_local_date", on_messy(f"select k, order_id, order_date as cell, {sql_date('order_date')} as parsed from messy"))
def local_date(spark, sf_dir):
    return messy(spark, sf_dir).select("k", "order_id", F.col("order_date").alias("cell"), dates.parse_local_date(F.col("order_date")).alias("parsed"))


@query("dat1_date_shapes", """
select o_orderkey, shape, cast(o_orderdate as date) as parsed from orders, (select unnest(['iso', 'slash', 'dash', 'dot', 'slash_iso', 'clock', 'words']) as shape)
""")
def date_shapes(spark, sf_dir):
    written = {
        "iso": "yyyy-MM-dd", "slash": "dd/MM/yyyy", "dash": "d-M-yyyy", "dot": "d.M.yyyy", "slash_iso": "yyyy/MM/dd",
        "clock": "yyyy-MM-dd'T'HH:mm:ss", "words": "d MMMM yyyy",
    }
    cells = F.array(*[F.struct(F.lit(n).alias("shape"), F.date_format("o_orderdate", p).alias("cell")) for n, p in written.items()])
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(cells))
    return df.select("o_orderkey", "shape", dates.parse_local_date(F.col("cell")).cast("date").alias("parsed"))


@query("dat2_invoice_date", """
select o_orderkey, shape, strftime(o_orderdate, '%Y-%m-%d') as value, confidence from orders,
  (select unnest(['iso', 'day_first', 'words']) as shape, unnest([0.98, 0.90, 0.95])::double as confidence)
""")
def invoice_date(spark, sf_dir):
    # French month names as printed.
    months = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
    d = F.col("o_orderdate")
    named = F.concat_ws(" ", F.dayofmonth(d), F.element_at(F.array(*[F.lit(m) for m in months]), F.month(d)), F.year(d))
    written = {"iso": F.date_format(d, "yyyy-MM-dd"), "day_first": F.date_format(d, "dd/MM/yyyy"), "words": named}
    cells = F.array(*[F.struct(F.lit(n).alias("shape"), c.alias("cell")) for n, c in written.items()])
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(cells))
    return df.select("o_orderkey", "shape", F.inline(F.array(dates.parse_invoice_date(F.col("cell")))))


@query("dat3_page_date", """
select o_orderkey, strftime(o_orderdate, '2026-%m-%d') as page_date from orders where strftime(o_orderdate, '%m-%d') <> '02-29'
union all select o_orderkey, '' from orders where strftime(o_orderdate, '%m-%d') = '02-29'
""")
def page_date(spark, sf_dir):
    head = F.concat(F.lit("Carnet\nVentes du "), F.date_format("o_orderdate", "dd/MM"), F.lit("\nPain 12,50"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.split(head, "\n").alias("lines"))
    return df.select("o_orderkey", dates.page_date(F.col("lines"), 2026).alias("page_date"))


@query("dat4_date_columns", "select unnest(['order_date']) as column_name")
def date_columns(spark, sf_dir):
    found = cleaning.date_columns(dirty(spark, sf_dir))
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query("dat5_restore_dates", on_messy(f"select order_id, city, amount, {sql_date('order_date')} as order_date from messy"))
def restore_dates(spark, sf_dir):
    return cleaning.restore_dates(dirty(spark, sf_dir)).select("order_id", "city", "amount", "order_date")


@query("dat6_time_buckets", on_sales("""
select date_trunc('month', order_date)::date as bucket, count(*) as cells from sales group by 1
"""))
def time_buckets(spark, sf_dir):
    df = sales(spark, sf_dir)
    unit = dates.time_unit(df, F.col("order_date"))
    return df.groupBy(dates.time_bucket(F.col("order_date"), unit).alias("bucket")).agg(F.count("*").alias("cells"))


@query("dat6_day_buckets", "select date_trunc('day', ts)::date as bucket, count(*) as cells from events group by 1")
def day_buckets(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    unit = dates.time_unit(df, F.col("ts"))
    return df.groupBy(dates.time_bucket(F.col("ts"), unit).alias("bucket")).agg(F.count("*").alias("cells"))


@query("bin1_histogram", """
with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi, least(8, greatest(4, cast(floor(sqrt(count(*))) as int))) n from lineitem),
c as (select least(cast(floor((l_extendedprice - lo) * n / (hi - lo)) as int) + 1, n) as bin, count(*) as cells from lineitem, e group by 1),
axis as (select unnest(range(1, n + 1))::int as bin, lo, hi, n from e)
select bin, lo + (hi - lo) / n * (bin - 1) as low, lo + (hi - lo) / n * bin as high, coalesce(cells, 0) as "rows" from axis left join c using (bin)
""")
def histogram(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("bin2_cut_bins", """
with e as (select min(c_acctbal) lo, max(c_acctbal) hi from customer),
c as (select greatest(1, least(10, cast(ceil((c_acctbal - lo) / ((hi - lo) / 10)) as int))) as bin, count(*) as cells from customer, e group by 1)
select bin, round_even(case when bin = 1 then lo - (hi - lo) * 0.001 else lo + (hi - lo) / 10 * (bin - 1) end, 3) as low,
  round_even(lo + (hi - lo) / 10 * bin, 3) as high, cells from c, e
""")
def cut_bins(spark, sf_dir):
    binned = charts.cut_bins(table(spark, sf_dir, "customer"), "c_acctbal")
    return binned.groupBy("bin", "low", "high").agg(F.count("*").alias("cells"))
