"""Profiles, contract inference and checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from grainmill.operators import charts, cleaning, contract, profile, relabel, roles
from grainmill.operators.harmonise import label_variants
from workload.base import dirty, messy, on_messy, on_sales, query, sales, sql_date, sql_label_map, sql_normal, sql_number, table

AS_OF = dt.date(2026, 1, 1)
DIRTY = ["order_id", "order_date", "city", "product", "category", "channel", "status", "quantity", "unit_price", "amount", "rating"]
SALES = [
    ("order_id", "texte"), ("order_date", "date"), ("city", "texte"), ("product", "texte"), ("category", "texte"), ("country", "texte"),
    ("channel", "texte"), ("status", "texte"), ("quantity", "nombre"), ("unit_price", "nombre"), ("amount", "nombre"), ("discount", "nombre"),
    ("rating", "nombre"), ("k", "nombre"),
]
# The same cells with blanks as missing values.
HOLED = "holed as (select " + ", ".join(f"case when trim({c}) <> '' then {c} end as {c}" for c in DIRTY) + " from dirty)"


def holed(spark, sf_dir):
    return cleaning.normalize_blanks(dirty(spark, sf_dir))


def _distinct_rows(name: str) -> str:
    return f"(select count(*) from {name}) - (select count(*) from (select distinct * from {name}))"


def _sum(parts) -> str:
    return " + ".join(parts)


@query("pro1_table_profile", on_messy(f"""
with f as (select count(*) as n, {_sum(f"count(*) filter ({c} is null)" for c in DIRTY)} as missing,
  {_sum(f"count(*) filter (trim({c}) = '')" for c in DIRTY)} as blank, {_distinct_rows('dirty')} as duplicates,
  {_sum(f"(count(distinct {c}) <= 1)::bigint" for c in DIRTY)} as constant_columns from dirty)
select n as "rows", {len(DIRTY)} as columns_count, missing::bigint as missing, blank::bigint as blank, duplicates, constant_columns::bigint as constant_columns,
  cast(greatest(0, round_even(100 - ((missing + blank) / (n * {len(DIRTY)}) * 45 + duplicates / n * 30 + constant_columns / {len(DIRTY)} * 10), 0)) as int) as quality_score
from f
"""))
def table_profile(spark, sf_dir):
    return profile.table_profile(dirty(spark, sf_dir))


@query("pro2_column_profile", on_messy(f"with {HOLED} " + " union all ".join(
    f"select {i} as position, '{c}' as column_name, 'texte' as kind, count(*) filter ({c} is null) as missing, "
    f"round_even(count(*) filter ({c} is null) * 100.0 / count(*), 1) as missing_pct, count(*) filter (trim({c}) = '') as blank, "
    f"count(distinct {c}) as distinct_values from holed" for i, c in enumerate(DIRTY))))
def column_profile(spark, sf_dir):
    return profile.column_profile(holed(spark, sf_dir))


@query("pro2_column_examples", """
select column_name, ord, example from (
  select 'o_custkey' as column_name, row_number() over (order by o_orderkey) as ord, o_custkey::varchar as example from orders
  union all select 'o_orderstatus', row_number() over (order by o_orderkey), o_orderstatus from orders
  union all select 'o_orderpriority', row_number() over (order by o_orderkey), o_orderpriority from orders) where ord <= 3
""")
def column_examples(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return profile.column_examples(orders, ["o_orderkey"])


@query("pro3_quality_score", on_messy(f"""
with {HOLED}, f as (select count(*) as n, {_sum(f"count(*) filter ({c} is null)" for c in DIRTY)} as missing, {_distinct_rows('holed')} as duplicates from holed)
select cast(greatest(0, round_even(100 - (missing / (n * {len(DIRTY)}) * 45 + duplicates / n * 30), 0)) as int) as quality_score from f
"""))
def quality_score(spark, sf_dir):
    return profile.table_profile(holed(spark, sf_dir)).select("quality_score")


@query("pro4_gold_column_profile", on_sales(" union all ".join(
    f"select '{c}' as column_name, '{kind}' as data_type, count({c}) as non_null, round_even(count({c}) * 100.0 / count(*), 1) as completeness_pct, "
    f"count(distinct {c}) as distinct_values from sales" for c, kind in SALES)))
def gold_column_profile(spark, sf_dir):
    return profile.gold_column_profile(sales(spark, sf_dir))


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pro5_numeric_summary", " union all ".join(
    f"select '{c}' as column_name, count({c}) as count, round_even(avg({c}), 4) as mean, round_even(median({c}), 4) as median, "
    f"round_even(min({c})::double, 4) as minimum, round_even(max({c})::double, 4) as maximum, round_even(stddev_samp({c}), 4) as standard_deviation from lineitem"
    for c in NUMERIC))
def numeric_summary(spark, sf_dir):
    return profile.numeric_summary(table(spark, sf_dir, "lineitem"))


@query("pro5_value_distributions", on_sales(" union all ".join(
    f"select '{c}' as column_name, value, count from (select cast({c} as varchar) as value, count(*) as count, "
    f"row_number() over (order by count(*) desc, cast({c} as varchar)) as r from sales group by {c}) where r <= 10"
    for c in ("city", "category", "channel", "status", "discount", "rating"))))
def value_distributions(spark, sf_dir):
    return profile.value_distributions(sales(spark, sf_dir))


def _pairs(names, source):
    return " union all ".join(
        f"select '{a}' as \"left\", '{b}' as \"right\", round_even(corr({a}, {b}), 3) as value from {source}"
        for i, a in enumerate(names) for b in names[i + 1:])


@query("pro6_correlations", f"""
select * from ({_pairs(NUMERIC, 'lineitem')}) where value is not null order by abs(value) desc, "left", "right" limit 5
""")
def correlations(spark, sf_dir):
    return profile.correlations(table(spark, sf_dir, "lineitem"))


@query("pro7_missing_ranking", on_messy(f"with {HOLED} select * from (" + " union all ".join(
    f"select '{c}' as column_name, count(*) filter ({c} is null) as missing from holed" for c in DIRTY)
    + ") where missing > 0 order by missing desc, column_name limit 5"))
def missing_ranking(spark, sf_dir):
    return profile.missing_ranking(holed(spark, sf_dir))


@query("pro8_table_summary", on_sales("""
with f as (select count(*) - (select count(*) from (select distinct * from sales)) as d, count(*) as n from sales),
n as (select avg(quantity)::double a, min(quantity)::double b, max(quantity)::double c, avg(unit_price)::double d, min(unit_price)::double e, max(unit_price)::double f from sales),
t as (select city, count(*) as c from sales group by 1 order by 2 desc, 1 limit 1)
select 'table' as item, 'quality_score' as measure, cast(cast(greatest(0, round_even(100 - d / n * 30, 0)) as int) as varchar) as value from f
union all select 'table', 'missing_or_blank', '0' union all select 'table', 'duplicates', d::varchar from f
union all select 'quantity', 'mean', printf('%.2f', a) from n union all select 'quantity', 'min', printf('%.2f', b) from n union all select 'quantity', 'max', printf('%.2f', c) from n
union all select 'unit_price', 'mean', printf('%.2f', d) from n union all select 'unit_price', 'min', printf('%.2f', e) from n union all select 'unit_price', 'max', printf('%.2f', f) from n
union all select 'city', city, c::varchar from t
"""))
def table_summary(spark, sf_dir):
    return profile.table_summary(sales(spark, sf_dir))


@query("pro9_structural_problems", on_messy(f"""
select * from (select 'empty_cells' as problem, '' as column_name, ({_sum(f"count(*) filter (trim({c}) = '' or {c} is null)" for c in DIRTY)})::bigint as count from dirty
union all select 'duplicate_rows', '', {_distinct_rows('dirty')}) where count > 0
"""))
def structural_problems(spark, sf_dir):
    return profile.structural_problems(dirty(spark, sf_dir))


# -- contract and checks -----------------------------------------------------------------------------------

CONTRACT = """
select * from (values
  ('order_id', 'text', true, true, cast(null as double), cast(null as double), false), ('order_date', 'date', true, false, null, null, false),
  ('city', 'text', false, false, null, null, true), ('product', 'text', false, false, null, null, (select count(distinct product) between 2 and 30 from sales)),
  ('category', 'text', false, false, null, null, true), ('country', 'text', false, false, null, null, (select count(distinct country) between 2 and 30 from sales)),
  ('channel', 'text', false, false, null, null, true), ('status', 'text', false, false, null, null, true),
  ('quantity', 'integer', false, false, 0, null, false), ('unit_price', 'decimal', true, false, 0, null, false), ('amount', 'decimal', true, false, null, null, false),
  ('discount', 'decimal', true, false, null, null, false),
  ('rating', 'decimal', false, false, 0, (select case when avg((rating <= 5)::int) >= 0.8 then 5 when avg((rating <= 10)::int) >= 0.8 then 10 end from sales), false),
  ('k', 'decimal', false, false, null, null, false)) t(name, type, required, "unique", min, max, categorical)
"""


@query("con1_infer_contract", on_sales(CONTRACT))
def infer_contract(spark, sf_dir):
    return contract.contract_frame(spark, contract.infer_contract(sales(spark, sf_dir)))


@query("con2_rating_scale", on_messy(f"""
with v as (select {sql_number('rating')} as r from messy)
select case when avg((r <= 5)::int) >= 0.8 then 5.0 when avg((r <= 10)::int) >= 0.8 then 10.0 end::double as scale from v where r is not null
"""))
def rating_scale(spark, sf_dir):
    from grainmill.functions.numbers import parse_local_number

    return messy(spark, sf_dir).agg(contract.rating_scale(parse_local_number(F.col("rating"))).alias("scale"))


def _rules(spark, sf_dir):
    return [r for r in contract.infer_contract(sales(spark, sf_dir)) if r.name in DIRTY]


def _checks(spark, sf_dir):
    return contract.run_checks(dirty(spark, sf_dir), _rules(spark, sf_dir), AS_OF)


def _check(name, column, rule, label, failing, total, detail, warn=0.0, severity="error", source="dirty"):
    shown = f"'{column}'" if column else "cast(null as varchar)"
    return f"""select '{name}' as id, {shown} as "column", '{rule}' as rule, '{label}' as label, f as failing_rows, t as total_rows,
  round_even((1 - f / nullif(t, 0)) * 100, 1) as pass_rate,
  case when f = 0 then 'pass' when '{severity}' = 'warning' or f / greatest(t, 1) <= {warn} then 'warn' else 'fail' end as status, {detail} as detail
from (select ({failing})::bigint as f, ({total})::bigint as t, * from (select 1) from_nothing)"""


def _count(condition: str) -> str:
    return f"select count(*) from dirty where {condition}"


def _populated(c: str) -> str:
    return f"trim({c}) <> ''"


def _missing(c):
    return _check(f"{c}.not_null", c, "not_null", "value required", _count(f"{c} is null or trim({c}) = ''"), "select count(*) from dirty", "concat(f, ' empty cell(s)')", 0.02)


def _numeric(c):
    return _check(f"{c}.type", c, "numeric", "number format", _count(f"{_populated(c)} and {sql_number(c)} is null"), _count(_populated(c)), "concat(f, ' unreadable number(s)')")


def _low(c):
    return _check(f"{c}.min", c, "min", "value >= 0", _count(f"{sql_number(c)} < 0"), _count(f"{sql_number(c)} is not null"), "concat(f, ' value(s) too low')")


def _high(c):
    return _check(f"{c}.max", c, "max", "value <= 5", _count(f"{sql_number(c)} > 5"), _count(f"{sql_number(c)} is not null"), "concat(f, ' value(s) off scale')")


DUPLICATES = _check("table.no_duplicates", None, "unique_rows", "no duplicate row", f"select {_distinct_rows('dirty')}", "select count(*) from dirty", "concat(f, ' exact duplicate(s)')")
DATE_TYPE = _check("order_date.type", "order_date", "date", "date format", _count(f"{_populated('order_date')} and {sql_date('order_date')} is null"), _count(_populated("order_date")), "concat(f, ' unreadable date(s)')")
LATE, OLD = f"{sql_date('order_date')} > date '2026-01-02'", f"{sql_date('order_date')} < date '2000-01-01'"
DATE_RANGE = _check("order_date.range", "order_date", "date_range", "plausible date", _count(f"{LATE} or {OLD}"), _count(f"{sql_date('order_date')} is not null"),
                    f"concat(({_count(LATE)}), ' future date(s), ', ({_count(OLD)}), ' before 2000')", severity="warning")
UNIQUE = _check("order_id.unique", "order_id", "unique", "unique identifier", "select count(order_id) - count(distinct order_id) from dirty", _count(_populated("order_id")), "concat(f, ' repeated identifier(s)')")

def _consistent(c, rows="0", examples="''"):
    return _check(f"{c}.consistent", c, "consistent_labels", "consistent labels", rows, _count(_populated(c)), examples)


# Labels of the city column to rewrite, as the label map finds them.
VARIANTS = f"(select source, target, \"rows\" from ({sql_label_map('dirty')}))"
CITIES = _consistent("city", f"select coalesce(sum(\"rows\"), 0) from {VARIANTS}",
                     f"(select string_agg(source || ' → ' || target, ', ' order by \"rows\" desc, source) from (select * from {VARIANTS} order by \"rows\" desc, source limit 3))")
CHECKS = [
    CITIES, _consistent("category"), _consistent("channel"), _consistent("status"), DUPLICATES, _missing("order_id"), UNIQUE, _missing("order_date"), DATE_TYPE, DATE_RANGE, _numeric("quantity"), _low("quantity"),
    _missing("unit_price"), _numeric("unit_price"), _low("unit_price"), _missing("amount"), _numeric("amount"), _numeric("rating"), _low("rating"), _high("rating"),
]
ALL_CHECKS = on_messy(" union all ".join(f"select * from ({c})" for c in CHECKS))


def _single(key: str, check_id: str, sql: str) -> None:
    @query(key, on_messy(sql))
    def one_check(spark, sf_dir):
        # Only the column under test, so that one check costs one check.
        rule = [r for r in _rules(spark, sf_dir) if check_id.startswith(f"{r.name}.")]
        return contract.run_checks(dirty(spark, sf_dir), rule, AS_OF, labels=False).where(F.col("id") == check_id)


_single("chk1_no_duplicate_rows", "table.no_duplicates", DUPLICATES)
_single("chk3_required", "order_date.not_null", _missing("order_date"))
_single("chk4_number_format", "amount.type", _numeric("amount"))
_single("chk5_minimum", "quantity.min", _low("quantity"))
_single("chk6_maximum", "rating.max", _high("rating"))
_single("chk7_date_format", "order_date.type", DATE_TYPE)
_single("chk8_plausible_date", "order_date.range", DATE_RANGE)
_single("chk9_unique", "order_id.unique", UNIQUE)


@query("chk2_column_exists", """
select c || '.exists' as id, c as "column", 'exists' as rule, 'column present' as label, 1::bigint as failing_rows, 1::bigint as total_rows, 0.0::double as pass_rate, 'fail' as status, '' as detail
from (select unnest(['city', 'amount']) as c)
""")
def column_exists(spark, sf_dir):
    checks = contract.run_checks(dirty(spark, sf_dir).drop("city", "amount"), _rules(spark, sf_dir), AS_OF, labels=False)
    return checks.where("rule = 'exists'")


@query("chk10_consistent_labels", on_messy(f"""
select coalesce(sum("rows"), 0)::bigint as variant_rows, (select string_agg(source || ' → ' || target, ', ' order by "rows" desc, source) from (select * from {VARIANTS} order by "rows" desc, source limit 3)) as examples from {VARIANTS}
"""))
def consistent_labels(spark, sf_dir):
    return label_variants(dirty(spark, sf_dir), "city")


@query("chk11_all_checks", ALL_CHECKS)
def all_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query("chk12_check_summary", on_messy(f"""
with c as ({' union all '.join(f'select * from ({c})' for c in CHECKS)})
select count(*) as total, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'warn') as warnings, count(*) filter (status = 'fail') as failed,
  cast(round_even((count(*) filter (status = 'pass') + 0.5 * count(*) filter (status = 'warn')) / count(*) * 100, 0) as int) as score from c
"""))
def check_summary(spark, sf_dir):
    return contract.summarize_checks(_checks(spark, sf_dir))


AFTER = [c.replace("from dirty", "from cleaned") for c in CHECKS]


@query("chk13_before_and_after", on_messy(f"""
with cleaned as (select distinct * from dirty), b as ({' union all '.join(f'select * from ({c})' for c in CHECKS)}), s as ({' union all '.join(f'select * from ({c})' for c in AFTER)})
select s.id, b.status as bronze_status, b.failing_rows as bronze_failing, s.status as silver_status, s.failing_rows as silver_failing from s left join b using (id)
"""))
def before_and_after(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    bronze = dirty(spark, sf_dir)
    return contract.compare_checks(contract.run_checks(bronze, rules, AS_OF), contract.run_checks(bronze.dropDuplicates(), rules, AS_OF))


# -- column catalogues --------------------------------------------------------------------------------------


@query("prj14_semantic_manifest", on_sales("select * from (" + " union all ".join(
    f"select '{c}' as name, '{c.replace('_', '_')}' as normalized_name, '{kind}' as type, bool_or({c} is null) as nullable, count(*) as row_count from sales"
    for c, kind in SALES) + ")"))
def semantic_manifest(spark, sf_dir):
    return profile.semantic_manifest(sales(spark, sf_dir))


@query("prj15_chart_options", on_sales("""
with d as (select count(distinct order_id) as o, count(distinct product) as p, greatest(50, floor(count(*) * 0.10)) as cap from sales)
select name, kind, is_measure from (values ('order_date', 'date', false), ('city', 'category', false), ('category', 'category', false), ('country', 'category', false),
  ('channel', 'category', false), ('status', 'category', false), ('quantity', 'number', true), ('unit_price', 'number', true), ('amount', 'number', true),
  ('discount', 'number', true), ('rating', 'number', true), ('k', 'number', true)) t(name, kind, is_measure)
union all select 'order_id', 'category', false from d where o between 2 and cap union all select 'product', 'category', false from d where p between 2 and cap
"""))
def chart_options(spark, sf_dir):
    return charts.chart_options(sales(spark, sf_dir))
