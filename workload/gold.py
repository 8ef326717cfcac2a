"""Gold tables, frequencies, charts, KPIs, spikes and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators import charts, gold, metrics, profile
from workload.base import dirty, messy, on_messy, on_sales, query, sales, sql_number, table

BY_PRODUCT = """
with g as (select coalesce(nullif(trim(product), ''), 'Non renseigné') product, cast(sum(amount) as double) s, count(*) transactions
           from sales where amount is not null group by 1)
select product, round_even(s, 2) total, transactions, round_even(s / transactions, 2) average,
  round_even(greatest(s, 0) / coalesce(nullif((select sum(greatest(s, 0)) from g), 0), 1) * 100, 1) share_pct from g
"""


@query("agg1_gold_by_dimension", on_sales(BY_PRODUCT))
def gold_by_dimension(spark, sf_dir):
    return gold.total_by_dimension(sales(spark, sf_dir), "amount", "product")


@query("agg1_gold_text_amount", on_messy(f"""
with v as (select coalesce(nullif(trim(city), ''), 'Non renseigné') city, {sql_number('amount')} a from messy),
g as (select city, sum(cast(a as decimal(18,2))) s, count(*) transactions from v where a is not null group by 1)
select city, round_even(cast(s as double), 2) total, transactions, round_even(cast(s as double) / transactions, 2) average,
  round_even(cast(greatest(s, 0) as double) / (select sum(cast(greatest(s, 0) as double)) from g) * 100, 1) share_pct from g
"""))
def gold_text_amount(spark, sf_dir):
    return gold.total_by_dimension(messy(spark, sf_dir), "amount", "city")


@query("agg2_rows_by_dimension", on_messy("""
select coalesce(nullif(trim(city), ''), 'Non renseigné') city, count(*) as "rows" from messy group by 1
"""))
def rows_by_dimension(spark, sf_dir):
    return gold.rows_by_dimension(messy(spark, sf_dir), "city")


TREND = """
with m as (select strftime(order_date, '%Y-%m') as month, round_even(coalesce(cast(sum(amount) as double), 0), 2) total, count(*) transactions
           from sales where order_date is not null group by 1)
select month, total, transactions,
  round_even((total / nullif(lag(total) over (order by month), 0) - 1) * 100, 1) mom_change_pct from m
"""


@query("agg3_monthly_trend", on_sales(TREND))
def monthly_trend(spark, sf_dir):
    return gold.monthly_trend(sales(spark, sf_dir), "order_date", "amount")


@query("agg4_gold_tables", on_sales("""
with p as (select count(distinct product) as n from sales), m as (select count(distinct strftime(order_date, '%Y-%m')) as n from sales)
select 'gold_column_profile' as name, 14::bigint as "rows" union all select 'gold_amount_by_product', n from p union all select 'gold_monthly_trend', n from m
"""))
def gold_tables(spark, sf_dir):
    from grainmill.operators.relabel import union_all

    tables = gold.gold_tables(sales(spark, sf_dir))
    return union_all([df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()])


# -- frequencies and answers ------------------------------------------------------------------------------


@query("frq1_value_frequency", on_messy("""
select coalesce(city, 'Non renseigné') as label, count(*) as "rows" from messy group by 1 order by 2 desc, 1 limit 5
"""))
def value_frequency(spark, sf_dir):
    return profile.value_frequency(messy(spark, sf_dir), "city", 5)


@query("frq2_discrete_frequency", """
select l_quantity as value, count(*) as "rows" from lineitem group by 1 order by 2 desc, 1 limit 10
""")
def discrete_frequency(spark, sf_dir):
    return charts.discrete_frequency(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("frq3_date_activity", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as label, count(*) as "rows" from events group by 1 order by 1 desc limit 24
""")
def date_activity(spark, sf_dir):
    return charts.date_activity(table(spark, sf_dir, "events"), "ts")


@query("dst1_distinct_entities", "select count(distinct o_custkey) as distinct_values from orders")
def distinct_entities(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "client_id")
    return profile.distinct_entities(orders, profile.entity_column(orders.columns, "combien de clients ?"))


@query("dst2_scalar_answer", on_messy("""
with v as (select case when regexp_full_match(trim(amount), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') then cast(amount as decimal(18,2)) end a from messy)
select count(a) as used_values, round_even(cast(sum(a) as double) / count(a), 2) as mean, cast(sum(a) as double) as sum,
  cast(max(a) as double) as maximum, cast(min(a) as double) as minimum from v
"""))
def scalar_answer(spark, sf_dir):
    return profile.scalar_answer(messy(spark, sf_dir), "amount")


# -- charts --------------------------------------------------------------------------------------------------


def top_chart(table_name: str, dimension: str, value: str, rest: str) -> str:
    return f"""
with g as (select cast({dimension} as varchar) as label, cast({value} as double) as value from {table_name} where {dimension} is not null group by 1),
r as (select *, row_number() over (order by value desc, label) as ord from g)
select cast(ord as int) as ord, label, round_even(value, 2) as value from r where ord <= 12
union all select 13, 'Autres', round_even({rest}, 2) from r where ord > 12 having count(*) > 0
"""


@query("cht1_count_by_category", on_sales(top_chart("sales", "product", "count(*)", "sum(value)")))
def count_by_category(spark, sf_dir):
    return charts.grouped_chart(sales(spark, sf_dir), "product")


@query("cht1_sum_by_category", on_sales(top_chart("sales", "country", "sum(amount)", "sum(value)")))
def sum_by_category(spark, sf_dir):
    return charts.grouped_chart(sales(spark, sf_dir), "country", "amount", "sum")


@query("cht1_mean_by_category", on_sales("""
select cast(row_number() over (order by v desc, city) as int) as ord, city as label, round_even(v, 2) as value
from (select city, avg(cast(rating as double)) as v from sales group by 1)
"""))
def mean_by_category(spark, sf_dir):
    return charts.grouped_chart(sales(spark, sf_dir), "city", "rating", "mean")


@query("cht1_median_by_category", """
select cast(row_number() over (order by v desc, c_mktsegment) as int) as ord, c_mktsegment as label, round_even(v, 2) as value
from (select c_mktsegment, median(c_acctbal) as v from customer group by 1)
""")
def median_by_category(spark, sf_dir):
    return charts.grouped_chart(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "median")


@query("cht1_sum_by_month", """
with g as (select date_trunc('month', o_orderdate) as m, sum(cast(o_totalprice as decimal(18,2))) as v from orders group by 1 order by 1 desc limit 24)
select cast(row_number() over (order by m) as int) as ord, strftime(m, '%Y-%m') as label, round_even(cast(v as double), 2) as value from g
""")
def sum_by_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return charts.grouped_chart(orders, "o_orderdate", "o_totalprice", "sum")


@query("cht1_count_by_number_bins", """
with e as (select min(c_acctbal) lo, max(c_acctbal) hi from customer),
b as (select greatest(1, least(10, cast(ceil((c_acctbal - lo) / ((hi - lo) / 10)) as int))) as bin, lo, hi from customer, e),
g as (select concat('(', cast(round_even(case when bin = 1 then lo - (hi - lo) * 0.001 else lo + (hi - lo) / 10 * (bin - 1) end, 3) as varchar), ', ',
  cast(round_even(lo + (hi - lo) / 10 * bin, 3) as varchar), ']') as label, count(*)::double as value from b group by 1)
select cast(row_number() over (order by value desc, label) as int) as ord, label, value from g
""")
def count_by_number_bins(spark, sf_dir):
    return charts.grouped_chart(table(spark, sf_dir, "customer"), "c_acctbal")


def _bins(column: str) -> str:
    return f"""
select 'histogram:{column}' as chart, concat(printf('%.2f', round_even(lo + (hi - lo) / n * (bin - 1), 2)), '–', printf('%.2f', round_even(lo + (hi - lo) / n * bin, 2))) as label,
  coalesce(c, 0)::double as value, cast(bin as int) as ord
from (select min({column})::double lo, max({column})::double hi, 8 n from sales) e cross join (select unnest(range(1, 9)) as bin) a
left join (select least(cast(floor(({column}::double - (select min({column})::double from sales)) * 8
    / ((select max({column})::double from sales) - (select min({column})::double from sales))) as int) + 1, 8) as bin, count(*) c
  from sales group by 1) b using (bin)
"""


def _categories(column: str) -> str:
    return f"""
select 'categories:{column}' as chart, {column} as label, c::double as value, cast(ord as int) as ord
from (select {column}, count(*) c, row_number() over (order by count(*) desc, {column}) as ord from sales group by 1) where ord <= 10
"""


@query("cht2_dashboard", on_sales(f"""
select * from (select 'activity:order_date' as chart, strftime(m, '%Y-%m') as label, c::double as value, cast(row_number() over (order by m) as int) as ord
  from (select date_trunc('month', order_date) m, count(*) c from sales group by 1 order by 1 desc limit 24))
union all {_bins('quantity')} union all {_bins('unit_price')} union all {_bins('amount')}
union all {_categories('city')} union all {_categories('category')}
"""))
def dashboard(spark, sf_dir):
    return charts.dashboard(sales(spark, sf_dir))


@query("cht3_gold_charts", on_sales("""
with g as (select product, round_even(cast(sum(amount) as double), 2) t from sales group by 1),
m as (select strftime(order_date, '%Y-%m') mo, round_even(cast(sum(amount) as double), 2) t from sales group by 1)
select 'gold_amount_by_product' as chart, cast(ord as int) as ord, product as label, t as value
  from (select product, t, row_number() over (order by t desc, product) as ord from g) where ord <= 10
union all select 'gold_monthly_trend', cast(row_number() over (order by mo) as int), mo, t from m
"""))
def gold_charts(spark, sf_dir):
    return charts.gold_chart_points(gold.gold_tables(sales(spark, sf_dir)))


@query("cht4_explain_peak_bar", on_sales("""
with g as (select city as label, cast(sum(amount) as double) v from sales group by 1),
p as (select label, v from g order by v desc, label limit 1)
select label, round_even(v, 2) as value, round_even((v - (select avg(v) from g)) / abs((select avg(v) from g)) * 100, 1) as pct_vs_average,
  cast(null as double) as delta_vs_previous, round_even(v / (select sum(v) from g) * 100, 1) as share_of_positive_pct from p
"""))
def explain_peak_bar(spark, sf_dir):
    return charts.explain_peak(charts.grouped_chart(sales(spark, sf_dir), "city", "amount", "sum"))


@query("cht4_explain_peak_line", on_sales("""
with g as (select date_trunc('month', order_date) m, cast(sum(amount) as double) v from sales group by 1 order by 1 desc limit 24),
l as (select m, v, lag(v) over (order by m) as before from g), p as (select * from l order by v desc, m limit 1)
select strftime(m, '%Y-%m') as label, round_even(v, 2) as value, round_even((v - (select avg(v) from g)) / abs((select avg(v) from g)) * 100, 1) as pct_vs_average,
  round_even(v - before, 2) as delta_vs_previous,
  case when before is null then round_even(v / (select sum(v) from g) * 100, 1) end as share_of_positive_pct from p
"""))
def explain_peak_line(spark, sf_dir):
    return charts.explain_peak(charts.grouped_chart(sales(spark, sf_dir), "order_date", "amount", "sum"), line=True)


@query("cht5_saved_charts", on_sales(f"""
select 'a' as chart, * from ({top_chart('sales', 'city', 'count(*)', 'sum(value)')})
union all select 'b', * from ({top_chart('sales', 'product', 'sum(amount)', 'sum(value)')})
"""))
def saved_charts(spark, sf_dir):
    specs = [
        {"id": "a", "dimension": "city"}, {"id": "b", "dimension": "product", "measure": "amount", "aggregation": "sum"},
        {"id": "gone", "dimension": "not_a_column"},
    ]
    return charts.saved_charts(sales(spark, sf_dir), specs)


# -- KPIs, spikes, brief ----------------------------------------------------------------------------------------

KPI_SPECS = [
    {"id": "revenue", "measure": "amount", "aggregation": "sum", "target": 1_000_000_000, "direction": "higher"},
    {"id": "basket", "measure": "amount", "aggregation": "mean", "target": 30_000, "direction": "plus élevé"},
    {"id": "rating", "measure": "rating", "aggregation": "median", "target": 2.5, "direction": "moins"},
    {"id": "orders", "aggregation": "count", "measure": None},
    {"id": "lowest", "measure": "unit_price", "aggregation": "min", "target": 0, "direction": "higher"},
    {"id": "unknown", "measure": "not_a_column", "aggregation": "sum"},
]


def _kpi(spec: dict, value: str, used: str) -> str:
    target = spec.get("target")
    t = "cast(null as double)" if target is None else f"cast({target} as double)"
    direction = {"moins": "lower", "plus élevé": "higher"}.get(spec.get("direction", "higher"), spec.get("direction", "higher"))
    higher = direction == "higher"
    measure = f"'{spec['measure']}'" if spec["measure"] else "cast(null as varchar)"
    return f"""
select '{spec['id']}' as id, {measure} as measure, '{spec['aggregation']}' as aggregation, v as value, {t} as target, '{direction}' as direction,
  case when {t} is null then 'no_target' when v {'>=' if higher else '<='} {t} then 'target_reached' else 'needs_attention' end as status,
  round_even(v - {t}, 2) as difference_from_target, round_even(greatest({t + ' - v' if higher else 'v - ' + t}, 0 * {t}), 2) as gap_to_target,
  {'case when ' + t + ' > 0 then round_even(v / ' + t + ' * 100, 1) end' if higher else 'cast(null as double)'} as achievement_percent,
  {'case when ' + t + ' > 0 then least(greatest(round_even(v / ' + t + ' * 100, 1), 0), 100) end' if higher else 'cast(null as double)'} as progress,
  n as usable_values from (select round_even(cast({value} as double), 2) as v, {used} as n from sales)"""


@query("kpi1_single", on_sales(_kpi(KPI_SPECS[0], "sum(amount)", "count(amount)")))
def single_kpi(spark, sf_dir):
    return metrics.kpis(sales(spark, sf_dir), KPI_SPECS[:1])


@query("kpi2_saved_kpis", on_sales(" union all ".join([
    _kpi(KPI_SPECS[0], "sum(amount)", "count(amount)"), _kpi(KPI_SPECS[1], "cast(sum(amount) as double) / count(amount)", "count(amount)"),
    _kpi(KPI_SPECS[2], "median(rating)", "count(rating)"), _kpi(KPI_SPECS[3], "count(*)", "count(*)"),
    _kpi(KPI_SPECS[4], "min(unit_price)", "count(unit_price)"),
])))
def saved_kpis(spark, sf_dir):
    return metrics.kpis(sales(spark, sf_dir), KPI_SPECS)


SPIKE = """
with c as (select coalesce(country, 'Non renseigné') g, coalesce(channel, 'Non renseigné') c, cast({value} as double) v from sales group by 1, 2),
t as (select g, sum(v) t from c group by 1), f as (select g, t from t {focus}),
n as (select count(*) - 1.0 as others, sum(t) as everything from t),
k as (select c.c, sum(case when c.g = f.g then v else 0 end) as v, sum(case when c.g <> f.g then v else 0 end) / (select others from n) as u from c, f group by 1),
b as (select f.g, round_even(f.t, 2) as fv, round_even((n.everything - f.t) / n.others, 2) as fu from f, n)
select b.g as focus, fv as focus_value, fu as focus_usual_value, round_even(fv - fu, 2) as focus_difference,
  round_even(round_even(fv - fu, 2) / abs(fu) * 100, 1) as focus_difference_percent, k.c as category, round_even(v, 2) as value,
  round_even(u, 2) as usual_value, round_even(v - u, 2) as difference,
  case when round_even(v - u, 2) > 0 then 'hausse' when round_even(v - u, 2) < 0 then 'baisse' else 'stable' end as direction
from k, b order by v - u desc, k.c limit 5
"""


@query("ano1_explain_spike", on_sales(SPIKE.format(value="sum(amount)", focus="order by t desc, g limit 1")))
def explain_spike(spark, sf_dir):
    return metrics.explain_spike(sales(spark, sf_dir), "country", "channel", "amount")


@query("ano1_explain_given_group", on_sales(SPIKE.format(value="count(*)", focus="where lower(g) = 'nation_3'")))
def explain_given_group(spark, sf_dir):
    return metrics.explain_spike(sales(spark, sf_dir), "country", "channel", focus="Nation 3", aggregation="count")


@query("brf1_business_brief", on_messy(f"""
with v as (select {sql_number('amount')} as a, trim(product) as p from messy), c as (select cast(a as decimal(18,2)) a, p from v),
g as (select p, sum(a) s from c where a > 0 and p <> '' group by 1 order by 2 desc, 1 limit 1)
select true as available, 'Total observé' as total_label, 'montant' as amount_column, round_even(cast(sum(a) as double), 2) as total, count(a) as used_rows,
  count(*) filter (a is null) as excluded_rows, count(*) filter (a < 0) as negative_rows,
  (select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) as duplicate_rows,
  (select p from g) as leader, round_even(cast((select s from g) as double) / cast(sum(case when a > 0 then a end) as double) * 100, 1) as leader_share_pct,
  false as has_cost from c
"""))
def business_brief(spark, sf_dir):
    df = dirty(spark, sf_dir).withColumnRenamed("amount", "montant").withColumnRenamed("product", "produit")
    return metrics.business_brief(df)
