"""Suggestions, fixes, harmonisation, sales repair and versions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from grainmill.operators import cleaning, harmonise, sales as sales_ops
from grainmill.plans import versions
from grainmill.sources.layers import Project
from workload.base import dirty, messy, on_messy, on_sales, query, sales, scratch, sql_date, sql_label_map, sql_number, table

DIRTY = ["order_id", "order_date", "city", "product", "category", "channel", "status", "quantity", "unit_price", "amount", "rating"]
DUPLICATES = "(select count(*) from dirty) - (select count(*) from (select distinct * from dirty))"


def _sum(template: str) -> str:
    return " + ".join(template.format(c=c) for c in DIRTY)


def _numeric_suggestions(columns):
    for c in columns:
        n = sql_number(c)
        yield f"select 'convert_numeric::{c}', (select count({n}) from dirty), 'conseille'"
        yield f"select 'fill_median::{c}', (select count(*) filter ({n} is null) from dirty), 'conseille'"


SUGGESTED = " union all ".join([
    f"select 'drop_duplicates' as id, {DUPLICATES} as impact, 'fort' as severity",
    f"select 'normalize_blanks', (select {_sum(chr(99) + 'ount(*) filter (trim({c}) = ' + chr(39) * 2 + ')')} from dirty), 'fort'",
    f"select 'strip_text', (select {_sum('count(*) filter ({c} <> trim({c}))')} from dirty), 'fort'",
    f"select 'convert_date::order_date', (select count({sql_date('order_date')}) from dirty), "
    f"(select case when count({sql_date('order_date')}) >= 0.98 * count(*) filter (trim(order_date) <> '') then 'fort' else 'conseille' end from dirty)",
    *_numeric_suggestions(["quantity", "unit_price", "amount", "rating"]),
])


SUGGESTED += f""" union all select 'harmonize_values::city', (select count(*) from dirty where city in (select source from ({sql_label_map('dirty')}))), 'fort'"""


@query("sug1_suggestions", on_messy(f"select * from ({SUGGESTED}) where impact > 0"))
def suggestions(spark, sf_dir):
    """All suggestions; their position is the order that the log of `fix0_log` shows."""
    return cleaning.suggest_cleaning(dirty(spark, sf_dir)).drop("position")


@query("sug1_with_labels")
def suggestions_with_labels(spark, sf_dir):
    """The same with their positions, which count the suggestions that were not made too."""
    return cleaning.suggest_cleaning(dirty(spark, sf_dir))


@query("sug2_convert_to_number", on_messy(f"select * from ({SUGGESTED}) where id like 'convert_numeric%' and impact > 0"))
def suggest_numbers(spark, sf_dir):
    return cleaning.suggest_cleaning(dirty(spark, sf_dir)).where("id like 'convert_numeric%'").drop("position")


@query("sug3_convert_to_date", on_messy(f"select * from ({SUGGESTED}) where id like 'convert_date%' and impact > 0"))
def suggest_dates(spark, sf_dir):
    return cleaning.suggest_cleaning(dirty(spark, sf_dir)).where("id like 'convert_date%'").drop("position")


@query("sug4_mode_fill", on_messy("""
select 'fill_mode::city' as id, count(*) as impact, 'conseille' as severity from dirty where trim(city) = ''
"""))
def suggest_mode(spark, sf_dir):
    df = cleaning.normalize_blanks(dirty(spark, sf_dir))
    return cleaning.suggest_cleaning(df).where("id like 'fill_mode%'").drop("position")


# -- fixes ----------------------------------------------------------------------------------------------------

CLEAN_TEXT = "trimmed as (select " + ", ".join(f"trim(case when trim({c}) <> '' then {c} end) as {c}" for c in DIRTY) + " from dirty)"
STRIPPED = f"""{CLEAN_TEXT}, map as ({sql_label_map('trimmed')}),
stripped as (select distinct {', '.join('coalesce(target, city) as city' if c == 'city' else c for c in DIRTY)} from trimmed left join map on source = city)"""
TYPED = f"""typed as (select order_id, {sql_date('order_date')} as order_date, city, product, category, channel, status,
  {sql_number('quantity')} as quantity, {sql_number('unit_price')} as unit_price, {sql_number('amount')} as amount, {sql_number('rating')} as rating from stripped)"""


@query("fix0_ordered_fixes", on_messy(f"""
with {STRIPPED}, {TYPED}, m as (select median(amount) as a from (select distinct * from typed)),
c as (select city from (select distinct * from typed) where city is not null group by 1 order by count(*) desc, 1 limit 1)
select distinct order_id, order_date, coalesce(city, (select city from c)) as city, product, category, channel, status, quantity, unit_price,
  coalesce(amount, (select a from m)) as amount, rating from typed
"""))
def ordered_fixes(spark, sf_dir):
    df = dirty(spark, sf_dir)
    actions = [
        "fill_mode::city", "fill_median::amount", "drop_duplicates", "convert_date::order_date", "convert_numeric::amount", "convert_numeric::quantity",
        "convert_numeric::unit_price", "convert_numeric::rating", "harmonize_values::city", "strip_text", "normalize_blanks",
    ]
    cleaned, _ = cleaning.apply_cleaning(df, actions, allowed=actions)
    return cleaned.distinct()


@query("fix0_log", on_messy(f"""
with f as (select count(*) as n, count(*) filter (trim(city) = '') + count(*) filter (trim(order_date) = '') as blanks from dirty),
s as (select count(*) as n, count(*) filter (city is null) + count(*) filter (order_date is null) as blanks from (
  select distinct {', '.join(f"trim(case when trim({c}) <> '' then {c} end) as {c}" for c in DIRTY)} from dirty))
select 1 as step, 'normalize_blanks' as action, f.n as rows_before, f.n as rows_after, 0::bigint as missing_before, f.blanks as missing_after from f
union all select 2, 'strip_text', f.n, f.n, f.blanks, f.blanks from f
union all select 3, 'drop_duplicates', f.n, s.n, f.blanks, s.blanks from f, s
"""))
def fix_log(spark, sf_dir):
    actions = ["drop_duplicates", "strip_text", "normalize_blanks", "not_suggested"]
    _, log = cleaning.apply_cleaning(dirty(spark, sf_dir), actions, allowed=actions[:3])
    return log


@query("fix1_blanks", on_messy("select order_id, k, case when trim(city) <> '' then city end as city, case when trim(order_date) <> '' then order_date end as order_date from messy"))
def fix_blanks(spark, sf_dir):
    return cleaning.normalize_blanks(messy(spark, sf_dir)).select("order_id", "k", "city", "order_date")


@query("fix2_strip", on_messy("select order_id, k, trim(city) as city from messy"))
def fix_strip(spark, sf_dir):
    return cleaning.strip_text(messy(spark, sf_dir)).select("order_id", "k", "city")


@query("fix3_drop_duplicates", """
select l_suppkey, l_returnflag, l_linestatus, l_tax, min(l_orderkey * 8 + l_linenumber) as row_number from lineitem group by 1, 2, 3, 4
""")
def fix_duplicates(spark, sf_dir):
    numbered = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_number")
    )
    return cleaning.drop_duplicates(numbered, "row_number")


@query("fix4_numbers", on_messy(f"select order_id, k, {sql_number('amount')} as amount from messy"))
def fix_numbers(spark, sf_dir):
    return cleaning.convert_numeric(messy(spark, sf_dir), ["amount"]).select("order_id", "k", "amount")


@query("fix5_dates", on_messy(f"select order_id, k, {sql_date('order_date')} as order_date from messy"))
def fix_dates(spark, sf_dir):
    return cleaning.convert_date(messy(spark, sf_dir), ["order_date"]).select("order_id", "k", "order_date")


@query("fix6_fill_median", on_messy(f"""
with v as (select order_id, k, {sql_number('amount')} as amount from messy)
select order_id, k, coalesce(amount, (select median(amount) from v)) as amount from v
"""))
def fill_median(spark, sf_dir):
    df = cleaning.convert_numeric(messy(spark, sf_dir), ["amount"]).select("order_id", "k", "amount")
    return cleaning.fill_median(df, ["amount"])


@query("fix7_fill_mode", on_messy("""
with v as (select order_id, k, case when trim(city) <> '' then city end as city from messy)
select order_id, k, coalesce(city, (select city from v where city is not null group by 1 order by count(*) desc, 1 limit 1)) as city from v
"""))
def fill_mode(spark, sf_dir):
    df = cleaning.normalize_blanks(messy(spark, sf_dir).select("order_id", "k", "city"))
    return cleaning.fill_mode(df, ["city"])


@query("fix8_harmonise")
def fix_harmonise(spark, sf_dir):
    df = cleaning.strip_text(dirty(spark, sf_dir))
    fixed = harmonise.harmonise(df, "city", harmonise.harmonisation_map(df, "city"))
    return fixed.groupBy("city").agg(F.count("*").alias("rows"))


@query("har1_label_map", on_messy(sql_label_map("dirty")))
def label_map(spark, sf_dir):
    return harmonise.harmonisation_map(dirty(spark, sf_dir), "city")


@query("har1_similar_labels")
def similar_labels(spark, sf_dir):
    """No known label applies to this column, so every merge comes from similarity."""
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("category"))
    return harmonise.harmonisation_map(names, "category")


@query("har2_label_variants")
def variants(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("label"))
    return harmonise.variant_map(names, "label")


# -- sales repair -----------------------------------------------------------------------------------------------

# Sales with contradictions, as text where a person would have typed it.
SOLD = """sold as (select order_id, k, status as statut,
  case when k % 17 = 0 then '0' when k % 19 = 0 then concat(quantity, ' unités') else cast(quantity as varchar) end as quantite,
  case when k % 23 = 0 then concat('-', unit_price) when k % 29 = 0 then concat(unit_price, ' MAD') else cast(unit_price as varchar) end as prix_unitaire,
  case when k % 31 = 0 then '5%' when k % 37 = 0 then '99999999' else cast(discount as varchar) end as remise,
  case when k % 41 = 0 then 'Gratuit' else '20' end as frais_livraison, case when k % 43 = 0 then '-1' else '15' end as cout_livraison,
  case when k % 47 = 0 then amount + 100 else amount end::decimal(18,2) as total_brut, (amount - discount + 20)::decimal(18,2) as chiffre_affaires_net,
  (quantity * 7)::decimal(18,2) as marge_brute, case when k % 53 = 0 then 9 when k % 59 = 0 then null else rating end as note from sales)"""


def sold(spark, sf_dir):
    k, when = F.col("k"), F.when
    text = lambda c: F.col(c).cast("string")
    return sales(spark, sf_dir).select(
        "order_id", "k", F.col("status").alias("statut"),
        when(k % 17 == 0, "0").when(k % 19 == 0, F.concat(text("quantity"), F.lit(" unités"))).otherwise(text("quantity")).alias("quantite"),
        when(k % 23 == 0, F.concat(F.lit("-"), text("unit_price"))).when(k % 29 == 0, F.concat(text("unit_price"), F.lit(" MAD"))).otherwise(text("unit_price")).alias("prix_unitaire"),
        when(k % 31 == 0, "5%").when(k % 37 == 0, "99999999").otherwise(text("discount")).alias("remise"),
        when(k % 41 == 0, "Gratuit").otherwise("20").alias("frais_livraison"), when(k % 43 == 0, "-1").otherwise("15").alias("cout_livraison"),
        when(k % 47 == 0, F.col("amount") + 100).otherwise(F.col("amount")).cast("decimal(18,2)").alias("total_brut"),
        (F.col("amount") - F.col("discount") + 20).cast("decimal(18,2)").alias("chiffre_affaires_net"),
        (F.col("quantity") * 7).cast("decimal(18,2)").alias("marge_brute"),
        when(k % 53 == 0, 9).when(k % 59 == 0, None).otherwise(F.col("rating")).alias("note"),
    )


# Sales measures as numbers; "3 unités" is not one, "Gratuit" is zero.
PARSED = """p as (select order_id, k, statut, remise, try_cast(quantite as double) as q, try_cast(regexp_replace(prix_unitaire, ' MAD$', '') as double) as u,
  total_brut::double as g, try_cast(replace(remise, '%', '') as double) as d, case when frais_livraison = 'Gratuit' then 0 else frais_livraison::double end as f,
  cout_livraison::double as c, chiffre_affaires_net::double as n, marge_brute::double as m, note::double as s, quantite, prix_unitaire, frais_livraison from sold)"""


@query("sal1_inconsistent_rows", on_sales(f"""
with {SOLD}, {PARSED}
select order_id, k from p where coalesce(q <= 0, false) or coalesce(u < 0, false) or coalesce(abs(q * u - g) > 0.01, false) or coalesce(d < 0, false) or coalesce(d > g, false)
  or c < 0 or coalesce(s < 1 or s > 5, false) or not regexp_full_match(quantite, '[+-]?\\d+([.]\\d*)?') or not regexp_full_match(prix_unitaire, '[+-]?\\d+([.]\\d*)?')
  or remise like '%\\%' escape '\\' or frais_livraison = 'Gratuit'
"""))
def inconsistent_rows(spark, sf_dir):
    df = sold(spark, sf_dir)
    return df.where(sales_ops.sales_issue(df)).select("order_id", "k")


REPAIRED = f"""
with {SOLD}, {PARSED},
fb as (select (select median(q) from p where q > 0) as q, (select median(u) from p where u >= 0) as u, (select median(c) from p where c >= 0) as c,
  (select s from p where s between 1 and 5 and s % 1 = 0 group by 1 order by count(*) desc, 1 limit 1) as s),
r1 as (select p.*, case when p.q is null or p.q <= 0 then coalesce(case when g > 0 and p.u > 0 and abs(g / p.u - round_even(g / p.u, 0)) < 0.01 then round_even(g / p.u, 0) end, fb.q) else p.q end as q1,
  p.q is null or p.q <= 0 as x1 from p, fb),
r2 as (select r1.*, case when r1.u is null or r1.u < 0 then coalesce(case when g > 0 and q1 > 0 then round_even(g / q1, 2) end, fb.u) else r1.u end as u1, r1.u is null or r1.u < 0 as x2 from r1, fb),
r3 as (select *, round_even(q1 * u1, 2) as e from r2),
r4 as (select *, case when g is null or g < 0 or abs(g - e) > 0.01 then e else g end as g1, g is null or g < 0 or abs(g - e) > 0.01 as x3 from r3),
r5 as (select *, case when remise like '%\\%' escape '\\' then round_even(g1 * d / 100, 2) else d end as d0 from r4),
r6 as (select *, case when d0 between 0 and g1 then d0 else 0 end as d1 from r5),
r7 as (select r6.*, coalesce(d <> d1, true) as x4, case when r6.f is null or r6.f < 0 then 0 else r6.f end as f1, r6.f is null or r6.f < 0 as x5,
  case when r6.c is null or r6.c < 0 then fb.c else r6.c end as c1, r6.c is null or r6.c < 0 as x6, fb.s as fs from r6, fb),
r8 as (select *, case when statut = 'Annulée' then 0 else g1 - d1 + f1 end as due from r7),
r9 as (select *, statut in ('Annulée', 'Livrée') and (n is null or abs(n - due) > 0.01) as x7 from r8),
r10 as (select *, case when x7 then round_even(due, 2) else n end as n1 from r9),
r11 as (select *, x1 or x2 or x3 or x4 or x5 or x6 or x7 as x, s is null or s < 1 or s > 5 or s % 1 <> 0 as x8 from r10)
select order_id, k, q1 as quantite, u1 as prix_unitaire, d1 as remise, f1::double as frais_livraison, c1 as cout_livraison, g1 as total_brut, n1 as chiffre_affaires_net,
  coalesce(case when x then round_even(n1 - (n - m - c) - c1, 2) end, m) as marge_brute, case when x8 then fs else s end as note, x or x8 as changed from r11
"""


@query("sal2_repair", on_sales(REPAIRED))
def repair(spark, sf_dir):
    return sales_ops.repair_sales(sold(spark, sf_dir), flag="changed").drop("statut")


@query("fix0_with_sales_repair", on_sales(REPAIRED.replace("select order_id, k, q1 as", "select order_id, k, statut, q1 as").replace("select order_id, k, statut", "select distinct order_id, k, statut").replace(", x or x8 as changed from r11", " from r11")))
def fixes_with_repair(spark, sf_dir):
    """Repair among the ordered steps: after the text steps, before duplicates go."""
    actions = ["drop_duplicates", "repair_sales_metrics", "strip_text", "normalize_blanks"]
    cleaned, _ = cleaning.apply_cleaning(sold(spark, sf_dir), actions, allowed=actions)
    return cleaned


# -- versions -----------------------------------------------------------------------------------------------------


def _versioned(spark, sf_dir):
    """A project whose Bronze is the dirty table, and that table."""
    project = Project(spark, scratch(spark, "versions"), "dirty")
    raw = project.save(dirty(spark, sf_dir).select("order_id", "city", "quantity", "amount"), "bronze")
    return project, raw


AS_OF = dt.date(2026, 1, 1)


@query("ver1_apply_batch", on_messy("""
select 'normalize_blanks' as action, count(*) as rows_before, count(*) as rows_after, 0::bigint as missing_before, count(*) filter (trim(city) = '') as missing_after from dirty
union all select 'strip_text', count(*), count(*), count(*) filter (trim(city) = ''), count(*) filter (trim(city) = '') from dirty
"""))
def apply_batch(spark, sf_dir):
    project, raw = _versioned(spark, sf_dir)
    versions.apply_batch(project, raw, ["strip_text", "normalize_blanks"], "first", AS_OF)
    return versions.cleaning_log(project).select("action", "rows_before", "rows_after", "missing_before", "missing_after")


@query("ver2_undo", on_messy("select city, count(*) as cells from dirty group by 1"))
def undo(spark, sf_dir):
    project, raw = _versioned(spark, sf_dir)
    versions.apply_batch(project, raw, ["strip_text"], "first", AS_OF)
    versions.undo(project, raw, AS_OF)
    return versions.current(project, raw).groupBy("city").agg(F.count("*").alias("cells"))


@query("ver3_reset", on_messy("select count(*) as cells, count(distinct city) as cities from dirty"))
def reset(spark, sf_dir):
    project, raw = _versioned(spark, sf_dir)
    versions.apply_batch(project, raw, ["strip_text"], "first", AS_OF)
    versions.reset(project, raw, AS_OF)
    return project.read("silver").agg(F.count("*").alias("cells"), F.count_distinct("city").alias("cities"))


@query("ver4_recipe", on_messy("select trim(city) as city, count(*) as cells from dirty where city <> '' group by 1"))
def recipe(spark, sf_dir):
    project, raw = _versioned(spark, sf_dir)
    versions.apply_batch(project, raw, ["strip_text"], "first", AS_OF)
    versions.save_recipe(project, "trim")
    actions = versions.recipes(project).first()["actions"]
    other = Project(spark, scratch(spark, "recipe"), "other")
    again = other.save(raw, "bronze")
    versions.apply_recipe(other, again, actions, "trim", AS_OF)
    return versions.current(other, again).groupBy("city").agg(F.count("*").alias("cells"))
