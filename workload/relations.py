"""Joins, the SQL console and one query per SQL family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from grainmill.operators import relabel, reshape, timeline
from grainmill.plans import console
from workload.base import messy, on_messy, on_sales, query, sales, sql_normal, table


@query("jn2_value_map_lookup", on_sales("""
select order_id, k, case city when 'Fès' then 'Fes' when 'Tanger' then 'Tangier' else city end as city from sales
"""))
def value_map_lookup(spark, sf_dir):
    labels = spark.createDataFrame([("Fès", "Fes"), ("Tanger", "Tangier")], "source string, target string")
    return relabel.relabelled(sales(spark, sf_dir).select("order_id", "k", "city"), "city", labels)


@query("jn3_semi_join_count", "select count(*) as \"rows\" from lineitem where l_partkey in (select p_partkey from part where p_size > 40)")
def semi_join_count(spark, sf_dir):
    large = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(large, "l_partkey", "left_semi").agg(F.count("*").alias("rows"))


@query("jn4_anti_join", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("jn6_dimension_by_category", """
with c as (select o_orderstatus s, o_orderpriority p, count(*) n from orders group by 1, 2),
k as (select count(distinct s) as groups from c)
select p as category, cast(sum(n) as bigint) as total, round_even(sum(n)::double / (select groups from k), 4) as mean_per_group from c group by 1
""")
def dimension_by_category(spark, sf_dir):
    """Mean over all groups, absent ones counting zero, without building the dense table."""
    cells = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"))
    groups = cells.agg(F.count_distinct("o_orderstatus")).scalar()
    from grainmill.functions.numbers import round_even

    totals = cells.groupBy("category").agg(F.sum("n").alias("total"))
    return totals.withColumn("mean_per_group", round_even(F.col("total") / groups, 4))


@query("jn7_scalar_lookup", """
select o_orderkey, o_totalprice > (select median(o_totalprice) from orders) as above_median from orders
""")
def scalar_lookup(spark, sf_dir):
    from grainmill.operators.counting import column_medians

    orders = table(spark, sf_dir, "orders")
    median = column_medians(orders, {"m": F.col("o_totalprice")})["m"]
    return orders.select("o_orderkey", (F.col("o_totalprice") > F.lit(median)).alias("above_median"))


# -- console --------------------------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    names = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "conversations"]
    return {n: table(spark, sf_dir, n) for n in names}


#: Statements and whether the gate lets them through. Those that pass count rows of a given table.
STATEMENTS = {
    "SELECT count(*) AS n FROM orders": True,
    "WITH a AS (SELECT * FROM orders WHERE o_custkey > 5) SELECT count(*) AS n FROM a;": True,
    "SELECT count(replace(n_name, 'N', 'M')) AS n FROM nation": True,
    "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> ';'": True,
    "DROP TABLE orders": False,
    "SELECT 1; SELECT 2": False,
    "SELECT * FROM parquet.`/tmp/x`": False,
    "INSERT INTO orders SELECT * FROM orders": False,
    "SELECT * FROM missing_table": False,
    "SELECT reflect('java.lang.System', 'getenv') FROM orders": False,
}


@query("sql1_read_only_gate", " union all ".join(
    "select '{0}' as statement, {1} as accepted, {2} as result_rows".format(text.replace("'", "''"), str(passes).lower(), f"(select n from ({text.rstrip(';')}))" if passes else "0::bigint")
    for text, passes in STATEMENTS.items()))
def read_only_gate(spark, sf_dir):
    """One union of the statements that pass, each its own aggregate over the given tables, and of the refused ones."""
    tables, parts = _tables(spark, sf_dir), []
    for statement in STATEMENTS:
        try:
            counted = console.query_frame(spark, tables, statement).select(F.lit(True).alias("accepted"), F.col("n").alias("result_rows"))
        except console.QueryRefused:
            counted = spark.range(1).select(F.lit(False).alias("accepted"), F.lit(0).cast("bigint").alias("result_rows"))
        parts.append(counted.select(F.lit(statement).alias("statement"), "accepted", "result_rows"))
    return reduce(lambda a, b: a.unionAll(b), parts)


def _family(name: str, sql: str, checked: str | None = None) -> None:
    """A console query: the same text runs in Spark and in the check, unless the check has its own."""

    @query(name, checked or sql)
    def run(spark, sf_dir):
        return console.query_frame(spark, _tables(spark, sf_dir), sql)


_family("sql2_console_query", "select o_orderpriority, count(*) as orders from orders group by o_orderpriority")
_family("sql4_inner_left_join", """
select n_name, count(s_suppkey) as suppliers, count(c_custkey) as customers from nation join region on r_regionkey = n_regionkey
left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by n_name""")
_family("sql4_semi_anti_join", """
select c_mktsegment, count(*) as customers from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)
and not exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > 9900) group by c_mktsegment""")
_family("sql4_full_join", """
select coalesce(a.r, b.r) as regionkey, coalesce(a.n, 0) as nations, coalesce(b.n, 0) as names from (select n_regionkey r, count(*) n from nation where n_nationkey < 12 group by n_regionkey) a
full join (select r_regionkey r, count(*) n from region where r_regionkey > 1 group by r_regionkey) b on a.r = b.r""")
_family("sql4_range_join", """
select a.p_brand, count(*) as pairs from (select distinct p_brand, p_size from part) a join (select distinct p_size lo, p_size + 2 hi from part where p_size > 45) b
on a.p_size between b.lo and b.hi group by a.p_brand""")
_family("sql4_set_operations", """
select n_nationkey as k from nation union all select s_nationkey from supplier where s_acctbal > 9000
union all (select c_nationkey from customer intersect select s_nationkey from supplier) union all (select n_nationkey from nation except select s_nationkey from supplier)""")
_family("sql4_rollup", """
select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)""")
_family("sql4_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
_family("sql4_grouping_sets", """
select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) as int) as g from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())""")
_family("sql4_window_ranking", """
select c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as bigint) as rn,
cast(rank() over (partition by c_nationkey order by floor(c_acctbal / 1000)) as bigint) as rk,
cast(dense_rank() over (partition by c_nationkey order by floor(c_acctbal / 1000)) as bigint) as dr,
cast(ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as bigint) as quarter from customer""")
_family("sql4_window_frames", """
select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as before, lead(o_totalprice) over (partition by o_custkey order by o_orderkey) as after,
count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as moving,
max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as running_max from orders""")
_family("sql4_correlated", """
select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as largest from customer
where c_acctbal > (select avg(s_acctbal) from supplier)""")
_family("sql4_distinct", "select o_orderpriority, count(distinct o_custkey) as customers, count(distinct o_orderstatus) as states from orders group by o_orderpriority")
_family("sql4_top_with_ties", """
select * from (select p_partkey, p_size, cast(rank() over (order by p_size desc) as bigint) as r from part) t where r <= 10""")
_family("sql4_scalar_functions", """
select o_orderkey, upper(o_orderpriority) as u, substring(o_orderpriority, 1, 3) as s, cast(length(o_orderstatus) as bigint) as l, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m,
date_trunc('month', o_orderdate) as first_day, cast(floor(o_totalprice / 1000) as bigint) as k, abs(o_custkey - 500) as d, coalesce(nullif(o_orderstatus, 'F'), 'none') as st from orders""")


# Parts form a tree by their numbers; every part's depth, and how many parts it has above it on the way from the top.
_family("sql4_recursive", """
with recursive tree (k, depth, top) as (select p_partkey, 0, p_partkey from part where p_partkey between 1 and 3
union all select p.p_partkey, t.depth + 1, t.top from part p join tree t on floor(p.p_partkey / 4) = t.k where p.p_partkey > 3)
select k, depth, top from tree""")
_family("sql4_interval_frames", """
select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval 90 days preceding and current row) as recent,
max(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval 365 days preceding and interval 1 day preceding) as best_before,
cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_orderpriority order by o_orderdate range between interval 7 days preceding and interval 7 days following) as double) as around
from orders""")
_family("sql4_unpivot", """
select o_orderkey, measure, amount from (select o_orderkey, cast(o_custkey as double) as customer, o_totalprice as price, cast(year(o_orderdate) as double) as year from orders)
unpivot (amount for measure in (customer, price, year))""")
_family("sql4_lateral_words", """
select conv_id, cast(count(*) as bigint) as words, cast(max(w.place) as bigint) as last_place, max(w.size) as longest from conversations,
lateral (select place, length(word) as size from posexplode(split(text, ' ')) as t(place, word) where word <> '') w group by conv_id""", """
select conv_id, count(*) as words, max(place) as last_place, cast(max(length(word)) as int) as longest from conversations,
lateral (select unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as place) w where word <> '' group by conv_id""")
_family("sql4_lateral_structs", """
select conv_id, turn, w.s.head as head, w.s.tail as tail from conversations,
lateral (select named_struct('head', substring(line, 1, 5), 'tail', length(line)) as s from explode(split(text, '\n')) as t(line) where line <> '') w""", """
select conv_id, turn, s.head as head, cast(s.tail as int) as tail from conversations,
lateral (select {'head': substring(line, 1, 5), 'tail': length(line)} as s from (select unnest(string_split(text, chr(10))) as line) where line <> '') w""")


@query("sql4_asof_join", """
with r as (select user_id, ts, max(event_id) as seen, any_value(event_type) as seen_type from events where event_type <> 'purchase' group by 1, 2)
select e.event_id, coalesce(r.seen, -1) as seen, coalesce(r.seen_type, '') as seen_type from (select * from events where event_type = 'purchase') e asof left join r on e.user_id = r.user_id and e.ts >= r.ts
""")
def asof(spark, sf_dir):
    """Each purchase with what its user did last before it."""
    events = table(spark, sf_dir, "events")
    seen = events.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("seen"), F.col("event_type").alias("seen_type"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return timeline.asof_join(bought, seen, ["user_id"], "ts", "ts", ["seen", "seen_type"]).select("event_id", F.coalesce("seen", F.lit(-1).cast("bigint")).alias("seen"), F.coalesce("seen_type", F.lit("")).alias("seen_type"))


@query("sql4_pivot", """
select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1
""")
def pivot(spark, sf_dir):
    counted = reshape.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", F.count("o_orderkey"))
    return counted.fillna(0)


@query("sql3_example_queries", on_sales("""
with b as (select count(*) as n from sales), s as (select count(*) as n from (select distinct * from sales))
select b.n as bronze_rows, s.n as silver_rows, b.n - s.n as removed_rows from b, s
"""))
def example_queries(spark, sf_dir):
    df = sales(spark, sf_dir)
    tables = {"bronze": df, "silver": df.distinct()}
    return console.query_frame(spark, tables, console.example_queries(tables)["removed"])
