"""Files, layers, exports, renames and relabels, and whole runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.operators import relabel
from grainmill.plans import medallion
from grainmill.sources import exports, files, layers
from grainmill.sources.layers import Project
from workload.base import dirty, messy, on_messy, on_sales, query, sales, scratch, table

AS_OF = dt.date(2026, 1, 1)
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


def _csv(df, spark, name, **options):
    path = scratch(spark, name) + ".csv"
    settings = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **options}
    df.write.options(**settings).csv(path)
    return path


@query("src1_csv_scan", f"select {ORDER_COLUMNS}, cast(o_totalprice as decimal(18,2))::double as price from orders")
def csv_scan(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", "), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    back = files.read_dataset(spark, _csv(df, spark, "orders", sep=";"))
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus", "o_orderpriority", F.col("price").cast("double").alias("price"))


@query("src2_json_scan", 'select o_orderkey, o_orderstatus as "customer.state", o_custkey as "customer.key", o_orderpriority as priority from orders')
def json_scan(spark, sf_dir):
    """One folder of two kinds of file: documents of about two thousand records under `data`, and JSON Lines."""
    orders = table(spark, sf_dir, "orders")
    documents = orders.count() // 2000 + 1
    record = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("key")).alias("customer"), F.col("o_orderpriority").alias("priority"))
    bucket = F.pmod(F.xxhash64("o_orderkey"), F.lit(documents))
    in_lines = F.col("o_orderkey") % 3 == 0
    packed = orders.where(~in_lines).groupBy(bucket.alias("b")).agg(F.collect_list(record).alias("data")).select(F.to_json(F.struct("data")).alias("value"))
    path = scratch(spark, "orders") + ".json"
    packed.write.option("maxRecordsPerFile", 1).text(path)
    orders.where(in_lines).select(F.to_json(record).alias("value")).write.mode("append").text(path)
    return files.read_dataset(spark, path)


@query("src3_scan_guard", 'select o_orderkey as "Key", o_custkey as colonne_2, o_orderstatus as "State", o_orderpriority as state_2 from orders')
def scan_guard(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", ")).toDF(" Key ", "", "State", "state")
    return files.guard(df)


@query("src4_bronze_text", on_messy("""
select order_id, nullif(order_date, '') as order_date, city, product, quantity, unit_price, amount, rating from dirty
"""))
def bronze_text(spark, sf_dir):
    df = dirty(spark, sf_dir).select("order_id", "order_date", "city", "product", "quantity", "unit_price", "amount", "rating")
    return files.read_bronze_text(spark, _csv(df, spark, "dirty"))


def _project(spark, name):
    return Project(spark, scratch(spark, "project"), name)


@query("src6_read_table", f"select {ORDER_COLUMNS} from orders")
def read_table(spark, sf_dir):
    project = _project(spark, "orders")
    project.save(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", ")), "silver")
    return project.read("silver")


@query("src11_fingerprint")
def fingerprint(spark, sf_dir):
    return files.fingerprint(spark, f"{sf_dir}/*.parquet")


GIVEN = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("src12_catalogue", " union all ".join(f"select 'gold_{t}' as name, 'gold' as layer, count(*) as \"rows\" from {t}" for t in GIVEN))
def catalogue(spark, sf_dir):
    return layers.catalogue({f"gold_{t}": table(spark, sf_dir, t) for t in GIVEN}).select("name", "layer", "rows")


@query("src12_layer_sizes", "select 'gold' as layer, count(*) as tables, cast(sum(n) as bigint) as \"rows\" from ("
       + " union all ".join(f"select count(*) as n from {t}" for t in GIVEN) + ")")
def layer_sizes(spark, sf_dir):
    return layers.layer_sizes(layers.catalogue({f"gold_{t}": table(spark, sf_dir, t) for t in GIVEN}))


@query("snk1_bronze_audit", "select count(*) as cells, min(r) as first, max(r) as last, count(distinct r) as numbers from (select row_number() over () as r from orders)")
def bronze_audit(spark, sf_dir):
    path = _csv(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", ")), spark, "orders")
    bronze = medallion.ingest_bronze(_project(spark, "audit"), path)
    number = F.col("_row_number")
    return bronze.agg(F.count("*").alias("cells"), F.min(number).alias("first"), F.max(number).alias("last"), F.count_distinct(number).alias("numbers"))


@query("snk2_parquet_write", f"select {ORDER_COLUMNS}, concat('[', o_custkey, ']') as keys from orders")
def parquet_write(spark, sf_dir):
    project = _project(spark, "nested")
    df = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", "), F.array("o_custkey").alias("keys"))
    return spark.read.parquet(project.write(df, "silver"))


@query("snk3_silver_publish", on_sales("select city, count(*) as cells, cast(sum(amount) as double) as total from sales group by 1"))
def silver_publish(spark, sf_dir):
    silver = _project(spark, "silver").save(sales(spark, sf_dir), "silver")
    return silver.groupBy("city").agg(F.count("*").alias("cells"), F.sum("amount").cast("double").alias("total"))


@query("snk4_gold_publish", on_sales("""
select 'gold_column_profile' as name, 14::bigint as "rows" union all select 'gold_amount_by_product', count(distinct product) from sales
union all select 'gold_monthly_trend', count(distinct strftime(order_date, '%Y-%m')) from sales
"""))
def gold_publish(spark, sf_dir):
    project = _project(spark, "gold")
    project.save(spark.range(1).toDF("n"), "gold_stale")
    medallion.publish_gold(project, sales(spark, sf_dir))
    return layers.catalogue(project.tables()).select("name", "rows")


@query("snk6_contract_publish")
def contract_publish(spark, sf_dir):
    from grainmill.operators.contract import contract_frame, infer_contract

    project = _project(spark, "contract")
    medallion.publish_contract(project, infer_contract(sales(spark, sf_dir)))
    return contract_frame(spark, medallion.read_contract(project))


RELABELLED = """
select order_id as "'=id", case city when 'Fès' then 'Fes' else city end as ville, case when amount like '-%' or amount like '=%' then concat('''', amount) else amount end as amount
from (select order_id, city, concat('=', amount) as amount from sales)
"""


def _export_input(spark, sf_dir):
    df = sales(spark, sf_dir).select("order_id", "city", F.concat(F.lit("="), F.col("amount").cast("string")).alias("amount"))
    return df, {"order_id": "=id", "city": "ville"}, {"city": {"Fès": "Fes"}}


@query("snk7_csv_export", on_sales(RELABELLED))
def csv_export(spark, sf_dir):
    df, names, values = _export_input(spark, sf_dir)
    path = scratch(spark, "export")
    exports.write_csv(df, path, names, values)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("snk8_json_export", on_sales("select order_id, strftime(order_date, '%Y-%m-%d') as order_date, city from sales"))
def json_export(spark, sf_dir):
    path = scratch(spark, "export")
    exports.write_json(sales(spark, sf_dir).select("order_id", "order_date", "city"), path)
    return spark.read.schema("order_id string, order_date string, city string").json(path)


@query("snk9_safe_export", on_sales("select order_id as \"'@id\", concat('''+', product) as product, quantity::double as quantity from sales"))
def safe_export(spark, sf_dir):
    df = sales(spark, sf_dir).select(F.col("order_id").alias("@id"), F.concat(F.lit("+"), "product").alias("product"), F.col("quantity").cast("double").alias("quantity"))
    return relabel.safe_export(df)


def _dictionary(spark, sf_dir):
    cities = sales(spark, sf_dir).select("city").distinct()
    return cities.select(F.lit("city").alias("column"), F.lit("Ville").alias("display_name"), F.col("city").alias("source"), F.upper("city").alias("display"))


@query("snk11_label_maps", on_sales("""
select distinct 'value' as kind, 'city' as column_name, city as source, upper(city) as display from sales union all select 'column', 'city', 'city', 'Ville'
"""))
def label_maps(spark, sf_dir):
    return relabel.label_map_rows(_dictionary(spark, sf_dir))


@query("snk10_snapshot", on_messy("select trim(city) as city, count(*) as cells from dirty group by 1"))
def snapshot(spark, sf_dir):
    from grainmill.plans import versions

    project = _project(spark, "snapshot")
    raw = project.save(dirty(spark, sf_dir).select("order_id", "city"), "bronze")
    versions.apply_batch(project, raw, ["strip_text"], "first", AS_OF)
    versions.apply_batch(project, raw, ["normalize_blanks"], "second", AS_OF)
    # What the second batch replaced is what the first one made.
    before = versions.batches(project).orderBy(F.desc("applied_at")).first()["before"]
    return spark.read.parquet(before).groupBy("city").agg(F.count("*").alias("cells"))


@query("src10_current_version", on_messy("select trim(city) as city, count(*) as cells from dirty group by 1"))
def current_version(spark, sf_dir):
    from grainmill.plans import versions

    project = _project(spark, "current")
    raw = project.save(dirty(spark, sf_dir).select("order_id", "city"), "bronze")
    versions.apply_batch(project, raw, ["strip_text"], "first", AS_OF)
    return versions.current(project, raw).groupBy("city").agg(F.count("*").alias("cells"))


@query("pip1_medallion_run")
def medallion_run(spark, sf_dir):
    project = _project(spark, "run")
    medallion.run(project, _csv(dirty(spark, sf_dir), spark, "dirty"), AS_OF)
    return project.runs().select("trigger", "rows.bronze", "rows.silver", F.inline("checks.silver"))


def _two_runs(spark, sf_dir):
    project = _project(spark, "runs")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("amount"))
    bronze = project.save(customers, "bronze")
    medallion.refresh(project, bronze, AS_OF, "import")
    medallion.refresh(project, bronze, AS_OF, "manual")
    return project


@query("pip3_replay", "select 'manual' as trigger, count(*) as silver_rows, 2 as gold_tables from customer union all select 'import', count(*), 2 from customer")
def replay(spark, sf_dir):
    runs = _two_runs(spark, sf_dir).runs()
    return runs.select("trigger", F.col("rows.silver").alias("silver_rows"), F.size("gold_tables").alias("gold_tables"))


@query("src9_run_journal", """
select 'manual' as trigger, 'success' as status, count(*) as silver, 100 as score, 3 as stages from customer""")
def run_journal(spark, sf_dir):
    return _two_runs(spark, sf_dir).runs(limit=1).select("trigger", "status", "rows.silver", "quality.silver.score", F.size("stages").alias("stages"))


@query("snk5_journal_append")
def journal_append(spark, sf_dir):
    return _two_runs(spark, sf_dir).runs(limit=50).select("trigger", "started_at", F.inline("stages"))


@query("run1_history")
def history(spark, sf_dir):
    return layers.run_history(_two_runs(spark, sf_dir).runs(50))


# -- projections, renames, relabels -------------------------------------------------------------------------------


@query("prj1_preview", f"select {ORDER_COLUMNS} from orders order by o_orderkey limit 12")
def preview(spark, sf_dir):
    return layers.preview(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", ")), ["o_orderkey"])


@query("prj2_page", f"select {ORDER_COLUMNS}, (select count(*) from orders) as total_rows from orders order by o_orderkey limit 50 offset 100")
def page(spark, sf_dir):
    return layers.table_page(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS.split(", ")), ["o_orderkey"], 50, 100)


@query("prj2_deep_page", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, (select count(*) from lineitem) as total_rows from lineitem
order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 200 offset (select count(*) // 10 * 9 from lineitem)""")
def deep_page(spark, sf_dir):
    """Nine tenths into the line items; at most a range of keys is sorted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return layers.table_page(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 200, lines.count() // 10 * 9)


@query("prj3_rename_swap", "select o_custkey as o_orderkey, o_orderkey as o_custkey, o_orderstatus as statut from orders")
def rename_swap(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return relabel.rename_columns(df, {"o_orderkey": "o_custkey", "o_custkey": "o_orderkey", "o_orderstatus": " statut "})


@query("prj4_relabel", on_sales("select case city when 'Fès' then 'Rabat' else city end as city, count(*) as cells from sales group by 1"))
def relabel_merge(spark, sf_dir):
    asked = spark.createDataFrame([("Fès", "Rabat")], "source string, target string")
    return relabel.relabel(sales(spark, sf_dir), "city", asked, allow_merge=True).groupBy("city").agg(F.count("*").alias("cells"))


@query("prj4_relabel_report", on_sales("""
select city as source, case city when 'Fès' then 'Rabat' else city end as target, count(*) as "rows", city = 'Fès' as requested, true as known, city in ('Fès', 'Rabat') as merged
from sales group by 1 union all select 'Oujda', 'Fès', 0, true, false, false
"""))
def relabel_report(spark, sf_dir):
    asked = spark.createDataFrame([("Fès", "Rabat"), ("Oujda", "Fès")], "source string, target string")
    return relabel.relabel_report(sales(spark, sf_dir), "city", asked)


@query("prj5_display_view", on_sales("select order_id, upper(city) as \"Ville\", amount::double as amount from sales"))
def display_view(spark, sf_dir):
    names, values = relabel.label_maps(_dictionary(spark, sf_dir))
    df = sales(spark, sf_dir).select("order_id", "city", F.col("amount").cast("double").alias("amount"))
    return relabel.display_view(df, names, values)


@query("prj6_category_listing", on_sales("select city as source, upper(city) as display, count(*) as \"rows\" from sales group by 1"))
def category_listing(spark, sf_dir):
    return relabel.category_listing(sales(spark, sf_dir), "city", _dictionary(spark, sf_dir).select("source", "display"))


@query("prj7_eligibility", on_sales("""
select column_name, reason = 'ok' as can_relabel, reason from (select unnest(['order_id', 'order_date', 'city', 'product', 'amount']) as column_name,
  unnest(['too_many', 'not_text', 'ok', (select case when count(distinct product) > 50 then 'too_many' else 'ok' end from sales), 'not_text']) as reason)
"""))
def eligibility(spark, sf_dir):
    return relabel.relabel_eligibility(sales(spark, sf_dir).select("order_id", "order_date", "city", "product", "amount"))


@query("prj8_draft_collision", on_sales("select cast(count(distinct product) as bigint) as labels, count(*) as affected_rows, true as has_collision from sales where product in (select product from sales group by 1 order by count(*) desc, 1 limit 50) having true"
       ).replace("cast(count(distinct product) as bigint) as labels", "least(50, count(distinct product)) as labels"))
def draft_collision(spark, sf_dir):
    listing = relabel.category_listing(sales(spark, sf_dir), "product")
    # Labels of the same colour collide once only the first word is kept.
    return relabel.draft_collisions(listing.withColumn("display", F.split("display", " ")[0]))


@query("prj9_stale_preview", on_sales("select 'Oujda' as source, 'gone' as problem union all select 'Fès', 'not_submitted'"))
def stale_preview(spark, sf_dir):
    current = sales(spark, sf_dir).select(F.col("city").alias("source")).distinct()
    submitted = current.where("source <> 'Fès'").unionByName(spark.createDataFrame([("Oujda",)], "source string"))
    return relabel.stale_preview(submitted, current)


@query("prj16_json_rows", "select concat('{\"o_orderkey\":', o_orderkey, ',\"o_orderdate\":\"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '\",\"none\":null}') as json from orders")
def json_rows(spark, sf_dir):
    return relabel.json_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lit(float("nan")).alias("none")))


@query("flt4_typed_equality", "select o_orderkey, o_orderstatus is not distinct from case when o_custkey % 3 = 0 then null else 'F' end as same, false as across from orders")
def typed_equality(spark, sf_dir):
    other = F.when(F.col("o_custkey") % 3 != 0, "F")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", relabel.typed_equal(F.col("o_orderstatus"), T.StringType(), other, T.StringType()).alias("same"),
        relabel.typed_equal(F.col("o_custkey"), T.LongType(), F.col("o_custkey").cast("string"), T.StringType()).alias("across"),
    )
