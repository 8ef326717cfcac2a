"""Registry, table access and the derived inputs shared by the queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can state it, the SQL with the same result."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, in its own splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files a query writes and reads back: the cluster's shared folder, or a
    temporary one in a session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"{shared.rstrip('/')}/grainmill" if shared else tempfile.mkdtemp(prefix="grainmill-")
    return f"{base}/{name}-{uuid.uuid4().hex[:8]}"


# -- derived inputs -----------------------------------------------------------------------------------

# Clean typed sales over the star schema. The same text runs in Spark and in the SQL check.
SALES = """
select concat('V-', l_orderkey, '-', l_linenumber) order_id, cast(l_shipdate as date) order_date,
  case l_suppkey % 5 when 0 then 'Casablanca' when 1 then 'Rabat' when 2 then 'Marrakech' when 3 then 'Tanger' else 'Fès' end city,
  p_name product, p_type category, n_name country,
  case l_orderkey % 3 when 0 then 'WhatsApp' when 1 then 'Boutique' else 'Site web' end channel,
  case l_linenumber % 3 when 0 then 'Livrée' when 1 then 'Annulée' else 'En cours' end status,
  cast(l_quantity as decimal(18,0)) quantity, cast(p_retailprice as decimal(18,2)) unit_price,
  cast(cast(l_quantity as decimal(18,0)) * cast(p_retailprice as decimal(18,2)) as decimal(18,2)) amount,
  cast(l_linenumber as decimal(18,2)) discount, 1 + l_orderkey % 5 rating, l_orderkey * 7 + l_linenumber k
from {lineitem} join {part} on p_partkey = l_partkey join {supplier} on s_suppkey = l_suppkey join {nation} on n_nationkey = s_nationkey
"""

# Text cells with seeded faults. Some rows are written twice to make exact duplicates.
MESSY = """
select k, order_id,
  case when k % 83 = 0 then '' when k % 127 = 0 then '01/01/2099' when k % 3 = 0 then cast(order_date as string)
    else concat(substr(cast(order_date as string), 9, 2), '/', substr(cast(order_date as string), 6, 2), '/', substr(cast(order_date as string), 1, 4)) end order_date,
  case when k % 97 = 0 then '  ' when k % 53 = 0 then case city when 'Casablanca' then 'Casblanca' when 'Marrakech' then 'Marrakesh' when 'Fès' then 'Fes' when 'Rabat' then 'rabat' else 'Tangr' end
    when k % 31 = 0 then concat(' ', city, ' ') else city end city,
  product, category, channel, status,
  cast(case when k % 89 = 0 then -quantity else quantity end as string) quantity,
  replace(cast(unit_price as string), '.', ',') unit_price,
  case when k % 101 = 0 then 'N/A' when k % 61 = 0 then cast(amount + 10 as string) when k % 7 = 0 then concat(replace(cast(amount as string), '.', ','), ' DH')
    when k % 2 = 0 then replace(cast(amount as string), '.', ',') else cast(amount as string) end amount,
  cast(case when k % 113 = 0 then 9 else rating end as string) rating
from {base}
"""

# One invoice text per order.
INVOICES = """
select o_orderkey doc_id, concat('Supplier: ', c_name, ' SARL', chr(10),
  'Facture N° FA-', o_orderkey, chr(10),
  'Date de facture : ', substr(cast(cast(o_orderdate as date) as string), 9, 2), '/', substr(cast(cast(o_orderdate as date) as string), 6, 2), '/', substr(cast(cast(o_orderdate as date) as string), 1, 4), chr(10),
  'Sous-total HT : ', cast(cast(o_totalprice as decimal(18,2)) as string), ' MAD', chr(10),
  'TVA 20 % : ', cast(o_custkey as string), ',00 MAD', chr(10),
  'TOTAL TTC : ', replace(cast(cast(o_totalprice as decimal(18,2)) + o_custkey as string), '.', ','), ' MAD') text
from {orders} join {customer} on c_custkey = o_custkey
"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SALES, **_tables(spark, sf_dir, "lineitem", "part", "supplier", "nation"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates come from repeating a row in place, so the star schema is joined once."""
    copies = F.when(F.col("k") % 211 == 0, 2).otherwise(1)
    base = sales(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
    return spark.sql(MESSY, base=base)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messy without the column that seeded its faults."""
    return messy(spark, sf_dir).drop("k")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INVOICES, **_tables(spark, sf_dir, "orders", "customer"))


_NAMES = {n: n for n in ("lineitem", "part", "supplier", "nation", "orders", "customer")}
_SALES_CTE = f"sales as ({SALES.format(**_NAMES)})"
_MESSY_CTE = (
    f"base as (select * from sales union all select * from sales where k % 211 = 0), messy as ({MESSY.format(base='base')}), "
    "dirty as (select * exclude (k) from messy)"
)
_INVOICES_CTE = f"inv as ({INVOICES.format(**_NAMES)})"


def on_sales(sql: str) -> str:
    """SQL over the derived table `sales`."""
    return _prefixed(_SALES_CTE, sql)


def on_messy(sql: str) -> str:
    """SQL over the derived tables `sales`, `messy` and `dirty`."""
    return _prefixed(f"{_SALES_CTE}, {_MESSY_CTE}", sql)


def on_invoices(sql: str) -> str:
    """SQL over the derived table `inv`."""
    return _prefixed(_INVOICES_CTE, sql)


def _prefixed(ctes: str, sql: str) -> str:
    body = sql.strip()
    return f"with {ctes}, {body[5:]}" if body[:5].lower() == "with " else f"with {ctes} {body}"


# -- SQL text shared by the checks ---------------------------------------------------------------------

NUMBER_PATTERN = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"


def sql_number(cell: str) -> str:
    """SQL for the locale number parser."""
    compact = (
        f"regexp_replace(replace(regexp_replace(regexp_replace(trim({cell}), '^''\\s*', ''), "
        "'(?i)(mad|dhs?|dirhams?|€|\\$)', '', 'g'), ' ', ''), '%$', '')"
    )
    dotted = (
        f"case when contains({compact}, ',') and contains({compact}, '.') then "
        f"case when regexp_matches({compact}, ',[^.]*$') then replace(replace({compact}, '.', ''), ',', '.') "
        f"else replace({compact}, ',', '') end else replace({compact}, ',', '.') end"
    )
    return f"(case when regexp_full_match({dotted}, '{NUMBER_PATTERN}') then try_cast({dotted} as double) end)"


def sql_date(cell: str) -> str:
    """SQL for the date parser over the two shapes of the derived data."""
    return f"coalesce(try_strptime(trim({cell}), '%Y-%m-%d'), try_strptime(trim({cell}), '%d/%m/%Y'))"


def sql_normal(cell: str) -> str:
    """SQL for normalised text."""
    return f"trim(regexp_replace(lower(strip_accents({cell})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql_label_map(table: str) -> str:
    """SQL for the labels of the city column to rewrite: source, target, reason, rows."""
    return f"""with c as (select trim(city) as v, count(*) as n from {table} where trim(city) <> '' group by 1), k as (select v, n, {sql_normal('v')} as key from c),
l as (select key, first(v order by n desc, v) as leader from k group by 1)
select v as source, case when leader <> v then leader when key in ('casa', 'casblanca') then 'Casablanca' when key = 'marrakesh' then 'Marrakech' else 'Fès' end as target,
  case when leader <> v then 'spelling' else 'known' end as reason, n as "rows"
from k join l using (key) where v not in ('Casablanca', 'Marrakech', 'Fès') and (leader <> v or (key in ('casa', 'casblanca', 'marrakesh', 'fes')))"""
