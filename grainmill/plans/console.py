"""Read-only SQL over the published tables.

Spark parses the text. The parsed plan is then accepted only when every node is a query node and
every relation is a published table, which a list of forbidden words cannot guarantee: Spark also
reads files named in a FROM clause.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from grainmill.functions.numbers import result_value
from grainmill.operators.roles import quoted

MAX_QUERY = 4000
MAX_ROWS = 200
# Shuffled size up to which one side's partitions are joined by hash; at least Spark's advisory partition size.
HASHED_PARTITION = "64MB"


class QueryRefused(ValueError):
    """The query is not a single read-only query over published tables."""


# Logical plan nodes that only read. Anything else, every command included, is refused.
READ_NODES = {
    "Aggregate", "AsOfJoin", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "Limit", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Range",
    "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction",
    "UnresolvedTVFAliases", "UnresolvedWith", "Window", "WithWindowDefinition", "UnionLoop", "WithCTE", "CTERelationDef",
}
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "inline", "range", "stack"}


def _jvm_list(spark: SparkSession, seq) -> list:
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))


def check_query(spark: SparkSession, query: str, tables: set[str]) -> str:
    """The query without its final semicolon, or QueryRefused."""
    cleaned = query.strip().rstrip(";").strip()
    if not cleaned:
        raise QueryRefused("empty query")
    if len(cleaned) > MAX_QUERY:
        raise QueryRefused("query too long")
    if not re.match(r"(?i)(select|with)\b", cleaned):
        raise QueryRefused("only SELECT or WITH ... SELECT")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(cleaned)
    except ParseException as error:
        raise QueryRefused(f"unreadable query: {str(error).splitlines()[0]}") from error
    _check_plan(spark, plan, {t.lower() for t in tables})
    return cleaned


def _check_plan(spark: SparkSession, plan, allowed: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in READ_NODES:
        raise QueryRefused(f"not allowed in a read-only query: {kind}")
    inner = set(allowed)
    if kind == "UnresolvedWith":
        # A common table expression sees the ones before it; its name is then a known relation.
        for pair in _jvm_list(spark, plan.cteRelations()):
            _check_plan(spark, pair._2(), inner | {pair._1().lower()})
            inner.add(pair._1().lower())
    if kind == "UnresolvedRelation":
        name = ".".join(_jvm_list(spark, plan.multipartIdentifier())).lower()
        if name not in allowed:
            raise QueryRefused(f"unknown table: {name}")
    if kind == "UnresolvedTableValuedFunction":
        name = ".".join(_jvm_list(spark, plan.name())).lower()
        if name not in TABLE_FUNCTIONS:
            raise QueryRefused(f"not allowed: {name}")
    for child in _jvm_list(spark, plan.children()):
        _check_plan(spark, child, inner)
    for sub in _jvm_list(spark, plan.subqueries()):
        _check_plan(spark, sub, inner)
    for expression in _jvm_list(spark, plan.expressions()):
        if _calls_jvm(spark, expression):
            raise QueryRefused("calls to JVM methods are not allowed")


# Functions that reach outside the query: arbitrary JVM calls and session details.
OUTSIDE_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "current_user", "session_user", "user"}


def _calls_jvm(spark: SparkSession, expression) -> bool:
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        if _jvm_list(spark, expression.nameParts())[-1].lower() in OUTSIDE_FUNCTIONS:
            return True
    return any(_calls_jvm(spark, child) for child in _jvm_list(spark, expression.children()))


@dataclass
class QueryResult:
    frame: DataFrame
    rows: list
    columns: list[str]
    truncated: bool
    elapsed_ms: float


def query_frame(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """The checked query as a lazy frame over the given tables."""
    statement = check_query(spark, query, set(tables))
    if not tables:
        raise QueryRefused("no table is published")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    # Spark stops a recursive query at a million rows. The tables may be larger; runaway recursion still ends at the limit of
    # levels. Read when the frame runs, so it stays set.
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    if re.search(r"(?i)\blateral\b", statement):
        # Spark joins what a lateral subquery makes of a cell back to its rows, each with the whole cell. A sort of them takes far
        # more memory than their compressed shuffle promises; where one side's partitions are small, hashing that side needs no sort.
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED_PARTITION)
    return spark.sql(statement)


def displayed(df: DataFrame) -> DataFrame:
    """Result cells as the console shows them."""
    return df.select(*[result_value(quoted(f.name), f.dataType).alias(f.name) for f in df.schema])


def run_query(spark: SparkSession, tables: dict[str, DataFrame], query: str, limit: int = MAX_ROWS) -> QueryResult:
    """First rows of a query; one row more is fetched to know whether it was cut."""
    df = query_frame(spark, tables, query)
    started = time.perf_counter()
    rows = displayed(df).limit(limit + 1).collect()
    elapsed = round((time.perf_counter() - started) * 1000, 1)
    return QueryResult(df, [tuple(r) for r in rows[:limit]], df.columns, len(rows) > limit, elapsed)


def example_queries(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Queries suited to the published tables."""
    found = {}
    by_dimension = sorted(n for n in tables if n.startswith("gold_") and "_by_" in n)
    if by_dimension:
        found["top"] = f"SELECT * FROM {by_dimension[0]} ORDER BY 2 DESC LIMIT 10"
    if "gold_monthly_trend" in tables:
        found["trend"] = "SELECT month, total, transactions, mom_change_pct FROM gold_monthly_trend ORDER BY month"
    if "gold_column_profile" in tables:
        found["profile"] = (
            "SELECT column_name, data_type, completeness_pct, distinct_values FROM gold_column_profile ORDER BY completeness_pct"
        )
    if {"bronze", "silver"} <= tables.keys():
        found["removed"] = (
            "SELECT count(*) AS bronze_rows, (SELECT count(*) FROM silver) AS silver_rows, "
            "count(*) - (SELECT count(*) FROM silver) AS removed_rows FROM bronze"
        )
        found["head"] = "SELECT * FROM silver LIMIT 20"
    return found
