"""Stored tables are profiled column by column, and Silver that is not stored is written once."""

from grainmill.operators import gold, profile
from grainmill.plans import medallion
from grainmill.sources.layers import Project

ROWS = [(i, None if i % 4 == 0 else f"c{i % 3}", None if i % 2 else i * 1.5, None) for i in range(30)] + [(1, "c1", float("nan"), None), (1, "", -0.0, None)]


def test_stored_profile_equals_the_expanded_one(spark):
    for rows in (ROWS, []):
        df = spark.createDataFrame(rows, "id int, city string, `unit price` double, nothing string")
        expanded, stored = profile.gold_column_profile(df), profile.gold_column_profile(df, stored=True)
        assert stored.collect() == expanded.collect()
        assert stored.dtypes == expanded.dtypes
        assert "Expand" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_gold_reads_unstored_silver_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(f"V-{i}", f"c{i % 3}", i * 10) for i in range(30)], "order_id string, city string, amount int")
    tables = medallion.publish_gold(Project(spark, str(tmp_path), "p"), rows.mapInPandas(read, rows.schema))
    assert seen.value == 30
    assert {r["column_name"]: r["distinct_values"] for r in tables["gold_column_profile"].collect()} == {"order_id": 30, "city": 3, "amount": 30}
    assert {r["city"]: r["share_pct"] for r in tables["gold_amount_by_city"].collect()} == {"c0": 31.0, "c1": 33.3, "c2": 35.6}


def test_shares_take_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "sales")
    spark.createDataFrame([("a", 1), ("b", -2), (None, 3)], "city string, amount int").write.parquet(path)
    found = gold.total_by_dimension(spark.read.parquet(path), "amount", "city")
    assert [(r["total"], r["share_pct"]) for r in found.collect()] == [(3.0, 75.0), (1.0, 25.0), (-2.0, 0.0)]
    assert "Reused" in found._jdf.queryExecution().executedPlan().toString()
