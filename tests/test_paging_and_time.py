import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import reshape, timeline
from grainmill.sources import layers


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_deep_pages_equal_the_sorted_table(spark, monkeypatch, kind):
    monkeypatch.setattr(layers, "SORTED_ROWS", 500)
    rng = random.Random(4)
    # Ties, a key that holds a third of the rows, and rows without a key.
    rows = [(None if k % 40 == 0 else 777 if k % 3 == 0 else rng.randint(0, 5000), k) for k in range(9000)]
    df = spark.createDataFrame(rows, "k int, n int").select(F.col("k").cast(kind).alias("k"), "n")
    everything = [tuple(r) for r in df.orderBy("k", "n").collect()]
    for offset in (0, 100, 230, 1500, 2500, 5200, 8890, 8999, 9500):
        got = layers.table_page(df, ["k", "n"], 60, offset).collect()
        assert [tuple(r)[:2] for r in got] == everything[offset : offset + 60] and all(r.total_rows == 9000 for r in got)


def test_asof_join_against_a_loop(spark):
    rng = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    when = lambda: day + dt.timedelta(hours=rng.randint(0, 24 * 12))
    left = [(k, rng.choice([1, 2, 3, None]), when() if k % 17 else None) for k in range(200)]
    right = [(rng.choice([1, 1, 1, 2, 4, None]), when() if k % 11 else None, k) for k in range(150)]
    want = []
    for k, key, at in left:
        seen = [(t, v) for r, t, v in right if None not in (key, at, r, t) and r == key and t <= at]
        want.append((k, max(seen)[1] if seen else None))
    a = spark.createDataFrame(left, "k int, key int, at timestamp")
    b = spark.createDataFrame(right, "key int, seen timestamp, v int")
    for part in (86_400_000_000, 3_600_000_000, 10**16):
        got = timeline.asof_join(a, b, ["key"], "at", "seen", ["v"], part)
        assert got.columns == ["k", "key", "at", "v"]
        assert sorted((r.k, r.v) for r in got.collect()) == sorted(want)
    assert timeline.asof_join(a, b.limit(0), ["key"], "at", "seen", ["v"]).where("v is not null").isEmpty()


def test_pivot_finds_its_columns_and_refuses_too_many(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 4)], "g string, c string, v int")
    got = reshape.pivot(df, ["g"], "c", F.sum("v"))
    assert got.columns == ["g", "x", "y", "null"] and sorted(tuple(r) for r in got.collect()) == [("a", 1, 2, None), ("b", 3, None, 4)]
    with pytest.raises(reshape.TooManyColumns):
        reshape.pivot(df, ["g"], "c", F.sum("v"), most=2)
