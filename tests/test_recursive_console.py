import pytest

from grainmill.plans import console

TREE = """with recursive tree (k, depth) as (select id, 0 from part where id = 1
union all select p.id, t.depth + 1 from part p join tree t on floor(p.id / 4) = t.k where p.id > 3) select count(*) as n, max(depth) as deepest from tree"""


def test_recursion_over_more_rows_than_sparks_limit(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    try:
        spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
        found = console.query_frame(spark, {"part": spark.range(1, 400)}, TREE).first()
        assert (found.n, found.deepest) == (229, 4)
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_endless_recursion_still_ends(spark):
    endless = "with recursive r (k) as (select id from one union all select k + 1 from r) select max(k) as m from r"
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        console.query_frame(spark, {"one": spark.range(1)}, endless).collect()
