"""Words of a lateral subquery are joined back to their rows without a sort of words that carry whole texts."""

from grainmill.plans import console

QUERY = """select id, count(*) as words, max(w.place) as last_place from notes,
lateral (select place from posexplode(split(text, ' ')) as t(place, word) where word <> '') w group by id"""


def test_lateral_words_are_not_sorted(spark):
    rows = [(i, " ".join(f"w{i % 7}{k}" for k in range(1 + i % 50))) for i in range(400)] + [(1000, None), (1001, ""), (1001, "a  b")]
    frame = spark.createDataFrame(rows, "id int, text string")
    names = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names[1:]:
            spark.conf.set(name, "-1")
        found = console.query_frame(spark, {"notes": frame}, QUERY)
        counts = {r["id"]: (r["words"], r["last_place"]) for r in found.collect()}
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert counts == {**{i: (1 + i % 50, i % 50) for i in range(400)}, 1001: (2, 2)}
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final
