"""Lines are dealt out to be matched, however small Spark takes them for; none is broadcast."""

import re

from grainmill.operators import scoring


def test_lines_are_never_broadcast(spark, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    checkpointed = scoring.saved
    monkeypatch.setattr(scoring, "saved", planned)
    columns = "doc_id bigint, line_no int, product string, amount string"
    expected = spark.createDataFrame([(1, 1, "Pains", "2"), (1, 2, "Lait", "3,5"), (2, 1, "Zzyzx", "7")], columns)
    found = spark.createDataFrame([(1, 4, "Pain", "2"), (1, 5, "LAIT", "3.5"), (3, 1, "Huile", "1")], columns)
    scores = scoring.accuracy(expected, found)
    assert {r.doc_id: (r.rows_found, r.exact_amounts, r.extra_rows) for r in scores.collect()} == {1: (2, 2, 0), 2: (0, 0, 0), 3: (0, 0, 1)}
    plans.append(scores._jdf.queryExecution().executedPlan().toString())
    # Only the counts of letters, one row for each letter, are sent to all tasks.
    broadcast = [keys for plan in plans for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)]
    assert broadcast and all(keys.startswith("letter#") for keys in broadcast)
    assert not any("BroadcastNestedLoopJoin" in plan for plan in plans)
