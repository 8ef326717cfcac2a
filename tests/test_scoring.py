import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from grainmill.operators import scoring


def greedy(expected, found):
    """Expected lines in order, each with the best proposal left."""
    left, pairs = list(found), []
    for number, name, _ in expected:
        best, ratio = None, 0.0
        for row in left:
            r = SequenceMatcher(None, row[1], name).ratio()
            if r > ratio:
                best, ratio = row, r
        if best is not None and ratio >= 0.6:
            left.remove(best)
            pairs.append((number, best[0]))
    return pairs


def documents(seed, n, lines):
    rng = random.Random(seed)
    names = ["pain", "pains", "pin", "huile", "huile olive", "lait", "laits", "cafe", "cafe noir", "the", "a", "ab", ""]
    make = lambda: [(k * 3 + 1, rng.choice(names), round(rng.random() * 9, 2)) for k in range(rng.randint(0, lines))]
    return {d: (make(), make()) for d in range(n)}


def frames(spark, docs):
    kind = "doc_id bigint, line_no int, product string, amount string"
    return [spark.createDataFrame([(d, n, p, str(a)) for d, pair in docs.items() for n, p, a in pair[side]], kind) for side in (0, 1)]


def test_matches_equal_the_greedy_loop(spark):
    docs = documents(3, 40, 12)
    docs[99] = [(k, "pain", 1.0) for k in range(1, 60)], [(k, "pain", 1.0) for k in range(1, 50)]
    expected, found = frames(spark, docs)
    got = sorted((r.doc_id, r.expected_line, r.found_line) for r in scoring.matched_lines(expected, found).collect())
    assert got == sorted((d, *p) for d, (e, f) in docs.items() for p in greedy(e, f))
    assert len(got) > 100


def test_running_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PART_LINES", 7)
    docs = documents(5, 6, 40)
    expected, found = frames(spark, docs)
    got = sorted((r.doc_id, r.expected_line, r.found_line) for r in scoring.matched_lines(expected, found).collect())
    assert got == sorted((d, *p) for d, (e, f) in docs.items() for p in greedy(e, f))


def test_accuracy(spark):
    docs = {1: ([(1, "Thé vert", 2.0), (2, "Pain", 1.5), (3, "Zzz", 4.0)], [(1, "PAIN ", 1.5), (2, "the  vert", 2.1), (3, "riz", "9,5")]), 2: ([], [(1, "x", "y")]), 3: ([(1, "x", 1.0)], [])}
    got = {r.doc_id: tuple(r)[1:] for r in scoring.accuracy(*frames(spark, docs)).collect()}
    assert got == {1: (3, 3, 2, 66.7, 1, 33.3, 1, 7.5, 13.1), 2: (0, 1, 0, None, 0, None, 1, 0.0, 0.0), 3: (1, 0, 0, 0.0, 0, 0.0, 0, 1.0, 0.0)}
    empty = [df.limit(0) for df in frames(spark, docs)]
    assert scoring.accuracy(*empty).count() == 0


def test_lines_are_read_once(spark):
    """The matching, the comparison and the totals share one reading of the lines."""
    read = spark.sparkContext.accumulator(0)

    def cost(text):
        read.add(1)
        return text

    found = spark.createDataFrame([("d", 1, "pain", "2"), ("d", 2, "lait", "3"), ("e", 1, "eau", "4")], "doc_id string, line_no int, product string, amount string")
    expected = found.where("line_no = 1")
    costly = found.withColumn("product", F.udf(cost, "string")("product"))
    scores = {r.doc_id: (r.rows_found, r.extra_rows, r.proposed_total) for r in scoring.accuracy(expected, costly).collect()}
    assert scores == {"d": (1, 1, 5.0), "e": (1, 0, 4.0)}
    assert read.value == 3
