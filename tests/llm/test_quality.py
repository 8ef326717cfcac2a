"""The model of the quality rules: bands against labels, files against the table."""

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm.quality import gram_counts, kneser_ney, language, model_files, quality_rules, scorer


def test_bands_reject_bad_documents_and_keep_good_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    found = quality_rules(docs.select("doc_id", "text", "lang")).where("not base_failed").join(labels, "doc_id")
    counts = {r.quality: (r.n, r.gone) for r in found.groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()}
    assert 3 * counts[0][1] >= counts[0][0] and 20 * counts[1][1] <= counts[1][0]


def test_text_without_a_whole_gram_is_not_kept(docs):
    texts = [(k, " ".join(f"word{(k * j) % 7} and more" for j in range(20))) for k in range(10)]
    found = {r.doc_id: r for r in quality_rules(docs([*texts, (99, " ".join("a\0" for _ in range(8)) + " " + " ".join(f"{k}\0" for k in range(30)))])).collect()}
    assert not found[99].base_failed and found[99].log_ppl is None and not found[99].kept


def test_scores_from_files_equal_the_table(spark):
    rows = [(k, " ".join(f"{a}{k * j % 11}" for j in range(40)), lang) for k, (a, lang) in enumerate([("été", "fr"), ("to", "en"), ("ein", "de"), ("x", None)] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    table = kneser_ney(gram_counts(docs)).cache()
    log_p = {(r.language, r.gram): r.log_p for r in table.collect()}
    sums = {}
    for (lang, gram), v in log_p.items():
        sums[lang, gram >> 8] = sums.get((lang, gram >> 8), 0) + np.exp(v)
    assert len({lang for lang, _ in log_p}) == 4 and all(0 < s < 1.0001 for s in sums.values())
    folder, files = model_files(table, file_grams=50)
    assert len(files) > 8 and sum(r.n for r in files) == len(log_p)
    score = scorer(folder, files, 5)
    for _, text, lang in rows:
        stream = f" {text} ".encode()
        logs = [log_p[language(lang), int.from_bytes(stream[k : k + 5], "big")] for k in range(len(stream) - 4)]
        assert abs(score(text.encode().split(), lang) + sum(logs) / len(logs)) < 1e-5


def by_hand(texts, order):
    """The model of one language as dictionaries: last byte after the others, interpolated, with discounts from counts of counts."""
    full = {}
    for text in texts:
        stream = b" " + b" ".join(text.encode().split()) + b" "
        for k in range(len(stream) - order + 1):
            g = stream[k : k + order]
            full[g] = full.get(g, 0) + 1
    levels = {order: full}
    for k in range(1, order):
        counts = {}
        for longer in {g[-k - 1 :] for g in full}:
            counts[longer[1:]] = counts.get(longer[1:], 0) + 1
        levels[k] = counts
    p = {}
    for k in range(1, order + 1):
        n = [0, *(sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 for i in (1, 2, 3)]
        total, given = {}, {}
        for g, c in levels[k].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            given[g[:-1]] = given.get(g[:-1], 0) + d[min(c, 3) - 1]
        for g, c in levels[k].items():
            below = p[g[1:]] if k > 1 else 1 / 256
            p[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + given[g[:-1]] / total[g[:-1]] * below
    return {g: v for g, v in p.items() if len(g) == order}


def test_probabilities_equal_a_model_written_out_by_hand(spark):
    texts = {"en": ["the cat sat on the mat and the dog sat too", "a cat, a dog; the end", "the the the"] * 2 + ["a rare word"], "fr": ["été à la mer été", "le chat dort", "l'été"], None: ["zz zz z"]}
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own)]
    got = {(r.language, r.gram): r.log_p for r in kneser_ney(gram_counts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 4), 4).collect()}
    want = {(language(lang), int.from_bytes(g, "big")): np.log(v) for lang, own in texts.items() for g, v in by_hand(own, 4).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
