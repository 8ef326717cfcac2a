"""Faults once found: each stays mended."""

import datetime as dt
import hashlib

import pytest

from grainmill.operators import charts, counting, profile, roles
from grainmill.plans import versions
from grainmill.sources import files
from grainmill.sources.layers import Project, utc_now


def test_json_lines_keep_every_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "v": "x"}\n\n{"k": 2, "v": "y"}\n{"k": 3, "v": "z"}\n')
    assert sorted(r.k for r in files.read_json(spark, str(tmp_path / "a.json")).collect()) == [1, 2, 3]
    (tmp_path / "b.json").write_text('[{"k": 1},\n {"k": 2}]')
    assert files.read_json(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.json").write_text('{"k": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "c.json")).collect()


def test_json_kinds_of_one_folder(spark, tmp_path):
    folder = tmp_path / "mixed 1%.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"data": [{"k": 1, "v": {"w": "x"}}, {"k": 2}]}')
    (folder / "b.json").write_text('\ufeff\n{"k": 3, "v": {"w": "z"}}\n{"k": 4}\n', encoding="utf-8")
    (folder / "c.json").write_text('[\n{"k": 5, "data": [7]}]')
    (folder / "d.json").write_text('{"k": 6}')
    (folder / "e.json").write_text('{\n"data": []}')
    got = files.read_json(spark, str(folder))
    assert sorted(got.columns) == ["data", "k", "v.w"]
    assert sorted((r["k"], r["v.w"], r["data"]) for r in got.collect()) == [(1, "x", None), (2, None, None), (3, "z", None), (4, None, None), (5, None, "[7]"), (6, None, None)]


def test_json_documents_of_one_object_on_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.json").write_text(f'{{"records": [{{"k": {k}}}]}}')
    assert sorted(r.k for r in files.read_json(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_quoted_line_breaks_through_the_public_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"two\nlines",1\nplain,2\n')
    assert [r.name for r in files.read_dataset(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("n").collect()] == ["two\nlines", "plain"]


def test_fingerprint_covers_all_parts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"p{k}.csv").write_text(f"a\n{k}\n")
    before = files.fingerprint(spark, str(tmp_path / "t")).collect()
    assert len(before) == 1 and before[0].file == "t" and before[0].bytes == 12
    (tmp_path / "t" / "p2.csv").write_text("a\n9\n")
    assert files.fingerprint(spark, str(tmp_path / "t")).first().sha256 != before[0].sha256


def test_fingerprint_needs_no_cell_for_a_file(spark, tmp_path):
    folder = tmp_path / "a b %20é"
    folder.mkdir()
    (folder / "x y.bin").write_bytes(bytes(range(256)) * 40_000)
    # Beyond this many bytes Spark refuses to make a cell of a file; it can be lowered, but not raised over 2 GB.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        row = files.fingerprint(spark, str(folder / "x*")).first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert (row.file, row.sha256, row.bytes) == ("x y.bin", hashlib.sha256(bytes(range(256)) * 40_000).hexdigest(), 10_240_000)


def test_nulls_inside_nested_values_tell_rows_apart(spark):
    df = spark.sql("select array(1, null) v union all select array(null, 1) union all select array(1, null)")
    assert df.select(counting.duplicate_rows(df).alias("n")).first().n == 1


def test_bins_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "v double")
    assert [r.rows for r in charts.histogram(df, "v").orderBy("bin").collect()][0] == 20
    assert {r.bin for r in charts.cut_bins(df, "v").collect()} == {1}


def test_reset_withdraws_every_batch(spark, tmp_path):
    project = Project(spark, str(tmp_path), "p")
    for k in range(23):
        row = {"batch_id": f"b{k:02}", "applied_at": utc_now(), "label": "x", "actions": ["a"], "before": None, "after": "v", "log": [], "undone": False}
        versions._append(project, "batches", row, versions.BATCH_SCHEMA)
    assert versions.batches(project).count() == 23
    raw = spark.createDataFrame([("x", 1.0)], "city string, amount double")
    project.save(raw, "bronze")
    versions.reset(project, raw, dt.date(2024, 1, 1))
    assert versions.batches(project).count() == 0
    assert not versions.undo(project, raw, dt.date(2024, 1, 1))


def test_roles_by_first_rule():
    assert [roles.label_role(c) for c in ("Ville", "Type client", "canal_vente", "Catégorie", "montant")] == ["city", "customer_type", "channel", "category", None]
    assert roles.can_fill_with_mode("Mode paiement") and not roles.can_fill_with_mode("nom client") and not roles.can_fill_with_mode("montant")
    assert all(map(roles.is_id, ("id", "order_id", "id_client", "SKU produit"))) and not roles.is_id("montant")


def test_entity_column_by_best_rank():
    assert profile.entity_column(["montant", "client_name", "client_id"], "combien de clients ?") == "client_id"
    assert profile.entity_column(["montant"], "total des ventes") is None
