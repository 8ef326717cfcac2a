import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from grainmill.operators import charts, cleaning, contract, counting, documents, gold, harmonise, invoices, metrics, phrases, profile, relabel
from grainmill.plans import console, medallion, versions
from grainmill.sources import files
from grainmill.sources.layers import Project

AS_OF = dt.date(2026, 7, 10)
SALES_CSV = """id_vente,date_vente,ville,produit,quantite,prix_unitaire,montant,note_satisfaction
V-1,01/07/2026,Casablanca,Thé,2,10,20,4
V-2,02/07/2026,Casblanca,Café,1,15,15,5
V-2,02/07/2026,Casblanca,Café,1,15,15,5
V-3,03/07/2026,Rabat,Thé,-1,10,abc,9
V-4,,Rabat,Café,3,15,45,3
V-5,05/07/2026,Rabat,Café,2,15,30,4
"""


@pytest.fixture
def project(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(SALES_CSV, encoding="utf-8")
    project = Project(spark, str(tmp_path / "store"), "p")
    run = medallion.run(project, str(path), AS_OF)
    return project, run, str(path)


def test_run_finds_the_known_faults_and_publishes_layers(spark, project):
    project, run, _ = project
    failing = {c["id"]: c["failing_rows"] for c in run["checks"]["bronze"] if c["status"] != "pass"}
    expected = {"table.no_duplicates": 1, "id_vente.unique": 1, "quantite.min": 1, "montant.type": 1, "note_satisfaction.max": 1, "date_vente.not_null": 1}
    assert expected.items() <= failing.items()
    consistent = next(c for c in run["checks"]["bronze"] if c["id"] == "ville.consistent")
    assert consistent["status"] == "fail" and "Casblanca → Casablanca" in consistent["detail"]
    bronze = project.read("bronze")
    assert bronze.count() == 6 and sorted(r[0] for r in bronze.select("_row_number").collect()) == [1, 2, 3, 4, 5, 6]
    first = bronze.where("_row_number = 1").first()
    assert first["id_vente"] == "V-1" and first["_source_file"] == "sales.csv"
    shares = project.read("gold_montant_by_produit").agg(F.sum("share_pct")).first()[0]
    assert abs(shares - 100) <= 0.2
    assert project.runs().count() == 1


def test_fixes_undo_and_reset(spark, project):
    project, _, path = project
    raw = files.read_csv(spark, path)
    assert versions.apply_batch(project, raw, ["drop_duplicates"], "dedup", AS_OF) == 1
    assert project.read("silver").count() == 5
    assert versions.undo(project, raw, AS_OF) and project.read("silver").count() == 6
    assert versions.batches(project).count() == 0


def test_console_gate(spark):
    tables = {"silver": spark.createDataFrame([(1, "a;b")], "n int, t string")}
    good = ["SELECT * FROM silver;", "WITH a AS (SELECT n FROM silver) SELECT * FROM a", "select replace(t, 'a', 'b') from silver", "select * from silver where t <> ';'"]
    for query in good:
        assert console.run_query(spark, tables, query).rows
    bad = ["", "DROP TABLE silver", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/tmp`", "INSERT INTO silver VALUES (1, 'x')", "SELECT * FROM other",
           "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM silver", "SELECT n FROM silver WHERE n IN (SELECT x FROM csv.`/etc/passwd`)", "SET a=b"]
    for query in bad:
        with pytest.raises(console.QueryRefused):
            console.check_query(spark, query, set(tables))
    wide = {"silver": spark.range(10).toDF("n")}
    result = console.run_query(spark, wide, "select n from silver order by n", limit=3)
    assert result.truncated and [r[0] for r in result.rows] == [0, 1, 2]


def test_medians_by_narrowing_equal_plain_medians(spark, monkeypatch):
    monkeypatch.setattr(counting, "MEDIAN_VALUES_PER_GROUP", 5000)
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.rand(7) * 1000).alias("v")).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    df = df.checkpoint()
    got = {r["g"]: r["median"] for r in counting.grouped_median(df, [F.col("g")], F.col("v"), ["g"]).collect()}
    rows = df.collect()
    for g in (0, 1, None):
        assert math.isclose(got[g], statistics.median(r["v"] for r in rows if r["g"] == g))
    assert math.isclose(counting.column_medians(df, {"v": F.col("v")})["v"], statistics.median(r["v"] for r in rows))


def test_variants_follow_the_greedy_order(spark):
    labels = ["casablanca"] * 5 + ["casablancaa"] * 3 + ["casablancaaa"] * 2 + ["Casablanca"] + ["rabat"] * 4 + ["Tanger", "tanger"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    found = {r["source"]: r["target"] for r in harmonise.variant_map(df, "label").collect()}
    assert found == {"casablancaa": "casablanca", "casablancaaa": "casablanca", "Casablanca": "casablanca", "tanger": "Tanger"}


def test_sales_repair_restores_consistency(spark):
    rows = [("2", "50", "0", "100", "Livrée", 4), ("3 unités", "58 MAD", "5%", "174", "Livrée", 5), ("0", "55", "999", "110", "Annulée", 9), ("2", "-24", "0", "48", "Livrée", None)]
    df = spark.createDataFrame(rows, "quantite string, prix_unitaire_mad string, remise_mad string, total_brut_mad string, statut_commande string, note_satisfaction int")
    from grainmill.operators.sales import repair_sales, sales_issue

    assert df.where(sales_issue(df)).count() == 3
    out = repair_sales(df, flag="changed").collect()
    for r in out:
        assert r["quantite"] > 0 and r["prix_unitaire_mad"] >= 0 and abs(r["quantite"] * r["prix_unitaire_mad"] - r["total_brut_mad"]) < 0.01
        assert 0 <= r["remise_mad"] <= r["total_brut_mad"] and 1 <= r["note_satisfaction"] <= 5
    assert [r["changed"] for r in out] == [False, True, True, True]


def test_profile_and_suggestions(spark):
    rows = [(" Casablanca ", "10,5", 5.0), ("Casablanca", "10,5", 5.0), ("Rabat", "20", None), (None, "30", 3.0), ("Rabat", "20", None)]
    df = spark.createDataFrame(rows, "ville string, montant string, note double")
    p = profile.table_profile(df).first()
    assert (p["rows"], p["missing"], p["duplicates"]) == (5, 3, 1)
    wanted = {"strip_text", "convert_numeric::montant", "fill_median::note"}
    assert wanted <= {r["id"] for r in cleaning.suggest_cleaning(df).collect()}
    cleaned, log = cleaning.apply_cleaning(df, wanted)
    assert log.count() == 3 and cleaned.where("note is null").count() == 0
    assert cleaned.where("ville = ' Casablanca '").count() == 0 and dict(cleaned.dtypes)["montant"] == "double"


def test_metrics(spark):
    rows = [(w, c, v) for w, c, v in zip(["S1", "S1", "S2", "S2", "S3", "S3"], ["En ligne", "Magasin"] * 3, [10, 20, 12, 20, 50, 22])]
    df = spark.createDataFrame(rows, "semaine string, canal string, ventes int")
    first = metrics.explain_spike(df, "semaine", "canal", "ventes").first()
    assert (first["focus"], first["focus_value"], first["focus_usual_value"], first["focus_difference"]) == ("S3", 72.0, 31.0, 41.0)
    assert (first["category"], first["value"], first["usual_value"], first["difference"]) == ("En ligne", 50.0, 11.0, 39.0)
    assert metrics.explain_spike(df.where("semaine = 'S1'"), "semaine", "canal", "ventes").count() == 0
    nums = spark.createDataFrame([(40,), (50,), (30,)], "v int")
    k = metrics.kpis(nums, [{"id": 1, "measure": "v", "target": 100}]).first()
    assert (k["value"], k["status"], k["gap_to_target"]) == (120.0, "target_reached", 0.0)
    brief = metrics.business_brief(spark.createDataFrame([("Café", "100,50"), ("Café", "50"), ("Thé", "-10"), ("Thé", "inconnu")], "produit string, montant string")).first()
    assert (brief["total"], brief["used_rows"], brief["excluded_rows"], brief["leader"]) == (140.5, 3, 1, "Café")


def test_charts(spark):
    df = spark.createDataFrame([("A", 2), ("A", 4), ("B", 5)], "application string, note int")
    assert {r["label"]: r["value"] for r in charts.grouped_chart(df, "application", "note", "mean").collect()} == {"B": 5.0, "A": 3.0}
    with pytest.raises(charts.ChartError):
        charts.grouped_chart(df, "missing")


def test_sale_lines(spark):
    docs = ["Pain 25,50\nTotal 100\nLait : 12.00", "Pain\n25,50\nLait\n18,00\nTotal\n43,50", "Ventes du 23109\nPain 12,50\nCaisse du 2409\nLait 18,00"]
    df = spark.createDataFrame([(i, d, [0.9, 0.99, 0.9, 0.97]) for i, d in enumerate(docs)], "doc int, text string, scores array<double>")
    rows = documents.sale_lines(df, "doc", "text", scores="scores").orderBy("doc", "line_no").collect()
    assert [(r["doc"], r["product"], r["amount"]) for r in rows] == [(0, "Pain", "25.50"), (0, "Lait", "12.00"), (1, "Pain", "25.50"), (1, "Lait", "18.00"), (2, "Pain", "12.50"), (2, "Lait", "18.00")]
    assert rows[4]["confidence"] == 0.99


def test_reading_lines_of_a_tilted_page(spark):
    a = math.radians(-4)
    boxes = []
    for row, pair in enumerate([("Sandwich", "25,00"), ("Jus orange", "15,00"), ("Eau", "5,00")]):
        for col, word in enumerate(pair):
            x, width = (100, 220) if col == 0 else (700, 120)
            y = 100 + row * 60 + (600 * math.tan(a) if col else 0)
            corners = [(x + cx * math.cos(a) - cy * math.sin(a), y + cx * math.sin(a) + cy * math.cos(a)) for cx, cy in ((0, 0), (width, 0), (width, 40), (0, 40))]
            boxes.append((1, len(boxes), *[float(v) for p in corners for v in p], word, 0.99))
    df = spark.createDataFrame(boxes, "page_id int, box_id int, " + ", ".join(f"{c}{i} double" for i in range(4) for c in "xy") + ", text string, score double")
    lines = documents.reading_lines(df).orderBy("island", "line").collect()
    assert [r["text"] for r in lines] == ["Sandwich 25,00", "Jus orange 15,00", "Eau 5,00"]


def test_invoices(spark):
    texts = [
        "\nACME Maroc SARL\nFACTURE N° FA-2026-001\nDate de facture : 17/07/2026\nSous-total HT : 1 000,00 MAD\nTVA 20 % : 200,00 MAD\nTOTAL TTC : 1 200,00 MAD\nMerci",
        "Supplier: Northwind Traders Ltd\nInvoice Number: INV/734-A\nInvoice date: 2026-07-05\nVAT 15%: EUR 30.00\nAmount due: EUR 230.00",
        "Merci pour votre confiance.\nÀ bientôt !", "Fournisseur : Atlas Services SARL\nFacture N° A-42\nDate facture : 31/02/2026",
        "Date facture : 17 juillet 2026\nNet à payer : 2 880,00 DH", "Facture N° FAC-7\nDate d'échéance : 30/08/2026\nTotal TTC : 500 MAD", "Grand total: $ 120.00", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    finds = invoices.invoice_finds(df, "doc", "text")
    t = {r["doc"]: r for r in invoices.invoice_table(finds, "doc").collect()}
    assert [t[0][c] for c in ("fournisseur", "numero_facture", "date_facture", "total_ht", "tva", "total_ttc", "devise", "taux_tva")] == [
        "ACME Maroc SARL", "FA-2026-001", "2026-07-17", 1000.0, 200.0, 1200.0, "MAD", 20.0]
    assert [t[1][c] for c in ("fournisseur", "numero_facture", "date_facture", "tva", "total_ttc", "devise")] == ["Northwind Traders Ltd", "INV/734-A", "2026-07-05", 30.0, 230.0, "EUR"]
    assert t[2]["etat"] == "À compléter" and t[3]["date_facture"] is None and t[3]["fournisseur"] == "Atlas Services SARL"
    assert (t[4]["date_facture"], t[4]["total_ttc"], t[4]["numero_facture"]) == ("2026-07-17", 2880.0, None)
    assert t[5]["date_facture"] is None and (t[6]["total_ttc"], t[6]["devise"]) == (120.0, "$")
    assert {r["doc"]: r["status"] for r in invoices.invoice_review(finds, "doc").collect()}[7] == "no_text"


def test_phrases_and_chart_specs(spark):
    catalogue = [("Date_vente", "date"), ("Chiffre_affaires", "number"), ("Région", "category"), ("Produit", "category")]
    df = spark.createDataFrame([(1, "total du chiffre d'affaires par région"), (2, "Clients à Casablanca"), (3, "CA par zone commerciale")], "id int, text string")
    spec = phrases.chart_specs(df.where("id = 1"), ["id"], "text", catalogue).first()
    assert (spec["dimension"], spec["measure"], spec["aggregation"]) == ("Région", "Chiffre_affaires", "sum")
    found = phrases.resolve_columns(df, ["id"], "text", catalogue, {"Région": ["zone commerciale"]}).collect()
    assert {(r["id"], r["column_name"]): r["confidence"] for r in found if r["id"] != 1} == {(3, "Région"): 0.95, (3, "Chiffre_affaires"): 0.85}


def test_renames_and_relabels(spark):
    df = spark.createDataFrame([("Casa", 1), ("Casablanca", 2), (None, 3)], "A string, B int")
    assert relabel.rename_columns(df, {"A": "B", "B": "A"}).columns == ["B", "A"]
    with pytest.raises(relabel.RelabelError):
        relabel.rename_columns(df, {"A": "b"})
    merge = spark.createDataFrame([("Casa", "Casablanca")], "source string, target string")
    with pytest.raises(relabel.RelabelError):
        relabel.relabel(df, "A", merge)
    assert relabel.relabel(df, "A", merge, allow_merge=True).where("A = 'Casablanca'").count() == 2
    missing = spark.createDataFrame([(None, "x")], "source string, target string")
    assert relabel.relabel(df, "A", missing).where("A = 'x'").count() == 1
    with pytest.raises(relabel.RelabelError):
        relabel.relabel(df, "A", spark.createDataFrame([("Oujda", "x")], "source string, target string"))


def test_scans(spark, tmp_path):
    path = tmp_path / "orders.json"
    path.write_text('{"data":[{"order_id":1,"customer":{"city":"Fès"},"tags":[1,2]},{"order_id":2,"customer":{"city":"Rabat"},"tags":[]}]}', encoding="utf-8")
    df = files.read_dataset(spark, str(path))
    assert set(df.columns) == {"order_id", "customer.city", "tags"} and df.count() == 2
    legacy = tmp_path / "old.csv"
    legacy.write_bytes("nom;prix\nThé;1,5\nCafé €;2\n".encode("cp1252"))
    assert [r["nom"] for r in files.read_csv(spark, str(legacy)).collect()] == ["Thé", "Café €"]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.read_csv(spark, str(bad)).collect()
    with pytest.raises(files.ScanError):
        files.guard(spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a"))
    note = tmp_path / "note.txt"
    note.write_bytes("Thé 12,50".encode("cp1252"))
    assert files.read_text_documents(spark, str(note)).first()["text"] == "Thé 12,50"
