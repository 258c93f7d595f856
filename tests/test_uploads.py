"""Uploads, settings, lookups, signatures and ranges on small cases."""

import base64

import numpy as np
from pyspark.sql import functions as F
from tallylens.operators import layout, pages, records, results, rollups, rules, uploads
from tallylens.sources import universe

from .test_pages import SCHEMA, page


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_evidence_and_gate(spark):
    content = bytes(range(200))
    rows = [(1, "m", content, 0.5, 0.6, 0.7, 0.6), (2, None, b"", 0.5, 0.6, 0.7, 0.61), (3, "m", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "upload_id long, mesa_key string, content binary, grosor double, separador double, tinta double, score double")
    got = {r.upload_id: r for r in uploads.evidence_rows(df).collect()}
    assert got[1].imagen_url == "data:image/png;base64," + base64.b64encode(content).decode()[:100] + "..."
    assert got[2].imagen_url == "data:image/png;base64,..." and (got[2].status, got[2].message) == ("error", "mesa_key missing")
    assert (got[1].status, got[1].message, got[1].estado_revision) == ("saved", None, "pendiente") and len(got[1].id) == 36
    assert {r.status for r in uploads.evidence_rows(df, stored=False).collect()} == {"skipped"}
    gate = {r.upload_id: (r.enqueued, r.reason) for r in uploads.gated(df).collect()}
    assert gate[1] == (False, "score_global=0.60 ≤ umbral 0.6") and gate[3] == (False, "score_global=none ≤ umbral 0.6")
    assert gate[2][0] and gate[2][1].startswith("Encolado en cola_procesamiento slot=")
    queue = uploads.second_layer(df).collect()
    assert [(r.capa_actual, r.estado_slot, r.evidence_id) for r in queue] == [(2, "pendiente", got[2].id)]


def test_settings_and_ids(spark):
    old = spark.createDataFrame([("umbral_min_votos", "5"), ("x", "1")], "clave string, valor string")
    changes = spark.createDataFrame([("umbral_min_votos", "6", 1), ("umbral_min_votos", "7", 2), ("capa1_score_revision", "0.7", 1), ("hack", "1", 1), (None, "1", 1)], "clave string, valor string, at int")
    after, refused = uploads.settings(old, changes)
    assert plain(after) == [("capa1_score_revision", "0.7"), ("umbral_min_votos", "7"), ("x", "1")]
    assert sorted((r.clave or "", r.reason) for r in refused.collect()) == [("", "Clave no permitida"), ("hack", "Clave no permitida")]
    assert plain(uploads.setting_values(after, spark.createDataFrame([("x",), ("y",)], "clave string"))) == [("x", "1"), ("y", "")]
    r = spark.range(1).select(uploads.anonymous_voter(F.lit("abc"), F.lit(1)).alias("a"), uploads.anonymous_voter(F.lit(None).cast("string"), F.lit(1)).alias("b"), uploads.per_cent(F.lit(0.1234)).alias("p")).first()
    assert r.a == "anon-abc" and len(r.b) == 36 and r.b.startswith("anon-") and r.p == "12.3%"


def test_lookups_reports_and_listing(spark):
    slots = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, mesa_key string")
    fixtures = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first")], "mesa_key string, number int, note string")
    got = {r.id: (r.success, r.fixture.note if r.fixture else None, r.error) for r in uploads.looked_up(slots, fixtures).collect()}
    assert got == {1: (True, "first", None), 2: (False, None, "No fixture for z"), 3: (False, None, "No fixture for none")}
    jobs = spark.createDataFrame([("d", "success", 5, None), ("d", "error", 7, "e"), ("d", "error", None, "e"), ("d", "skipped", 9, None)], "dep string, status string, size long, error string")
    counts, errors = uploads.batch_report(jobs, ["dep"], "status", "size", "error")
    assert plain(counts) == [("d", 1, 2, 1, 5)] and plain(errors) == [("d", "e", 2)]
    queue = spark.createDataFrame([(1, 2, "error", 5, "x" * 200), (2, 1, "pendiente", 9, None), (3, 1, "odd", 1, None), (4, 1, "pendiente", 3, "")], "id long, capa int, estado string, creado_en int, ultimo_error string")
    listed = uploads.queue_listing(queue).collect()
    assert [r.id for r in listed] == [3, 4, 2, 1] and listed[0].icon == "❓" and len(listed[3].ultimo_error) == 120
    tables = spark.createDataFrame([(1, "h"), (2, "g"), (3, None)], "id long, sha256 string")
    files = spark.createDataFrame([("h", "b"), ("h", "a")], "sha256 string, path string")
    assert [(r.id, r.path, r.error) for r in results.stored_files(tables, files).orderBy("id").collect()] == [(1, "a", None), (2, None, "PDF not in acquisition storage: sha256=g"), (3, None, "No PDF available for table 3")]


def test_signatures(spark):
    """Golden states at the edges of both thresholds, and boxes cut from a page."""
    cases = {(0.15, 0.2, 0.9): ("COMPLETE", 3, "LOW"), (0.15, 0.15, 0.0499): ("INCOMPLETE", 2, "CRITICAL"), (0.15, 0.1499, 0.05): ("INCOMPLETE", 1, "MEDIUM"), (0.0, 0.0, 0.0): ("EMPTY", 0, "CRITICAL"), (0.05, 0.05, 0.05): ("EMPTY", 0, "MEDIUM")}
    df = spark.createDataFrame([(list(k),) for k in cases], "d array<double>")
    for r in df.select("d", rules.signature_result(F.col("d")).alias("x")).collect():
        assert (r.x.status, r.x.found, r.x.max_risk) == cases[tuple(r.d)] and r.x.confidence == round(r.x.found / 3, 4)
    sheet = np.full((100, 100), 255, np.uint8)
    sheet[62:72, 15:26] = 0  # half of the first box of 22 x 10
    sheet[62:64, 40:62] = 0
    got = pages.signature_ink(spark.createDataFrame([page(sheet), page(np.full((100, 100), 255, np.uint8), 2)], SCHEMA)).orderBy("sheet").collect()
    assert [list(r.densities) for r in got] == [[0.5, 0.2, 0.0], [0.0, 0.0, 0.0]]


def test_fixed_cells(spark):
    """Boxes are cut off at the border; pages without cells give no rows."""
    sheet = np.full((50, 60), 255, np.uint8)
    sheet[30:] = 0
    boxes = {1: {"a": (0, 0, 20, 20), "b": (40, 30, 40, 40), "c": (60, 0, 9, 9)}}
    rows = spark.createDataFrame([page(sheet), page(sheet, 2, 3)], SCHEMA)
    got = {r.campo: r for r in pages.cell_scores(rows, boxes).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert (got["a"].tinta, got["b"].tinta, got["c"].tinta, got["c"].score) == (0.0, 1.0, 0.0, 0.0)
    assert got["b"].grosor == 1.0  # ink throughout has no edge, so it is as thick as can be
    assert abs(got["b"].score - (0.3 * got["b"].grosor + 0.4 * got["b"].separador + 0.3)) < 1e-12


def test_ranges_zoom_and_readings(spark):
    bad = spark.range(1).select(rules.vote_ranges(F.lit(1.01), F.lit(5.0), F.repeat(F.lit("x"), F.lit(501)), F.lit(-1), F.lit(None).cast("int"), F.lit(100)).alias("x")).first().x
    assert bad == ["score", "comentario", "tolerancia"]
    zoom = spark.range(1).select(pages.render_zoom(F.lit(72.0), F.lit(72.0)).alias("a"), pages.render_zoom(F.lit(7200.0), F.lit(7200.0), most=9.0).alias("b"), pages.render_zoom(F.lit(7200.0), F.lit(7200.0), most=0).alias("c")).first()
    assert np.allclose(list(zoom), [300 / 72, 300 / 72 * (9 / 900) ** 0.5, 300 / 72])
    lines = spark.createDataFrame([(1, [("x", 0.99), ("a12", 0.4), ("7", 0.3)]), (2, [("x", 0.9)]), (3, None)], "id int, l array<struct<text:string,conf:double>>")
    assert [(r.x.digit, r.x.confidence) for r in lines.orderBy("id").select(records.slot_reading(F.col("l")).alias("x")).collect()] == [(7, 0.4), (None, 0.0), (None, 0.0)]
    raw = spark.createDataFrame([('{"transmissioncodes": [1, "b", {}]}',), ("{}",), ("x",), (None,)], "value string")
    assert [r.entries for r in universe.list_size(raw).collect()] == [3, 0, 0, 0]


def test_keywords_columns_and_parents(spark):
    rows = spark.createDataFrame([(1, 3, "sum TOTAL"), (1, 2, "otros votos"), (2, 1, "none")], "page long, id long, text string")
    assert plain(layout.first_keyword(rows, "page", ["Votos", "total"])) == [(1, 2, "otros votos")]
    found = spark.createDataFrame([(10, 5, "a1", 0.3), (10, 5, "b", 0.9), (10, 5, "2", 0.29)], "x int, y int, text string, conf double")
    got = layout.digit_regions(found, F.lit(20), F.lit(5), F.lit(-4), F.lit(50), F.lit(100), F.lit(100))
    assert plain(got) == [(10, 5, "a1", 0.3)]
    assert layout.digit_regions(found, F.lit(500), F.lit(5), F.lit(0), F.lit(50), F.lit(100), F.lit(100)).count() == 0
    sheets = spark.createDataFrame([(1, 5, None), (2, 6, 2), (3, 7, 1)], "id long, suma int, capa_maxima int")
    flags = spark.createDataFrame([(1, 50, True), (2, 60, False)], "id long, suma int, excede boolean")
    assert plain(results.parents_updated(sheets, flags)) == [(1, 50, 0, True), (2, 60, 2, False), (3, 7, 1, None)]


def test_calibration(spark):
    grid = rollups.confusion(spark.createDataFrame([(10, True), (20, False), (30, True), (40, True)], "score long, bad boolean"), spark.range(5, 50, 5).withColumnRenamed("id", "t"))
    rows = {r.t: r for r in grid.collect()}
    assert (rows[25].precision, rows[25].recall, rows[25].accuracy) == (1.0, 2 / 3, 0.75) and (rows[45].precision, rows[45].recall) == (0.0, 0.0)
    assert rollups.best_threshold(grid).first().t == 5  # the first of the greatest f1
    assert [(r.t, r["rank"]) for r in rollups.best_thresholds(grid, 3).orderBy("rank").collect()][:2] == [(5, 1), (10, 2)]
    assert rollups.best_threshold(grid.where("f1 = 0")).count() == 0
    scores = spark.createDataFrame([("a.pdf", 1), ("b.pdf", 2)], "filename string, score int")
    assert plain(rollups.labelled_scores(scores, spark.createDataFrame([("a", "legitima")], "filename string, label string"))) == [("a.pdf", 1, "legitima")]
