"""JSON documents, results with children, downloads, copies and reviews: small cases and repeated runs."""

import json

from pyspark.sql import functions as F
from tallylens.operators import mutate, records, results, reviews, rollups, variants
from tallylens.sources import universe

RESULT = """table_id long, pdf_sha256 string, signature_status string, densities array<double>, signature_risk int, page1 double, page2 double,
 candidates array<struct<number:int,votes:long,confidence:double>>, summary struct<total_votes:long,blank_votes:long,null_votes:long,unmarked_votes:long>,
 anomalies array<struct<rule:string,page:int>>, risk_score double, risk_level string"""


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents(spark):
    raws = [None, "", "{", '{"a": 1}', '{"k": null}', '{"k": {"x": [1]}, "z": "ñ"}', '["k"]', '"k"', "null", '{"other": {"k": 1}}']
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = dict(plain(variants.pending(rows, "raw", "k").select("id", "pending")))
    assert got == {0: "empty", 1: "empty", 2: "malformed", 3: "no key", 6: "no object", 7: "no object", 8: "no object", 9: "no key"}
    merged = dict(rows.select("id", variants.with_key(F.col("raw"), "k", F.lit('{"n": 7}')).alias("m")).collect())
    assert {k: json.loads(v) for k, v in merged.items() if v} == {3: {"a": 1, "k": {"n": 7}}, 4: {"k": {"n": 7}}, 5: {"k": {"n": 7}, "z": "ñ"}, 9: {"other": {"k": 1}, "k": {"n": 7}}}
    good, bad = variants.split_malformed(rows, "raw")
    assert sorted(r.id for r in bad.collect()) == [1, 2]
    assert good.count() == 8


def test_cells(spark):
    raws = ['{"cells": [{"idx": 1, "score": 0.5, "new": []}, {"idx": "x"}, 3, null], "p": 1}', '{"cells": {}}', "{", None, '{"cells": []}']
    rows = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    assert plain(variants.sheet_cells(rows, "raw", {"idx": "int", "score": "double"}, "id")) == [(0, 0, 1, 0.5), (0, 1, None, None), (0, 2, None, None), (0, 3, None, None)]
    assert plain(variants.cell_counts(rows, "raw", "id")) == [(0, 4), (1, 0), (2, 0), (3, 0), (4, 0)]
    many = spark.createDataFrame([(json.dumps({"cells": [{"s": s} for s in (0.1, 0.9, None, 0.9, 0.5, 0.2, 0.3)]}),)], "raw string")
    assert variants.top_cells(many, "raw", "p", "s").first().p == [1, 3, 4, 6, 5]


def result(k, anomalies):
    return (k, f"h{k}", "COMPLETE", [0.2, 0.1, 0.15], 0, 0.5, 0.75, [(1, 10, 0.5)], (11, 1, 0, 0), anomalies, 3.5, "LOW")


def test_persist_twice_and_again(spark, tmp_path):
    """A repeated batch replaces itself; another stays; sheets without an analysis get a failure row, once."""
    folder = str(tmp_path)
    rows = spark.createDataFrame([result(1, [("A", 1), ("B", 2)]), result(2, [])], RESULT)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,)], "table_id long")
    for _ in range(2):
        results.persist(rows, folder, "b1", wanted)
    results.persist(spark.createDataFrame([result(9, [("C", 1)])], RESULT), folder, "b2")
    parents, kids = (spark.read.parquet(f"{folder}/{n}") for n in ("parents", "children"))
    got = {(r.batch, r.table_id): r for r in parents.collect()}
    assert sorted(got) == [("b1", 1), ("b1", 2), ("b1", 3), ("b2", 9)] and parents.count() == 4
    one, failed = got["b1", 1], got["b1", 3]
    assert (one.signatures_found, one.signatures_expected, one.ocr_confidence, one.anomaly_count, one.math_valid, json.loads(one.candidate_votes)) == (2, 3, 0.625, 2, False, {"1": 10})
    assert (failed.pdf_sha256, failed.risk_score, failed.risk_level, failed.anomaly_count, failed.math_valid, failed.total_votes) == ("ERROR", 100.0, "CRITICAL", 1, False, None)
    assert plain(kids.select("batch", "table_id", "place", "rule")) == [("b1", 1, 0, "A"), ("b1", 1, 1, "B"), ("b2", 9, 0, "C")]
    assert {r.analysis_id for r in kids.collect()} <= {r.analysis_id for r in parents.collect()}
    tables = spark.createDataFrame([(1, None, None), (7, "HIGH", 60.0)], "id long, risk_level string, risk_score double")
    assert plain(results.with_risk(tables, parents)) == [(1, "LOW", 3.5), (7, "HIGH", 60.0)]


def test_downloads(spark):
    tables = spark.createDataFrame([(1, "pending", None, None, None, "old"), (2, "pending", None, None, 4, None), (3, "cached", "h", 5, 1, None)], "id long, status string, sha256 string, size long, download_count long, last_error string")
    files = spark.createDataFrame([(1, "a", 10)], "table_id long, sha256 string, size long")
    log = spark.createDataFrame([(1, 1, True, "a", 11, None), (1, 2, True, "b", 12, None), (1, 3, False, None, None, "late"), (2, 1, False, None, None, "e1"), (2, 5, False, None, None, "e5")], "table_id long, at long, ok boolean, sha256 string, size long, error string")
    new, kept = results.downloaded(tables, files, log)
    assert plain(new) == [(1, "cached", "b", 12, 2, None), (2, "error", None, None, 4, "e5"), (3, "cached", "h", 5, 1, None)]
    assert plain(kept) == [(1, "a", 10), (1, "b", 12)]
    tries = spark.createDataFrame([(1, 1, "u1", 404, 99999), (1, 2, "u2", 200, 10000), (1, 3, "u3", 200, 10001), (1, 4, "u4", 200, 20000), (2, 1, "u1", None, None)], "t long, place int, url string, status int, size long")
    assert plain(results.first_success(tries, "t")) == [(1, 3, "u3", 10001, 4), (2, None, None, None, 1)]


def test_dense_ids_over_blocks(spark, monkeypatch):
    keys = [-70000, -1, 0, 5, 65535, 65536, 65537, 10**9, 10**12]
    df = spark.createDataFrame([(k,) for k in keys[::-1]], "id long")
    want = list(zip(keys, range(1, 10)))
    assert sorted(tuple(r) for r in results.dense_ids(df, "id").collect()) == want
    monkeypatch.setattr(results, "BLOCK_BITS", 2)
    assert sorted(tuple(r) for r in results.dense_ids(df, "id").collect()) == want
    flags = spark.createDataFrame([(1, 1), (0, 0), (None, None)], "a int, b int")
    assert plain(results.booleans(flags, ["a"], ["b"])) == [(False, False), (None, False), (True, True)]


def test_reset_and_cooling(spark):
    sheets = spark.createDataFrame([(1, "x", 2)], "id long, estado_procesamiento string, capa_maxima_procesada int")
    after, counts = results.reset({"actas": sheets, "cola": sheets, "other": sheets}, "actas", ["cola"])
    assert plain(after["actas"]) == [(1, "pendiente", 0)] and plain(after["cola"]) == [] and plain(after["other"]) == [(1, "x", 2)]
    assert plain(counts) == [("actas", 1), ("cola", 1)]
    hot, cold = spark.createDataFrame([(1, 9), (2, 1), (3, None)], "id long, age int"), spark.createDataFrame([(1, 9)], "id long, age int")
    for _ in range(2):  # a second time changes nothing
        hot, cold = results.cooled(hot, cold, "id", F.col("age") > 5)
        assert plain(hot) == [(2, 1), (3, None)] and plain(cold) == [(1, 9)]


def test_reviews(spark):
    schema = "review_id long, acta_id long, decision string, reason string, reviewer string, at long"
    log = spark.createDataFrame([(1, 1, "A", None, "u", 10)], schema)
    new = spark.createDataFrame([(1, 1, "A", None, "u", 10), (2, 1, "B", "why", "v", 20), (3, 1, "C", None, "w", 20), (3, 1, "C", None, "w", 20), (4, 8, "A", None, "u", 5)], schema)
    sheets = spark.createDataFrame([(1, "z"), (2, "y")], "id long, state string")
    log, unknown = reviews.submitted(log, new, sheets)
    assert sorted(r.review_id for r in log.collect()) == [1, 2, 3] and [r.review_id for r in unknown.collect()] == [4]
    assert plain(reviews.reviewed(sheets, log, "state").select("id", "state", "computed", "reviewer", "reviews")) == [(1, "C", "z", "w", 3), (2, "y", "y", None, 0)]
    assert plain(reviews.latest(log, F.lit(15)).select("acta_id", "decision", "reviews")) == [(1, "A", 1)]
    assert plain(reviews.overrides(log).select("review_id", "replaced", "until")) == [(1, None, 20), (2, "A", 20), (3, "B", None)]
    small = reviews.compacted(log, F.lit(20))
    assert [r.review_id for r in small.collect()] == [3]
    assert plain(reviews.latest(small).select("decision")) == plain(reviews.latest(log).select("decision"))


def test_repeated_changes_do_not_double(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id long, v string, t string")
    new = spark.createDataFrame([(1, "b", None, 1), (1, "c", None, 2), (2, "d", "y", 1), (2, "d", "y", 1)], "id long, v string, t string, at long")
    assert plain(mutate.upsert(old, new, ["id"], ("t",), order=("at",))) == [(1, "c", "x", "updated"), (2, "d", "y", "inserted")]
    assert plain(mutate.override(old.select("id", "v"), new, "id", "v", order=("at",))) == [(1, "c")]


def test_boxes_words_and_integers(spark):
    found = spark.createDataFrame([([(1.9, 2.1), (9.0, 2.0), (11.2, 8.9), (1.0, 8.0)], " 12a34 ", 0.456), ([(0.0, 0.0)] * 4, "no", 0.3)], "corners array<struct<x:double,y:double>>, text string, conf double")
    assert plain(records.detections(found.withColumn("corners", F.transform("corners", lambda c: F.array(c["x"], c["y"]))))) == [(1, 2, 9, 6, "12a34", 0.46)]
    zone = records.detections(found.withColumn("corners", F.transform("corners", lambda c: F.array(c["x"], c["y"]))), 0.25).withColumn("page", F.lit(1))
    assert plain(records.zone_votes(zone, "page", F.lit(101), F.lit(200)).select("x", "y", "number", "place")) == [(50, 40, None, 1), (51, 42, 12, 2)]
    words = spark.createDataFrame([(["Departamento:", "x", "MUNICIPIO-DEPARTAMENTO", " zona 3", "lazona", "Mesa", "mesa7", "puesto"],)], "w array<string>")
    assert tuple(words.select(records.token_fields(F.col("w")).alias("f")).first().f) == ("MUNICIPIO-DEPARTAMENTO", "", " zona 3", "puesto", "mesa7")


def test_document_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-" + b"x" * 200)
    (tmp_path / "b.pdf").write_bytes(b"<html>" + b"x" * 200)
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "d.txt").write_bytes(b"%PDF-" + b"x" * 200)
    docs = universe.documents(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[-1], r.error) for r in docs.collect()} == {("a.pdf", None), ("b.pdf", "no PDF head"), ("c.pdf", "under 100 bytes")}
    assert tuple(universe.document_counts(docs).first()) == (1, 2, 416)
    lines = tmp_path / "u.json"
    lines.write_text('{"data": {"b": {"nodes": []}}}\nbroken\n[1]\n')
    good, bad = universe.read_universe(spark, str(lines))
    assert (good.count(), sorted(r.value for r in bad.collect())) == (1, ["[1]", "broken"])


def test_grains(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 4)], "p string, q string, n int")
    got = plain(rollups.grains(rows, ["p", "q"], [F.sum("n").alias("n")]))
    assert (("a", None, 0, 1) in got) and (("a", None, 1, 3) in got) and ((None, "x", 2, 6) in got) and ((None, None, 3, 7) in got) and len(got) == 8


def test_summaries_of_sheets_equal_those_of_tables(spark, sf_dir):
    """Findings as arrays on sheets give what findings, evidence and sheets in tables give."""
    from tallylens.operators import rules
    from tallylens.plans import views as V

    a, b = rollups.department_summary(V.actas(spark, sf_dir), V.geo(spark, sf_dir), V.found(spark, sf_dir), V.evidence(spark, sf_dir)), rollups.department_summary_of(V.sheets(spark, sf_dir), V.geo(spark, sf_dir))
    assert plain(a) == plain(b.select(a.columns))
    a = rollups.clean_mesas(rules.with_flags(V.actas(spark, sf_dir)), V.found(spark, sf_dir)).select("id")
    assert plain(a) == plain(rollups.clean_sheets(V.sheets(spark, sf_dir)).select("id"))
