"""Golden rows of the audit rules and plain versions of the order-dependent operators."""

import random

import numpy as np
from pyspark.sql import functions as F
from tallylens.functions import text as X
from tallylens.operators import consensus, layout, records, rules, vision, workqueue
from tallylens.sources import universe
from tallylens.streaming.votes import consensus_stream

# mesa, e11, urna, incinerados, c1, c2, blanco, nulos, no_marcados, firmas
SHEETS = [(1, 198, 197, 1, 95, 85, 7, 8, 2, 6), (2, 312, 310, 2, 178, 150, 5, 3, 1, 6), (3, 165, 160, 0, 80, 75, 3, 1, 1, 5), (4, 210, 208, 0, 108, 105, 2, 1, 0, 6), (5, 140, 139, 1, 68, 62, 4, 3, 2, 6)]


def test_golden_findings(spark):
    rows = spark.createDataFrame([(*r, 2, 2, True, "q", "k", "01", None) for r in SHEETS], "id long, e11 int, urna int, incinerados int, c1 int, c2 int, blanco int, nulos int, no_marcados int, firmas int, paginas_total int, paginas_esperadas int, qr_ok boolean, qr_raw string, mesa_key string, dep string, creado_en timestamp")
    found = {}
    for r in rules.findings(rows).collect():
        found.setdefault(r.acta_id, []).append((r.rule, r.score2, r.prioridad))
    assert {k: [x[0] for x in v] for k, v in found.items()} == {2: ["aritmetica_excede_total", "aritmetica_no_coincide"], 3: ["nivelacion_inconsistente", "firmas_insuficientes"], 4: ["aritmetica_excede_total", "aritmetica_no_coincide", "nivelacion_inconsistente"]}
    assert ("firmas_insuficientes", 1, "media") in found[3]


def plain_votes(rows, least=5, percent=80):
    n = yes = 0
    stop, seen, out = False, set(), {}
    for vote_id, voter, legit in rows:
        if stop:
            out[vote_id] = "frozen"
        elif voter in seen:
            out[vote_id] = "duplicate"
        else:
            seen.add(voter)
            n, yes = n + 1, yes + legit
            stop = n >= least and 100 * max(yes, n - yes) >= percent * n
            out[vote_id] = "accepted"
    return out


def test_consensus_batch_and_stream_equal_plain(spark, tmp_path):
    random.seed(7)
    rows, want, k = [], {}, 0
    for disc in range(60):
        share, mine = random.random(), []
        for t in range(random.randrange(1, 25)):
            mine.append((k, random.randrange(14), random.random() < share))
            rows.append((disc, *mine[-1][1:], t, k))
            k += 1
        want |= plain_votes(mine)
    votes = spark.createDataFrame(rows, "disc long, voter long, legit boolean, ts long, vote_id long")
    assert {r.vote_id: r.fate for r in consensus.judged(votes).collect()} == want
    for part in range(2):
        (votes.where("ts < 8") if part == 0 else votes.where("ts >= 8")).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    (tmp_path / "live").mkdir()
    query = consensus_stream(spark.readStream.schema(votes.schema).parquet(f"{tmp_path}/live")).writeStream.format("memory").queryName("fates").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    for part in range(2):
        spark.read.parquet(f"{tmp_path}/in/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/live")
        query.processAllAvailable()
    query.stop()
    assert {r.vote_id: r.fate for r in spark.table("fates").collect()} == want


def test_clusters_and_buckets_equal_plain(spark):
    random.seed(3)
    rows = [(p, k, random.randrange(400)) for p in range(5) for k in range(30)]
    got = {(r.page, r.id): r.cluster for r in layout.anchored_clusters(spark.createDataFrame(rows, "page long, id long, y long"), "page", 25).collect()}
    for page in range(5):
        anchor, k = None, -1
        for y, i in sorted((y, i) for p, i, y in rows if p == page):
            if anchor is None or abs(y - anchor) > 25:
                anchor, k = y, k + 1
            assert got[page, i] == k
    burst = spark.createDataFrame([(1, k, 0.0) for k in range(6)], "key long, id long, t double")
    waits = [r.wait for r in workqueue.token_bucket(burst, 5.0, 5.0).orderBy("id").collect()]
    assert waits[:5] == [0.0] * 5 and abs(waits[5] - 0.2) < 1e-9


def test_text_and_records(spark):
    rows = spark.createDataFrame([("12 ", "a/b/x.y.pdf", "1.2.3.4, 5.6.7.8")], "a string, p string, f string")
    r = rows.select(X.lenient_int(F.col("a")).alias("a"), X.lenient_int(F.lit("12.5")).alias("b"), X.zfill(F.lit("12345"), 3).alias("z"), X.file_stem(F.col("p")).alias("s"), X.first_address(F.col("f"), F.lit("p")).alias("i"), rules.digit_votes(F.array(F.lit(1), F.lit(None), F.lit(7))).alias("v")).first()
    assert tuple(r) == (12, None, "12345", "x.y", "1.2.3.4", 107)
    x = rows.select(records.answer_fields(F.lit('```json\n{"anomalies": ["a"], "confidence": 0.5}\n```')).alias("x")).first().x
    assert (list(x.anomalies), x.confidence, x.parse_error) == (["a"], 0.5, False)


def test_universe(spark):
    node = '{"idDepartmentCode":"1","municipalityCode":"4","idZoneCode":"98","standCode":"1","numberStand":"1","expectedName":"%s"}'
    docs = ['{"data":{"b":{"nodes":[' + node % "n1" + "," + node % "" + ']},"c":null,"d":{"nodes":null}}}', '{"b":{"nodes":[' + node % "n2" + "]}}", "broken"]
    got = universe.flatten_universe(spark.createDataFrame([(t,) for t in docs], "value string")).collect()
    assert {(r.dep, r.muni, r.zona, r.puesto, r.mesa, r.expected_name) for r in got} == {("01", "004", "098", "01", "001", n) for n in ("n1", "n2")}


def test_documents_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-" + b"x" * 200)
    (tmp_path / "b.pdf").write_bytes(b"<html>" + b"x" * 200)
    (tmp_path / "c.txt").write_bytes(b"")
    assert {(r.path.rsplit("/", 1)[-1], r.valid) for r in universe.documents(spark, str(tmp_path)).collect()} == {("a.pdf", True), ("b.pdf", False)}


def test_otsu_and_distance():
    assert vision.otsu(np.array([10] * 8 + [200] * 8)) == 10
    rng = np.random.default_rng(5)
    for _ in range(20):
        mask = rng.random((9, 12)) < 0.85
        zeros = np.argwhere(~mask)
        want = [[0 if not mask[y, x] else np.sqrt(((zeros - (y, x)) ** 2).sum(1).min()) for x in range(12)] for y in range(9)]
        assert np.allclose(vision.distance(mask), want)
    assert np.isinf(vision.distance(np.ones((3, 3), bool))).all()


def shape(*cells, size=(12, 12)):
    out = np.zeros(size, bool)
    for y, x in cells:
        out[y, x] = True
    return out


def test_outlines_of_known_shapes():
    block = [(y, x) for y in range(2, 7) for x in range(3, 7)]
    root = np.sqrt(2)
    assert vision.outlines(shape(*block)) == [(12.0, 14.0, 3, 2, 4, 5)]
    assert vision.outlines(shape(*[c for c in block if c not in [(3, 4), (4, 5)]])) == [(12.0, 14.0, 3, 2, 4, 5)]  # holes are filled
    assert vision.outlines(shape((1, 1))) == [(0.0, 0.0, 1, 1, 1, 1)]
    assert vision.outlines(shape((1, 1), (1, 2), (1, 3))) == [(0.0, 4.0, 1, 1, 3, 1)]  # a line is walked twice
    assert vision.outlines(shape((1, 1), (2, 2), (3, 3))) == [(0.0, 4 * root, 1, 1, 3, 3)]
    diamond = vision.outlines(shape((1, 2), (2, 1), (2, 3), (3, 2)))  # closed by corners
    assert len(diamond) == 1 and np.allclose(diamond[0], (2, 4 * root, 1, 1, 3, 3))
    assert [o[2:] for o in vision.outlines(shape((0, 0), (0, 5), (9, 3)))] == [(0, 0, 1, 1), (5, 0, 1, 1), (3, 9, 1, 1)]
    assert vision.outlines(shape()) == []


def test_scores_of_cells():
    white = np.full((30, 30), 255)
    y, x = np.mgrid[:30, :30]
    disk = np.where((y - 14) ** 2 + (x - 14) ** 2 <= 64, 0, 255)
    blot = white.copy()
    blot[2:6, 1:29] = 0
    blot[6:20, 1:4] = 0
    assert [vision.separator(c) for c in (white, disk, blot)] == [0.0, 0.8, 0.0]
    (area, *_), = vision.outlines(disk == 0)
    assert vision.separator_by_area(disk) == min(1.0, (area - 150) / 200) and vision.separator_by_area(white) == 0.0
    assert vision.stroke_score(white) == 0.0 and vision.stroke_score(np.where(x == 9, 0, 255)) == 0.0
    wide = np.where(x < 28, 0, 255)
    assert vision.stroke_score(wide) == 1.0 and vision.upload_features(wide)["dark"] == 1.0
    assert vision.features(np.full((9, 9), 3))["density_std"] == 0.0 and vision.features(disk)["density_std"] > 20
    assert vision.eroded(np.ones((5, 5), bool), 4).all() and vision.eroded(x[:6, :6] > 1, 4).sum() == 12
    two = np.full((40, 40), 255)
    two[2:12, 2:22], two[20:38, 8:16] = 0, 0
    got = vision.double_stroke(two)
    assert (got["width_mean"], got["width_max"], got["overlaps"]) == (14.0, 20.0, 1.0) and got["score"] >= 0.45
    assert vision.double_stroke(np.where((x == 3) & (y < 9), 0, 255))["score"] == 0.0


def test_golden_mathematics_consistency_and_verdict(spark):
    """Thirteen candidates with 1,880 votes, 12 blank, 8 null, 23 unmarked."""
    votes = [142, 289, 87, 56, 203, 178, 34, 167, 91, 45, 312, 198, 78]
    rows = spark.createDataFrame([(votes, t) for t in (1923, 1922, 1900, 1800)] + [([-1, -2, 1000], 997)], "v array<long>, t long")
    found = F.expr("0.9")
    got = [r.x for r in rows.select(rules.math_rules(F.col("t"), F.col("v"), F.lit(12), F.lit(8), F.lit(23), found).alias("x")).collect()]
    assert got == [[], ["SUM_MISMATCH"], ["SUM_MISMATCH"], ["SUM_MISMATCH", "UNDERVOTE"], ["SUM_MISMATCH", "NEGATIVE_VOTES", "NEGATIVE_VOTES", "EXCEEDS_3_DIGITS"]]
    risk = lambda names, sig, ocr: spark.range(1).select(rules.risk_score(F.array(*map(F.lit, names)).cast("array<string>"), F.lit(sig), F.lit(ocr)).alias("x")).first().x
    assert (risk(["SUM_MISMATCH", "UNDERVOTE"], 50, 0.9), risk(["NEGATIVE_SUMMARY"], 0, 1.0), risk([], 20, 0.5)) == (91.5, 5.0, 27.5)
    state = lambda *v: spark.range(1).select(rules.consistency(F.array(*[F.lit(x).cast("long") for x in v])).alias("x")).first().x
    assert [state(100, 100, 100), state(100, 95, 92), state(100, 50, 45), state(100, 50, 20), state(100, None, 3)] == ["ok", "ok", "ok", "inconsistent", "few_data"]
    assert spark.range(1).select(rules.verdict(F.round(rules.verdict_points(F.lit(0.0), F.lit(0.4), F.lit(0.6999), F.lit(1), F.lit(5)), 4)).alias("x")).first().x == "SOSPECHOSA"
    big = 10 * 1024 * 1024
    cases = [("a.pdf", 9, "image/png", "25504446"), ("a.png", 0, "image/png", ""), ("a.png", big + 1, "image/png", ""), ("a.png", 9, "text/plain", ""), ("a.jpg", 9, "image/jpeg", "255044462D"), ("a.jpg", 9, "image/jpeg", "89504E4700000000"), ("a.jpg", 9, None, ""), ("a.JPG", big, "IMAGE/png", "89504E470D0A1A0A")]
    rows = spark.createDataFrame(cases, "n string, s long, k string, h string")
    want = ["extension", "empty", "too_large", "content_type", "pdf", "content", "content_type", None]
    assert [r.x for r in rows.select(records.upload_problem(*map(F.col, "nskh")).alias("x")).collect()] == want
    shapes = spark.createDataFrame([(850, 1000), (851, 1001), (8505, 10000), (549, 1000)], "w long, h long")
    assert [r.x for r in shapes.select(F.array_contains(records.image_issues(F.col("w"), F.col("h"), F.lit(100)), "aspect").alias("x")).collect()] == [False, True, True, True]


def test_annulled_votes_bar_their_voter_and_do_not_count(spark):
    rows = [(1, v, v != 3, v == 2, t) for t, v in enumerate([1, 2, 2, 3, 4, 5, 6])]
    votes = spark.createDataFrame(rows, "disc long, voter long, legit boolean, anulado boolean, ts long").withColumns({"vote_id": F.col("ts"), "peso": F.lit(0.5)})
    assert [r.fate for r in consensus.judged(votes).orderBy("ts").collect()] == ["accepted", "annulled", "duplicate", "accepted", "accepted", "accepted", "accepted"]
    config = spark.createDataFrame([("umbral_min_votos", "x")], "clave string, valor string")
    r = consensus.weighed(votes.where("ts <> 2"), config).first()
    assert (r.confirma, r.rechaza, r.peso_confirma, r.estado, r.razon) == (4, 1, 2.0, "verificado_legitimo", "Consenso legítimo: 4/5 ≥ 80%")


def test_codes_words_answers_and_scores(spark):
    symbols = [(1, 0, 1, "EAN13", "1", "K"), (1, 0, 2, "qrcode", "a-K-b", "K"), (1, 1, 1, "QRCODE", "other", "K"), (2, 0, 1, "QRCODE", "x", ""), (3, 0, 0, None, None, "K"), (4, 0, 0, None, None, None)]
    got = {r.sheet: (r.symbols, r.raw, r.match, r.mismatches) for r in records.qr_readings(spark.createDataFrame(symbols, "sheet long, page int, place int, kind string, data string, key string")).collect()}
    assert got == {1: (3, "a-K-b", True, 1), 2: (1, "x", None, 0), 3: (0, None, False, 1), 4: (0, None, None, 0)}
    answer = '{"mesa_key": "m", "resultados": [{"cell_index": 2, "anomalies": [], "confidence": 0.49}, {"anomalies": ["TACHÓN"], "confidence": 0.1}, {"cell_index": 3, "confidence": 0.9}]}'
    rows = spark.createDataFrame([(1, answer), (2, "no json"), (3, None)], "id long, raw string")
    assert [tuple(r) for r in records.answer_findings(rows, F.col("raw"), "id").collect()] == [(1, "m", "celda_0", "tachon_sobreescritura", 0.1, "TACHÓN", "media"), (1, "m", "celda_3", "trazo_anomalo", 0.9, "VLM confidence: 0.90", "alta")]
    score = lambda *v: F.struct(rules.sheet_score(F.array(*[F.lit(x) for x in v]).cast("array<double>")).alias("x"))
    r = spark.range(1).select(score().alias("a"), score(0.8).alias("b"), score(0.9, 0.95).alias("c"), rules.slot_digit(F.lit(0.05)).alias("d"), rules.slot_digit(F.lit(0.01)).alias("e"), rules.slot_digit(F.lit(0.4)).alias("f")).first()
    assert [tuple(r[k].x) for k in "abc"] == [(0.0, "LIMPIO"), (0.9, "FRAUDE"), (1.0, "FRAUDE")]
    assert [tuple(r[k]) for k in "def"] == [(1, 0.375), (None, 0.0), (8, 0.6)]
