"""Pixels of pages: golden votes, plain versions of segmentation, strokes at known slopes, rotation there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallylens.operators import pages, rules, vision
from tallylens.plans import drawn

SCHEMA = "sheet long, page_number int, height int, width int, pixels binary"
# The golden sheet: votes of candidates 1 to 13, and blank, null, unmarked and all votes.
VOTES = [142, 289, 87, 56, 203, 178, 34, 167, 91, 45, 312, 198, 78]
SUMS = [12, 8, 23, 1923]


def page(array, sheet=1, number=1):
    return (sheet, number, *array.shape, np.ascontiguousarray(array).tobytes())


def vote_page(number, votes, size=drawn.VOTE_PAGE):
    out = np.full(size, drawn.PAPER, np.uint8)
    drawn._votes(out, number, votes[:7] if number == 1 else [0] * 7 + votes[7:])
    return out


def test_golden_votes(spark):
    """Two pages of the golden sheet; a sum of four digits has three slots, so its last three are read."""
    every = [*VOTES, *[v % 1000 for v in SUMS]]
    big = [vote_page(n, every, (1600, 1200)) for n in (1, 2)]
    rows = [page(vote_page(1, every), 1, 1), page(vote_page(2, every), 1, 2), page(big[0], 2, 1), page(big[1], 2, 2), page(big[0], 3, 4), (4, 1, 10, 10, b"short"), (5, None, None, None, None)]
    got = {(r.sheet, r.page_number): r for r in pages.page_votes(spark.createDataFrame(rows, SCHEMA), {1: "One"}).collect()}
    for sheet in (1, 2):
        found = [c for n in (1, 2) for c in got[sheet, n].candidates]
        assert [(c.number, c.votes) for c in found] == list(enumerate(VOTES, 1))
        assert [c.name for c in found[:2]] == ["One", "Candidate 2"]
        assert list(got[sheet, 2].summary) == [v % 1000 for v in SUMS]
        assert got[sheet, 1].summary is None
        assert [s.digit for s in found[2].slots] == [None, 8, 7]
        assert all(0 < got[sheet, n].confidence <= 1 and got[sheet, n].error is None for n in (1, 2))
    assert got[3, 4].error == "page_number must be 1 or 2, got 4"
    assert got[4, 1].error == "pixels do not fit the size"
    assert got[5, None].candidates is None and got[5, None].error.endswith("got none")


def test_slot_geometry():
    assert pages.slot_boxes(400, 300, (0.384, 0.468)) == [(207, 230, 153, 187), (232, 255, 153, 187), (257, 280, 153, 187)]


def test_otsu_in_batches_equals_single():
    rng = np.random.default_rng(3)
    flat = np.concatenate([rng.integers(0, 256, (20, 150)), np.full((1, 150), 0), np.full((1, 150), 77), np.repeat([[10, 200]], 75, 0).reshape(1, 150)]).astype(np.uint8)
    want = [(row <= vision.otsu(row)).mean() if len(set(row)) > 1 else float(row[0] == 0) for row in flat]
    assert np.allclose(pages.otsu_ink(flat), want)


def plain_rows(profile, gap=20):
    """Rows of a profile, by looking at one place after the other."""
    on = [y for y, n in enumerate(profile) if n > sum(profile) / len(profile) * 0.5]
    groups = []
    for y in on:
        if groups and y - groups[-1][-1] <= gap:
            groups[-1].append(y)
        else:
            groups.append([y])
    return [(g[0], g[-1]) for g in groups if g[-1] - g[0] >= gap]


def test_rows_equal_plain():
    rng = np.random.default_rng(5)
    profiles = [[0] * 50, [7] * 50, [0] * 10 + [9] * 20 + [0] * 40, [0] * 10 + [9] * 21 + [0] * 40]
    profiles += [np.repeat(rng.integers(0, 9, 30) * (rng.random(30) < 0.4), rng.integers(1, 40, 30)).tolist() for _ in range(40)]
    for p in profiles:
        assert pages.islands(np.array(p)) == plain_rows(p)


def test_vote_cells_and_fallback(spark):
    table = np.full((400, 100), 255, np.uint8)
    table[30:70], table[120:150, :90], table[300:310] = 0, 0, 0
    rows = spark.createDataFrame([page(table, 1), page(np.full((403, 50), 255, np.uint8), 2)], SCHEMA)
    got = [tuple(r) for r in pages.vote_cells(rows).where("sheet = 1").select("candidate_index", "x", "y", "w", "h", "ny", "nh").collect()]
    assert got == [(0, 62, 30, 20, 39, 0.075, 0.0975), (1, 62, 120, 20, 29, 0.3, 0.0725)]
    assert [(r.y, r.h) for r in pages.vote_cells(rows).where("sheet = 2").orderBy("candidate_index").collect()] == [(50 * k, 50) for k in range(8)]


def lines_page(slope, n=8, size=(500, 600), length=400, thick=2):
    out = np.full(size, 255, np.uint8)
    for k in range(n):
        for x in range(length):
            y = 60 + 45 * k + int(round(slope * x))
            out[y : y + thick, 50 + x] = 0
    return out


@pytest.mark.parametrize("degrees", [-2.5, -1.0, 0.0, 0.4, 1.7])
def test_strokes_and_deskew(spark, degrees):
    """Lines of a known slope are found as such, and a page turned back has level ones."""
    rows = spark.createDataFrame([page(lines_page(np.tan(np.radians(degrees))))], SCHEMA)
    found = pages.strokes(rows).withColumn("angle", pages.rotation_of(F.col("strokes"))).withColumn("sheet", F.size("strokes").cast("long"))
    first = found.first()
    assert first.sheet == 8
    assert abs(first.angle - degrees) < 0.2
    back = pages.strokes(pages.deskewed(found), name="left").withColumn("rest", pages.rotation_of(F.col("left"))).first()
    assert abs(back.rest) < 0.2
    cos, sin = abs(np.cos(np.radians(first.angle))), abs(np.sin(np.radians(first.angle)))
    assert (back.width, back.height) == ((600, 500) if abs(first.angle) < 0.1 else (int(600 * cos + 500 * sin), int(600 * sin + 500 * cos)))
    assert len(back.pixels) == back.width * back.height


def test_stroke_rules(spark):
    """Gaps are bridged, short, thick and broken lines don't count, standing lines do."""
    out = np.full((400, 400), 255, np.uint8)
    out[20, 10:110], out[20, 120:300] = 0, 0  # a gap of ten
    out[60, 10:110], out[60, 121:220] = 0, 0  # a gap of eleven breaks it
    out[100, 10:209] = 0  # one too short
    out[140:160, 10:300] = 0  # too thick
    out[180:390, 350] = 0  # standing
    got = [tuple(s) for s in pages.strokes(spark.createDataFrame([page(out)], SCHEMA)).first().strokes]
    assert got == [(10, 20, 299, 20), (350, 180, 350, 389)]


def test_rotation_rules(spark):
    """Under five strokes there is no angle, steep and short ones count for the five only."""
    level, steep, short = (0, 0, 400, 7), (0, 0, 300, 30), (0, 0, 50, 0)
    for strokes, angle in (([level] * 4, 0.0), ([level] * 5, 1.0), ([level] + [steep] * 2 + [short] * 2, 1.0), ([steep] * 6, 0.0)):
        df = spark.createDataFrame([(strokes,)], "s array<struct<x1:int,y1:int,x2:int,y2:int>>")
        assert df.select(pages.rotation_of(F.col("s"))).first()[0] == angle


def test_normalised_and_resized(spark):
    rows = spark.createDataFrame([page(lines_page(np.tan(np.radians(1.5))))], SCHEMA)
    got = pages.normalised(rows, size=(90, 267)).first()
    assert (got.width, got.height, got.original_width, got.original_height, got.aspect_ratio_preserved) == (90, 267, 600, 500, True)
    assert abs(got.rotation_corrected - 1.5) < 0.2
    step = np.array([[0, 100], [100, 200]], np.uint8)
    assert pages.resized(step, 4, 4).tolist() == [[0, 25, 75, 100], [25, 50, 100, 125], [75, 100, 150, 175], [100, 125, 175, 200]]
    assert (pages.turned(step, 90.0) == [[100, 200], [0, 100]]).all() or pages.turned(step, 90.0).shape == (2, 2)


def test_separator_takes_the_first_outline():
    """The lower of two spots comes first, as contours are listed from the bottom."""
    cell = np.full((60, 60), 255, np.uint8)
    cell[2:18, 2:58] = 0  # a blot of over 15 %
    yy, xx = np.mgrid[:60, :60]
    cell[(yy - 42) ** 2 + (xx - 30) ** 2 <= 100] = 0  # a round spot of over 5 %
    assert vision.separator(cell) == 0.8
    assert vision.separator(cell[::-1]) == 0.6


def test_math_anomalies(spark):
    """The clean golden sheet, wrong totals, a missing summary, negative and long numbers."""
    rows = [(1, 1923, 12, 8, 23, VOTES, 0.9, 2000), (2, 1922, 12, 8, 23, VOTES, 0.9, 2000), (3, 1800, 12, 8, 23, VOTES, 0.59, 1700), (4, None, None, None, None, [5], None, None), (5, 0, 0, -1, 1, [1, -1, 0, 0, 0, 0, 0, -2], 0.6, 0), (6, 1000, 0, 0, 0, [1000, None], 1.0, 1000)]
    df = spark.createDataFrame(rows, "k int, total int, blank int, nul int, unmarked int, votes array<int>, ocr double, registered int")
    x = rules.math_anomalies(F.col("total"), F.col("votes"), F.col("blank"), F.col("nul"), F.col("unmarked"), F.col("ocr"), F.col("registered"))
    got = {r.k: [(a.rule, a.severity, a.confidence, a.page, a.details) for a in r.x] for r in df.select("k", x.alias("x")).collect()}
    assert got[1] == []
    assert got[2] == [("SUM_MISMATCH", "CRITICAL", 0.95, 2, {"declared_total": 1922, "computed_total": 1923})]
    assert [a[0] for a in got[3]] == ["SUM_MISMATCH", "OVERVOTE", "UNDERVOTE", "LOW_OCR_CONFIDENCE"]
    assert got[4] == [("SUM_MISMATCH", "CRITICAL", 0.95, 2, {"declared_total": 0, "computed_total": 5})]
    assert got[5][:3] == [("SUM_MISMATCH", "CRITICAL", 0.95, 2, {"declared_total": 0, "computed_total": -2}), ("NEGATIVE_VOTES", "CRITICAL", 1.0, 1, {"candidate": 2, "votes": -1}), ("NEGATIVE_VOTES", "CRITICAL", 1.0, 2, {"candidate": 8, "votes": -2})]
    assert [a[0] for a in got[5][3:]] == ["NEGATIVE_SUMMARY"]
    assert [a[0] for a in got[6]] == ["EXCEEDS_3_DIGITS"]
    message = df.where("k = 3").select(F.transform(x, lambda a: a["message"])).first()[0]
    assert message == ["Total declared (1800) != computed (1923), diff=123", "Total votes (1800) exceeds registered voters (1700)", "Candidate sum (1880) > total (1800)", "Low OCR confidence: 59.0%"]


def _noting_memory(page, number, v):
    """A drawer that writes the worker's resident pages of memory into the page."""
    with open("/proc/self/statm") as f:
        page[0, :8] = np.frombuffer(np.int64(f.read().split()[1]).tobytes(), np.uint8)


def test_drawing_holds_few_pages(spark):
    """2,500 pages of 120,000 bytes in one task: 300 MB, of which it holds some at a time."""
    rows = spark.range(2500 * spark.sparkContext.defaultParallelism).select(F.lit(1).alias("page_number"), F.array(F.lit(0).cast("long")).alias("v"))
    memory = drawn._page(rows, _noting_memory, drawn.VOTE_PAGE).select(F.spark_partition_id().alias("task"), F.substring("pixels", 1, 8).alias("m"))
    held: dict = {}
    for r in memory.collect():
        held.setdefault(r.task, []).append(int(np.frombuffer(bytes(r.m), np.int64)[0]) * 4096)
    assert max(max(m) - min(m) for m in held.values()) < 100e6


def test_parts_of_batches():
    """Slices of few bytes; a large page is alone, nulls and empty batches are kept."""
    import pyarrow as pa

    half, most = b"x" * (pages.BATCH_PIXELS // 2), b"y" * (pages.BATCH_PIXELS + 1)
    for values in ([half, half, half], [most, None, half, most, None], [], [None]):
        batch = pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["pixels"])
        got = list(pages.parts(batch, 0))
        assert [v for part in got for v in part["pixels"].to_pylist()] == values
        assert all(part.num_rows == 1 or sum(len(v or b"") for v in part["pixels"].to_pylist()) <= pages.BATCH_PIXELS for part in got)


def test_cells_are_measured_some_at_a_time(spark):
    """A batch of 5,000 cells of 24 x 24 pixels: the measure gets under 500 at a time, and every cell has its answer."""
    counted = vision.of_cells(lambda cells: {"n": np.full(len(cells), float(len(cells))), "first": cells[:, 0, 0].astype(float)}, ("n", "first"))
    rows = spark.range(0, 5000, 1, 1).select("id", F.array_repeat((F.col("id") % 256).cast("int"), 64).alias("gray")).select("id", counted(vision.resize(24)("gray")).alias("f")).collect()
    assert len(rows) == 5000 and max(r.f.n for r in rows) < 500
    assert all(r.f.first == r.id % 256 for r in rows)


def plain_cubic(page, y, x):
    """One place's value from 16 pixels by the kernel's two polynomials."""

    def weight(d, a=-0.75):
        d = abs(d)
        return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0

    y0, x0 = int(np.floor(y)), int(np.floor(x))
    at = lambda k, n: min(max(k, 0), n - 1)
    total = sum(weight(y - i) * weight(x - j) * float(page[at(i, page.shape[0]), at(j, page.shape[1])]) for i in range(y0 - 1, y0 + 3) for j in range(x0 - 1, x0 + 3))
    return min(max(total, 0), 255)


@pytest.mark.parametrize("size", [(9, 7), (1, 5), (2, 1)])
def test_cubic_equals_plain(size):
    """Places in and beyond a page, and on its pixels."""
    rng = np.random.default_rng(11)
    gray = rng.integers(0, 256, size).astype(np.uint8)
    y, x = rng.uniform(-4, size[0] + 4, (20, 20)), rng.uniform(-4, size[1] + 4, (20, 20))
    want = np.array([[plain_cubic(gray, b, a) for b, a in zip(*row, strict=True)] for row in zip(y, x, strict=True)])
    assert abs(pages.cubic(gray, y, x) - want).max() < 0.501
    assert (pages.cubic(gray, *np.mgrid[: size[0], : size[1]].astype(float)) == gray).all()


def test_turned_in_strips(monkeypatch):
    gray = np.random.default_rng(12).integers(0, 256, (60, 40)).astype(np.uint8)
    whole = pages.turned(gray, 1.7)
    monkeypatch.setattr(pages, "BATCH_PIXELS", 900)
    assert (pages.turned(gray, 1.7) == whole).all()


@pytest.mark.parametrize("degrees", [-1.9, -0.5, -0.3, 0.25, 0.3, 0.5, 0.7])
def test_deskew_keeps_thin_lines(spark, degrees):
    """Lines of one pixel are all found again after the page was turned back by their own rotation."""
    gray = np.where(lines_page(np.tan(np.radians(degrees)), thick=1) < 128, drawn.INK, drawn.PAPER).astype(np.uint8)
    rows = pages.strokes(spark.createDataFrame([page(gray)], SCHEMA)).withColumn("angle", pages.rotation_of(F.col("strokes"))).drop("strokes")
    left = pages.strokes(pages.deskewed(rows)).withColumn("rest", pages.rotation_of(F.col("strokes"))).first()
    assert abs(left.angle - degrees) < 0.2
    assert len(left.strokes) == 8 and abs(left.rest) < 0.3


def test_page_deskewed_query(spark, sf_dir):
    """The angle is the page's own, not its number's; every line is left, level."""
    from tallylens.plans.queries import QUERIES

    drew = {r.sheet: r.v for r in drawn.sums(spark, sf_dir).collect()}
    rows = QUERIES["page_deskewed"](spark, sf_dir).collect()
    assert len(rows) == len(drew) and any(r.angle for r in rows)
    for r in rows:
        skew = np.degrees(np.arctan((drew[r.sheet][1] % drawn.SKEWS - drawn.SKEWS // 2) / drawn.SKEW_STEP)) if r.lines >= 5 else 0.0
        assert r.lines == drew[r.sheet][0] % drawn.LINES and abs(r.angle - skew) < 0.15 and r.rest == 0
