"""Page images drawn from the driver's tables: what pages hold follows from sums of line items, so that SQL can tell what
must be read from the pixels. Pixels are drawn in the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallylens.operators.pages import BANDS, SIGNATURES, SUMMARY, slot_boxes

from . import views as V

#: Share of a slot's pixels that are inked for each digit.
DENSITY = {0: 0.17, 1: 0.045, 2: 0.333, 3: 0.37, 4: 0.127, 5: 0.30, 6: 0.215, 7: 0.085, 8: 0.45, 9: 0.26}
VOTE_PAGE = (400, 300)
TABLE_PAGE = (420, 60)
LINE_PAGE = (480, 320)
BARS, LINES = 6, 20
PAPER, INK = 245, 40
#: Pixels that are drawn before they are passed on.
DRAWN_BYTES = 1 << 22

#: Quantities of each supplier's line items in 20 classes of parts; classes without any are 0.
SUMS_SQL = "sums AS (SELECT s_suppkey sheet, k, CAST(coalesce(v,0) AS BIGINT) v FROM (SELECT s_suppkey, unnest(range(20)) k FROM supplier) LEFT JOIN (SELECT l_suppkey, l_partkey%20 c, sum(CAST(l_quantity AS BIGINT)) v FROM lineitem GROUP BY ALL) ON l_suppkey=s_suppkey AND c=k)"


def sums(s, d):
    """Arrays of the 20 sums of each supplier."""
    li = V.load(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 20).alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    packed = li.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    rows = V.load(s, d, "supplier").select(F.col("s_suppkey").alias("sheet")).join(packed, F.col("sheet") == F.col("l_suppkey"), "left")
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
    return rows.select("sheet", each.alias("v"))


def _page(df, drawer, size):
    """Adds height, width and pixels by the drawer, which gets a white page and the row's values. Pages are passed on some
    at a time, so a task holds few of them, however many rows it has."""
    kept = df.drop("v").columns
    step = max(1, DRAWN_BYTES // (size[0] * size[1]))
    schema = StructType([*(df.schema[c] for c in kept), *StructType.fromDDL("height int not null, width int not null, pixels binary").fields])

    def pixels(number, v):
        page = np.full(size, PAPER, np.uint8)
        drawer(page, int(number), np.asarray(v.values))
        return page.tobytes()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                drawn = [pixels(n, v) for n, v in zip(some["page_number"].to_pylist(), some["v"], strict=True)]
                sizes = [pa.array([n] * some.num_rows, pa.int32()) for n in size]
                yield pa.RecordBatch.from_arrays([*(some[c] for c in kept), *sizes, pa.array(drawn, pa.binary())], names=schema.names)

    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)  # few rows, much work for each
    return df.mapInArrow(run, schema)


def _votes(page, number, v):
    rows = list(zip(BANDS[1], v[:7], strict=True)) if number == 1 else list(zip([*BANDS[2], *SUMMARY.values()], v[7:17], strict=True))
    for band, votes in rows:
        digits = [int(c) if c != " " else None for c in f"{int(votes) % 1000:3d}"]
        for digit, (x0, x1, y0, y1) in zip(digits, slot_boxes(*page.shape, band), strict=True):
            if digit is not None:
                area = (x1 - x0) * (y1 - y0)
                flat = np.full(area, PAPER, np.uint8)
                flat[: int(area * DENSITY[digit] + 0.5)] = INK
                page[y0:y1, x0:x1] = flat.reshape(y1 - y0, x1 - x0)


def vote_pages(s, d):
    """Two pages for each supplier with the sums, modulo 1000, as votes; digits before the first are blank."""
    return _page(sums(s, d).withColumn("page_number", F.explode(F.array(F.lit(1), F.lit(2)))), _votes, VOTE_PAGE)


def _bars(page, number, v):
    for k in range(BARS if number else 0):
        y0, height, width = 8 + 66 * k + int(v[k]) % 7, 12 + int(v[k]) % 44, 20 * (1 + int(v[k]) % 3)
        page[y0 : y0 + height, :width] = INK


def table_pages(s, d):
    """A table of six bars for each supplier, each fifth one without any."""
    return _page(sums(s, d).withColumn("page_number", (F.col("sheet") % 5 != 0).cast("int")), _bars, TABLE_PAGE)


def _lines(page, number, v):
    for k in range(int(v[0]) % LINES):
        length, rise = 180 + int(v[k]) % 90, int(v[k]) % 9 - 4
        x = np.arange(length)
        y = 8 + 16 * k + np.floor(rise * x / (length - 1) + 0.5).astype(int)
        if v[k] % 2:
            x, y = np.delete(x, slice(60, 68)), np.delete(y, slice(60, 68))  # a gap that is bridged
        page[y, 10 + x] = INK
    flat = np.full(2000, PAPER, np.uint8)  # a block too narrow for a stroke
    flat[: int(v[19]) % 2000] = INK
    page[370:390, 10:110] = flat.reshape(20, 100)


def line_pages(s, d):
    """A page of up to 19 long lines and some ink at its end for each supplier."""
    return _page(sums(s, d).withColumn("page_number", F.lit(1)), _lines, LINE_PAGE)


#: Rise over run of a skewed page's lines, in steps of 1/600: up to 20 steps, or 1.91 degrees.
SKEWS, SKEW_STEP = 41, 600


def _skewed(page, number, v):
    for k in range(int(v[0]) % LINES):
        x = np.arange(220 + int(v[k]) % 50)
        y = 24 + 16 * k + np.floor((int(v[1]) % SKEWS - SKEWS // 2) * x / SKEW_STEP + 0.5).astype(int)
        if v[k] % 2:
            x, y = np.delete(x, slice(60, 68)), np.delete(y, slice(60, 68))  # a gap that is bridged
        page[y, 10 + x] = INK
    page[380:400, 10:110] = INK  # a block too narrow for a stroke


def skewed_pages(s, d):
    """A page of up to 19 long lines for each supplier, all of the page's own skew."""
    return _page(sums(s, d).withColumn("page_number", F.lit(1)), _skewed, LINE_PAGE)


CELL_PAGE = (90, 120)
#: Cells of small pages: two on the first, one on the second, which reaches beyond the page, and one that lies beyond it.
CELL_BOXES = {1: {"votos_candidato_1": (5, 5, 40, 40), "votos_candidato_2": (60, 5, 40, 40)}, 2: {"votos_blanco": (90, 60, 40, 40), "votos_nulos": (200, 0, 40, 40)}}


def _blocks(page, number, v):
    for k, (x, y, w, h) in enumerate(CELL_BOXES[number].values()):
        side = int(v[2 * number + k]) % 30
        page[y : y + side, x : x + side] = INK


def cell_pages(s, d):
    """Two small pages for each supplier with a square of ink in each fixed cell."""
    return _page(sums(s, d).withColumn("page_number", F.explode(F.array(F.lit(1), F.lit(2)))), _blocks, CELL_PAGE)


SIGN_PAGE = (200, 160)


def _signed(page, number, v):
    h, w = page.shape
    for k, (x, y, a, b) in enumerate(SIGNATURES):
        box = page[int(y * h) : int((y + b) * h), int(x * w) : int((x + a) * w)]
        flat = np.full(box.size, PAPER, np.uint8)
        flat[: int(v[k]) % 200] = INK
        box[:] = flat.reshape(box.shape)
    page[0, 0] = INK  # some ink on each page


def sign_pages(s, d):
    """A third page for each supplier with some ink in each signature box."""
    return _page(sums(s, d).withColumn("page_number", F.lit(3)), _signed, SIGN_PAGE)
