"""Whole pages as gray pixels: votes from digit slots, row segmentation, long strokes, deskewing and resizing.

A page is a row with height, width and pixels (binary, one byte a pixel, row by row). Pages of one size that come in one
Arrow batch are worked on together as an array (page, row, column); what only needs the measured numbers (digits, votes,
rows, angles) is left to Column functions. A page whose pixels don't fit its size has nulls for what is measured."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from . import rules, vision
from .runs import components, links, row_runs

#: Pixels that are worked on together and passed on before the next; a larger page is alone.
BATCH_PIXELS = 1 << 22

# Shares of a page where the digits of votes stand, and the bands of its rows: candidates 1-7 on the first
# page, 8-13 on the second, and the second page's four sums.
SLOTS = (0.690, 0.942)
BANDS = {
    1: [(0.384, 0.468), (0.475, 0.547), (0.554, 0.626), (0.633, 0.706), (0.713, 0.784), (0.791, 0.865), (0.872, 0.944)],
    2: [(0.255, 0.335), (0.342, 0.421), (0.428, 0.506), (0.513, 0.592), (0.599, 0.678), (0.685, 0.764)],
}
SUMMARY = {"blank_votes": (0.780, 0.803), "null_votes": (0.811, 0.833), "unmarked_votes": (0.844, 0.866), "total_votes": (0.878, 0.900)}
INSET = 0.06
FULL_DENSITY = 0.20
# The column of votes of a table, and the rows of one in which no row is found.
VOTES_COLUMN = (0.62, 0.82)
FALLBACK_ROWS = 8
# Size of a normalised page.
STANDARD = (3609, 10730)


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most BATCH_PIXELS bytes of a column, each of one row at least."""
    first = held = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > first and held + size > BATCH_PIXELS:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    yield batch.slice(first)


def measured(pages: DataFrame, measure: Callable[..., list], name: str, kind: str, *given: str) -> DataFrame:
    """All rows and columns of pages with a column `name` of the measure's answers. The measure gets the array of some
    pages of one size and a list of values for each of the columns `given`."""
    columns = pages.columns
    places = {c: columns.index(c) for c in ("height", "width", "pixels", *given)}
    answer = to_arrow_type(StructType.fromDDL(f"x {kind}")[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in parts(whole, places["pixels"])):
            value = {c: batch.column(k) for c, k in places.items()}
            sizes: dict[tuple[int, int], list[int]] = {}
            for k, (h, w, p) in enumerate(zip(value["height"].to_pylist(), value["width"].to_pylist(), value["pixels"], strict=True)):
                if h and w and p.is_valid and len(p.as_buffer()) == h * w:
                    sizes.setdefault((h, w), []).append(k)
            out: list = [None] * batch.num_rows
            for (h, w), found in sizes.items():
                array = np.stack([np.frombuffer(value["pixels"][k].as_buffer(), np.uint8).reshape(h, w) for k in found])
                others = [[value[c][k].as_py() for k in found] for c in given]
                for k, x in zip(found, measure(array, *others), strict=True):
                    out[k] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, answer)], names=[*batch.schema.names, name])

    return pages.mapInArrow(run, StructType([*pages.schema, StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType)]))


# --- votes from slots


def otsu_ink(flat: np.ndarray) -> np.ndarray:
    """Share of each row's pixels up to its Otsu threshold (the lowest of the largest between-class variance); of pixels
    of one value, those that are 0."""
    n, m = flat.shape
    hist = np.bincount((np.arange(n)[:, None] * 256 + flat).ravel(), minlength=n * 256).reshape(n, 256).astype(np.float64)
    weight, mean = hist.cumsum(1), (hist * np.arange(256)).cumsum(1)
    rest = m - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (mean / weight - (mean[:, -1:] - mean) / rest) ** 2
    level = np.where(np.isfinite(between), between, 0.0).argmax(1)
    return weight[np.arange(n), level] / m


def slot_boxes(height: int, width: int, band: tuple[float, float]) -> list[tuple[int, int, int, int]]:
    """(x0, x1, y0, y1) of the three slots of a row, without the inset at both sides."""
    x0, x1 = (int(share * width) for share in SLOTS)
    y0, y1 = (int(share * height) for share in band)
    each = (x1 - x0) // 3
    inset = int(each * INSET)
    return [(x0 + i * each + inset, x0 + (i + 1) * each - inset, y0, y1) for i in range(3)]


def _densities(array: np.ndarray, numbers: list) -> list:
    out: list = [None] * len(array)
    for number, bands in BANDS.items():
        mine = [k for k, x in enumerate(numbers) if x == number]
        if not mine:
            continue
        part, rows = array[mine], []
        for band in [*bands, *(SUMMARY.values() if number == 2 else ())]:
            slots = [part[:, y0:y1, x0:x1].reshape(len(mine), -1) for x0, x1, y0, y1 in slot_boxes(*array.shape[1:], band)]
            rows.append(np.stack([otsu_ink(s) if s.shape[1] else np.zeros(len(mine)) for s in slots], 1))
        for k, x in zip(mine, np.stack(rows, 1).tolist(), strict=True):
            out[k] = x
    return out


def page_votes(pages: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Pages (page_number, height, width, pixels, ...) with candidates (number, name, slots, votes, confidence, density),
    summary (the four sums of a second page), confidence and error, without pixels.

    A slot's digit follows from the share of ink in it; a slot without a digit counts as 0. A page's confidence is the
    mean density of its candidates against 0.20, within 0 and 1."""
    slots = measured(pages, _densities, "_d", "array<array<double>>", "page_number")
    read = lambda row: F.transform(row, rules.slot_digit)
    first = F.when(F.col("page_number") == 2, len(BANDS[1])).otherwise(0)
    table = F.create_map(*[F.lit(x) for kv in (names or {0: ""}).items() for x in kv])

    def candidate(row: Column, i: Column) -> Column:
        number = (first + i + 1).cast("int")
        found = F.array(read(row))  # a one-element array names the slots
        return F.element_at(
            F.transform(
                found,
                lambda s: F.struct(
                    number.alias("number"),
                    F.coalesce(table[number], F.concat(F.lit("Candidate "), number)).alias("name"),
                    s.alias("slots"),
                    votes_of(s).alias("votes"),
                    F.round(rules.slots_confidence(s), 4).alias("confidence"),
                    F.round((row[0] + row[1] + row[2]) / 3, 4).alias("density"),
                ),
            ),
            1,
        )

    n = F.when(F.col("page_number") == 2, len(BANDS[2])).otherwise(len(BANDS[1]))
    summary = F.struct(*[votes_of(read(F.try_element_at("_d", F.lit(len(BANDS[2]) + k + 1)))).alias(name) for k, name in enumerate(SUMMARY)])
    out = slots.withColumn("candidates", F.transform(F.slice("_d", 1, n), candidate))
    # In ten-thousandths, as densities are, so that the mean has no rounding of its own.
    whole = F.aggregate("candidates", F.lit(0).cast("long"), lambda acc, c: acc + F.round(c["density"] * 10_000).cast("long"))
    share = F.round(F.try_divide(whole, F.size("candidates")) / FULL_DENSITY)
    error = F.when(~F.coalesce(F.col("page_number").isin(*BANDS), F.lit(False)), F.concat(F.lit("page_number must be 1 or 2, got "), F.coalesce(F.col("page_number").cast("string"), F.lit("none"))))
    return out.withColumns(
        {
            "summary": F.when(F.col("_d").isNotNull() & (F.col("page_number") == 2), summary),
            "confidence": F.least(share, F.lit(10_000.0)) / 10_000,
            "error": error.otherwise(F.when(F.col("_d").isNull(), "pixels do not fit the size")),
        }
    ).drop("_d", "pixels")


def votes_of(slots: Column) -> Column:
    return rules.digit_votes(F.transform(slots, lambda s: s["digit"]))


# --- rows by projection


def islands(profile: np.ndarray, gap: int = 20) -> list[tuple[int, int]]:
    """(first, last) of the stretches of a profile's places that are over half its mean, joined over gaps up to `gap`;
    stretches whose ends are under `gap` apart are left out."""
    places = np.flatnonzero(2 * len(profile) * profile > profile.sum())
    if not len(places):
        return []
    new = np.flatnonzero(np.diff(places) > gap) + 1
    first, last = places[np.append(0, new)], places[np.append(new, len(places)) - 1]
    return [(int(a), int(b)) for a, b in zip(first, last, strict=True) if b - a >= gap]


def row_islands(pages: DataFrame, gap: int = 20, below: int = 180, name: str = "rows") -> DataFrame:
    """Adds the islands of each page's profile of dark pixels."""
    return measured(pages, lambda array: [[{"first": a, "last": b} for a, b in islands(p, gap)] for p in (array < below).sum(2)], name, "array<struct<first:int,last:int>>")


def vote_cells(pages: DataFrame, gap: int = 20) -> DataFrame:
    """One row for each row of votes of table images: candidate_index, its box in pixels (x, y, w, h) and in shares of
    the image (nx, ny, nw, nh). Without any row found, eight rows of equal height."""
    rows = row_islands(pages, gap, name="_rows").drop("pixels")
    each = F.floor(F.col("height") / FALLBACK_ROWS).cast("int")
    equal = F.transform(F.sequence(F.lit(0), F.lit(FALLBACK_ROWS - 1)), lambda i: F.struct((i * each).alias("first"), ((i + 1) * each).alias("last")))
    rows = rows.withColumn("_rows", F.when(F.size("_rows") == 0, equal).otherwise(F.col("_rows")))
    left, right = (F.floor(F.lit(share) * F.col("width")).cast("int") for share in VOTES_COLUMN)
    keep = [c for c in pages.columns if c != "pixels"]
    return rows.select(*keep, F.posexplode("_rows").alias("candidate_index", "_r")).select(
        *keep, "candidate_index", left.alias("x"), F.col("_r.first").alias("y"), (right - left).alias("w"), (F.col("_r.last") - F.col("_r.first")).alias("h"),
        F.lit(VOTES_COLUMN[0]).alias("nx"), (F.col("_r.first") / F.col("height")).alias("ny"), F.lit(VOTES_COLUMN[1] - VOTES_COLUMN[0]).alias("nw"), ((F.col("_r.last") - F.col("_r.first")) / F.col("height")).alias("nh"),
    )


# --- long strokes


def _lying(masks: np.ndarray, least: int, gap: int, thick: float) -> list[list[tuple[int, int, int, int]]]:
    """Strokes of pages of one size that are wider than high: runs of dark pixels, bridged over gaps, that touch from row
    to row. All pages' runs are linked at once; a row's number holds its page."""
    n, h, w = masks.shape
    row, x0, x1 = row_runs(masks)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    if not len(row):
        return out
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (x0[1:] - x1[:-1] - 1 > gap)))
    size = np.add.reduceat(x1 - x0 + 1, new)
    row, x0, x1 = row[new], x0[new], x1[np.append(new[1:], len(row)) - 1]
    label = components(len(row), *links(row, x0, x1, gap + 1))
    owners, label = np.unique(label, return_inverse=True)
    left, right = np.full(len(owners), w), np.full(len(owners), -1)
    np.minimum.at(left, label, x0)
    np.maximum.at(right, label, x1)
    wide = right - left + 1
    good = (wide >= least) & (np.bincount(label, size) <= thick * wide)

    def height(at: np.ndarray) -> np.ndarray:
        here = (x0 <= at[label]) & (x1 >= at[label])
        return np.bincount(label[here], row[here], len(owners)) / np.maximum(np.bincount(label[here], minlength=len(owners)), 1)

    y0, y1 = height(left), height(right)
    for k in np.flatnonzero(good & (abs(y1 - y0) <= right - left)):
        page = int(row[owners[k]]) // (h + 1)
        out[page].append((int(left[k]), round(y0[k]) - page * (h + 1), int(right[k]), round(y1[k]) - page * (h + 1)))
    return out


def strokes(pages: DataFrame, below: int = 128, least: int = 200, gap: int = 10, thick: float = 12.0, name: str = "strokes") -> DataFrame:
    """Adds the long strokes of each page as (x1, y1, x2, y2) from left to right: lines of dark pixels that reach over
    `least` pixels, over gaps up to `gap`, `thick` pixels thick on average at most; lying ones first, then standing ones.
    Found by runs of pixels that touch from row to row, so a slanted line is one stroke."""

    def measure(array: np.ndarray) -> list:
        dark = array < below
        standing = [[(y1, x1, y2, x2) for x1, y1, x2, y2 in page if x2 - x1 > abs(y2 - y1)] for page in _lying(dark.transpose(0, 2, 1), least, gap, thick)]
        return [[dict(zip(("x1", "y1", "x2", "y2"), s, strict=True)) for s in [*a, *b]] for a, b in zip(_lying(dark, least, gap, thick), standing, strict=True)]

    return measured(pages, measure, name, "array<struct<x1:int,y1:int,x2:int,y2:int>>")


def rotation_of(strokes: Column) -> Column:
    """Median angle in degrees of the nearly level strokes, to two places; 0 for under five strokes of any kind. Level are
    those of dx over 50 and dy under half of it, by under 3 degrees."""
    dx, dy = (lambda s: F.abs(s["x2"] - s["x1"])), (lambda s: F.abs(s["y2"] - s["y1"]))
    level = F.filter(strokes, lambda s: (dx(s) > 50) & (dy(s) < 0.5 * dx(s)))
    angles = F.array_sort(F.filter(F.transform(level, lambda s: F.degrees(F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"]))), lambda a: F.abs(a) < 3))
    n = F.size(angles)
    middle = (F.get(angles, F.floor((n - 1) / 2).cast("int")) + F.get(angles, F.floor(n / 2).cast("int"))) / 2
    return F.when((F.size(strokes) < 5) | (n == 0), 0.0).otherwise(F.round(middle, 2))


# Boxes of signatures as shares (x, y, width, height) of the third page.
SIGNATURES = [(0.15, 0.62, 0.22, 0.10), (0.40, 0.62, 0.22, 0.10), (0.65, 0.62, 0.22, 0.10)]


def signature_ink(pages: DataFrame, name: str = "densities") -> DataFrame:
    """Adds the share of ink in each signature box, by the Otsu threshold of the whole page, to four places."""

    def measure(array: np.ndarray) -> list:
        n, h, w = array.shape
        ink = array <= vision.otsu_levels(array.reshape(n, -1))[:, None, None]
        parts = [ink[:, int(y * h) : int((y + b) * h), int(x * w) : int((x + a) * w)] for x, y, a, b in SIGNATURES]
        return np.stack([p.mean((1, 2)) if p.size else np.zeros(n) for p in parts], 1).round(4).tolist()

    return measured(pages, measure, name, "array<double>")


def render_zoom(width: Column, height: Column, dpi: float = 300, most: float = 150.0) -> Column:
    """Zoom of a page of width x height points so that it has `dpi` dots an inch, less where it would have over `most`
    million pixels; no limit if that is 0."""
    zoom = dpi / 72
    million = width * zoom * (height * zoom) / 1e6
    return F.when((F.lit(most) > 0) & (million > most), zoom * F.sqrt(most / million)).otherwise(zoom)


def ink_share(pages: DataFrame, top: float, below: int = 100, name: str = "ink") -> DataFrame:
    """Adds the share of dark pixels from a share of the height on; null where nothing is left below it."""

    def measure(array: np.ndarray) -> list:
        zone = array[:, int(array.shape[1] * top) :]
        return (zone < below).mean((1, 2)).tolist() if zone.size else [None] * len(array)

    return measured(pages, measure, name, "double")


# --- fixed cells

# Cells (x, y, width, height) of the votes on the first two pages, of pages of 3630 x 10900 pixels.
CELLS = {
    1: {"votos_candidato_1": (1300, 6700, 800, 300), "votos_candidato_2": (2700, 6700, 800, 300)},
    2: {"votos_blanco": (1300, 7100, 800, 300), "votos_nulos": (2700, 7100, 800, 300), "votos_no_marcados": (1900, 7500, 800, 300)},
}


def cut_out(box: tuple[int, int, int, int], height: int, width: int) -> tuple[slice, slice]:
    """Rows and columns of a box (x, y, w, h) within a page; none where it lies beyond."""
    x, y, w, h = box
    x0, y0 = max(0, min(x, width)), max(0, min(y, height))
    return slice(y0, min(height, y0 + h)), slice(x0, min(width, x0 + w))


def cell_scores(pages: DataFrame, cells: dict[int, dict[str, tuple[int, int, int, int]]] | None = None) -> DataFrame:
    """One row for each fixed cell of each page: campo, grosor, separador, tinta and their blend 0.3 / 0.4 / 0.3; a cell
    beyond the page scores 0. Pages without fixed cells give none."""
    known = cells or CELLS
    names = ("stroke", "separator", "dark")

    def measure(array: np.ndarray, numbers: list) -> list:
        out: list = [[] for _ in numbers]
        for number, boxes in known.items():
            mine = [k for k, x in enumerate(numbers) if x == number]
            for field, box in boxes.items() if mine else ():
                part = array[(mine, *cut_out(box, *array.shape[1:]))]
                found = vision.upload_features_of(part.astype(np.int64)) if part.size else dict.fromkeys(names, np.zeros(len(mine)))
                for i, k in enumerate(mine):
                    out[k].append({"campo": field} | {n: float(found[n][i]) for n in names})
        return out

    scored = measured(pages, measure, "_c", "array<struct<campo:string,stroke:double,separator:double,dark:double>>", "page_number")
    keep = [c for c in pages.columns if c != "pixels"]
    rows = scored.select(*keep, F.explode("_c").alias("_c")).select(*keep, "_c.campo", F.col("_c.stroke").alias("grosor"), F.col("_c.separator").alias("separador"), F.col("_c.dark").alias("tinta"))
    return rows.withColumn("score", 0.3 * F.col("grosor") + 0.4 * F.col("separador") + 0.3 * F.col("tinta"))


# --- rotation and size


def sampled(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gray values at any places, between the four pixels around each; beyond the border the border's."""
    h, w = page.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(np.int64), max(h - 2, 0)), np.minimum(x.astype(np.int64), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    top = page[y0, x0] * (1 - fx) + page[y0, x1] * fx
    low = page[y1, x0] * (1 - fx) + page[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def cubic_weights(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four pixels about a place that lies t behind the second (a = -0.75)."""
    a, u = -0.75, 1 - t
    outer = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    inner = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    return [outer(t + 1), inner(t), inner(u), outer(u + 1)]


def cubic(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Gray values at any places by cubic interpolation of the 4 x 4 pixels around each; beyond the border the border's."""
    h, w = page.shape
    y, x = np.clip(y, -1, h), np.clip(x, -1, w)  # farther out all four pixels are the border's
    y0, x0 = np.floor(y), np.floor(x)
    flat = np.pad(page, ((2, 3), (2, 3)), "edge").ravel()
    across, down = cubic_weights((x - x0).astype(np.float32)), cubic_weights((y - y0).astype(np.float32))
    first = (y0.astype(np.int64) + 1) * (w + 5) + x0.astype(np.int64) + 1
    out = np.zeros(first.shape, np.float32)
    for i, weight in enumerate(down):
        line = flat[i * (w + 5) :]
        out += weight * sum(across[j] * line[j:].take(first, mode="clip") for j in range(4))
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


def turned(page: np.ndarray, angle: float) -> np.ndarray:
    """The page turned by `angle` degrees (counter-clockwise) about its middle, on a page large enough for all of it."""
    h, w = page.shape
    cos, sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    new_w, new_h = int(w * abs(cos) + h * abs(sin)), int(w * abs(sin) + h * abs(cos))
    x = np.arange(new_w)[None, :] - w // 2 - (new_w - w) / 2
    rows = np.arange(new_h)[:, None] - h // 2 - (new_h - h) / 2
    step = max(1, BATCH_PIXELS // 4 // max(new_w, 1))
    parts = (rows[a : a + step] for a in range(0, new_h, step))
    return np.concatenate([np.zeros((0, new_w), np.uint8), *(cubic(page, sin * x + cos * y + h // 2, cos * x - sin * y + w // 2) for y in parts)])


def resized(page: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = page.shape
    return sampled(page, *np.meshgrid((np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5, indexing="ij"))


_IMAGE = "struct<height:int,width:int,pixels:binary>"


def _image(page: np.ndarray) -> dict:
    return {"height": page.shape[0], "width": page.shape[1], "pixels": np.ascontiguousarray(page).tobytes()}


def _with_image(pages: DataFrame) -> DataFrame:
    return pages.withColumns({c: F.col(f"_image.{c}") for c in ("height", "width", "pixels")}).drop("_image")


def deskewed(pages: DataFrame, angle: str = "angle", least: float = 0.1) -> DataFrame:
    """Pages turned back by the column `angle`, which replaces pixels and size; angles under `least` change nothing, a
    null angle neither."""
    return _with_image(measured(pages, lambda array, angles: [_image(turned(p, a) if a is not None and abs(a) >= least else p) for p, a in zip(array, angles, strict=True)], "_image", _IMAGE, angle))


def normalised(pages: DataFrame, size: tuple[int, int] = STANDARD, **lines) -> DataFrame:
    """Pages without skew, in the standard size (width, height), with rotation_corrected, the original size and whether
    the sides have the standard proportion at the end."""
    width, height = size
    pages = strokes(pages, **lines).withColumn("rotation_corrected", rotation_of(F.col("strokes"))).drop("strokes")
    pages = pages.withColumns({"original_height": F.col("height"), "original_width": F.col("width")})
    # As in deskewed(), but an angle of just 0.1 counts as none here too.
    pages = _with_image(measured(pages, lambda array, angles: [_image(resized(turned(p, a) if a and abs(a) > 0.1 else p, height, width)) for p, a in zip(array, angles, strict=True)], "_image", _IMAGE, "rotation_corrected"))
    return pages.withColumn("aspect_ratio_preserved", F.abs(F.col("width") / F.col("height") - width / height) < 0.01)
