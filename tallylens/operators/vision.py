"""Ink features of small gray cells, by NumPy over Arrow batches; bands and blends are Column expressions in rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import labelled


def otsu_levels(cells: np.ndarray) -> np.ndarray:
    """The threshold of the largest between-class variance of each of (n, m) gray values; the lowest on a tie."""
    n = len(cells)
    hist = np.bincount((np.arange(n)[:, None] * 256 + cells).ravel(), minlength=n * 256).reshape(n, 256).astype(np.float64)
    weight, mean = hist.cumsum(1), (hist * np.arange(256)).cumsum(1)
    rest = weight[:, -1:] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (mean / weight - (mean[:, -1:] - mean) / rest) ** 2
    return np.where(np.isfinite(between), between, -1).argmax(1)


def otsu(pixels: np.ndarray) -> int:
    return int(otsu_levels(pixels.reshape(1, -1))[0])


def distances(masks: np.ndarray) -> np.ndarray:
    """Euclidean distance of set pixels to the nearest unset one of their image (infinite where there is none), columns
    before rows; some rows at a time, so that the pairs of columns stay few."""
    n, h, w = masks.shape
    far = float(h + w) * 2
    rows = np.arange(h)[None, :, None]
    up = np.maximum.accumulate(np.where(masks, -far, rows), axis=1)
    down = np.minimum.accumulate(np.where(masks, far, rows)[:, ::-1], axis=1)[:, ::-1]
    column = np.minimum(rows - up, down - rows).astype(np.float64)
    column[column > h] = np.inf
    column = column.reshape(n * h, w) ** 2
    gaps = (np.arange(w)[:, None] - np.arange(w)) ** 2
    out, step = np.empty_like(column), max(1, (1 << 20) // (w * w))
    for k in range(0, len(column), step):
        out[k : k + step] = (column[k : k + step, None, :] + gaps).min(2)
    return np.sqrt(out).reshape(masks.shape)


def distance(mask: np.ndarray) -> np.ndarray:
    return distances(mask[None])[0]


def middles(values: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Median of the counted values of each row of (n, m); NaN where none is."""
    n = counted.sum(1)
    ordered = np.sort(np.where(counted, values, np.inf), axis=1)
    at = np.arange(len(values))
    with np.errstate(invalid="ignore"):
        found = (ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, np.minimum(n // 2, values.shape[1] - 1)]) / 2
    return np.where(n > 0, found, np.nan)


OUTLINE = ("cell", "area", "length", "x", "y", "w", "h")


def outlines_of(masks: np.ndarray) -> dict[str, np.ndarray]:
    """Cell, area, perimeter and box (x, y, w, h) of the outer contour of each component of images (n, h, w), by image
    and from top to bottom.

    The contour runs through pixel centres. With holes filled, each window of 2 x 2 pixels adds to both: four set pixels
    an area of 1, three half of it and the root of 2 of perimeter, two neighbours 1 and two opposite ones twice the root of
    2 (as a line is walked twice)."""
    n, h, w = masks.shape
    outside = labelled(np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True), False)
    label = labelled(outside[:, 1:-1, 1:-1] != 1)
    label += np.where(label > 0, np.arange(n)[:, None, None] * (h * w + 1), 0)
    names, place = np.unique(label[label > 0], return_inverse=True)
    cell, y, x = np.nonzero(label)
    low_x, low_y = np.full(len(names), w), np.full(len(names), h)
    high_x, high_y = np.full(len(names), -1), np.full(len(names), -1)
    for low, high, v in ((low_x, high_x, x), (low_y, high_y, y)):
        np.minimum.at(low, place, v)
        np.maximum.at(high, place, v)
    p = np.pad(label, ((0, 0), (1, 1), (1, 1)))
    corner = [p[:, :-1, :-1], p[:, :-1, 1:], p[:, 1:, :-1], p[:, 1:, 1:]]  # a window meets one component at most
    a, b, c, d = (k > 0 for k in corner)
    four = a.astype(np.int8) + b + c + d
    opposite = (a == d) & (b == c) & (a != b)
    some = four > 0
    owner = np.searchsorted(names, np.maximum.reduce(corner)[some])
    add = lambda v: np.bincount(owner, v[some], len(names))
    area = add((four == 4) + 0.5 * (four == 3))
    length = add(((four == 2) & ~opposite).astype(np.float64)) + np.sqrt(2) * (add((four == 3).astype(np.float64)) + 2 * add(opposite.astype(np.float64)))
    return dict(zip(OUTLINE, (names // (h * w + 1), area, length, low_x, low_y, high_x - low_x + 1, high_y - low_y + 1), strict=True))


def outlines(mask: np.ndarray) -> list[tuple[float, float, int, int, int, int]]:
    """The outlines of one image."""
    return [tuple(r) for r in zip(*(outlines_of(mask[None])[c].tolist() for c in OUTLINE[1:]), strict=True)]


def _roundness(found: dict[str, np.ndarray]) -> np.ndarray:
    return 4 * np.pi * found["area"] / np.where(found["length"] > 0, found["length"], np.inf) ** 2


def separators(cells: np.ndarray) -> np.ndarray:
    """0.8 for a round spot over 5 % of the cell, 0.6 for a blot over 15 %, by the first spot that is either; else 0. Spots
    from an area of 50 on, from the bottom up, as contour finders list them."""
    found, size = outlines_of(cells <= 127), cells[0].size
    area, big = found["area"], (found["area"] >= 50) & (found["length"] > 0)
    score = np.where((_roundness(found) > 0.7) & (area > 0.05 * size), 0.8, np.where(area > 0.15 * size, 0.6, 0.0))
    hit = big & (score > 0)
    out = np.zeros(len(cells))
    out[found["cell"][hit]] = score[hit]  # in order from the top, so the lowest stays
    return out


def separators_by_area(cells: np.ndarray) -> np.ndarray:
    """Round spots of 150 to 500 by (area - 150) / 200, ragged ones over 100 by (area - 100) / 150; the gravest, 1 at most."""
    found = outlines_of(cells <= 180)
    area, shape = found["area"], _roundness(found)
    spot = np.where((shape > 0.7) & (area > 50) & (area < 500), np.clip((area - 150) / 200, 0, 1), np.where((area > 100) & (shape < 0.5), np.minimum((area - 100) / 150, 1), 0.0))
    out = np.zeros(len(cells))
    counts = (area >= 20) & (found["length"] > 0)
    np.maximum.at(out, found["cell"][counts], spot[counts])
    return out


def stroke_scores(cells: np.ndarray) -> np.ndarray:
    """Thin strokes (under 2) by (2 - t) / 4, thick ones (over 8) by (t - 8) / 8, t being twice the median distance."""
    near = distances(cells <= 180).reshape(len(cells), -1)
    t = 2 * np.nan_to_num(middles(near, near > 0), nan=2.0, posinf=np.inf)
    return np.minimum(1.0, np.where(t < 2, (2 - t) / 4, np.where(t > 8, (t - 8) / 8, 0.0)))


def separator(cell: np.ndarray) -> float:
    return float(separators(cell[None])[0])


def separator_by_area(cell: np.ndarray) -> float:
    return float(separators_by_area(cell[None])[0])


def stroke_score(cell: np.ndarray) -> float:
    return float(stroke_scores(cell[None])[0])


def thirds(a: np.ndarray) -> list[np.ndarray]:
    """Nine parts by whole thirds of the last two sides; what is over at the end belongs to none."""
    h, w = max(a.shape[-2] // 3, 1), max(a.shape[-1] // 3, 1)
    return [p for i in range(3) for j in range(3) if (p := a[..., i * h : (i + 1) * h, j * w : (j + 1) * w]).size]


def eroded(mask: np.ndarray, side: int) -> np.ndarray:
    """Cells whose window of side x side (the centre below and right of the middle) is set; outside counts as set."""
    h, w = mask.shape
    p = np.pad(mask, side, constant_values=True)
    at = side - side // 2
    return np.logical_and.reduce([p[at + y : at + y + h, at + x : at + x + w] for y in range(side) for x in range(side)])


def double_stroke(cell: np.ndarray) -> dict[str, float]:
    """Features of a number written over another, and their score: uneven widths, a wide stroke, ink that outlasts
    erosion, uneven density, overlapping strokes. Strokes are outlines of an area over 30; no score under 2 % of ink."""
    ink = cell <= otsu(cell.reshape(-1))
    share = float(ink.mean())
    out = dict.fromkeys(STROKES, 0.0) | {"ink": share}
    boxes = sorted((x, w, h) for area, _, x, _, w, h in outlines(ink) if area > 30) if share >= 0.02 else []
    if not boxes:
        return out
    widths = [w for _, w, h in boxes if h > 3] or [0]
    mean, top = float(np.mean(widths)), float(max(widths))
    uneven = float(np.std(widths)) / mean if mean else 0.0
    lasting = float(eroded(eroded(ink, 4), 4).sum() / ink.sum())
    spread = float(np.var([p.mean() for p in thirds(ink)]))
    shared = [(min(x + w, v + u) - max(x, v), min(w, u)) for (x, w, _), (v, u, _) in zip(boxes, boxes[1:])]
    over = sum(gap > 0.3 * least for gap, least in shared if gap > 0)
    score = 0.35 * (uneven > 0.8) + 0.15 * (0.4 < uneven <= 0.8) + 0.25 * (lasting > 0.75) + 0.10 * (0.55 < lasting <= 0.75) + 0.15 * (spread > 0.03) + 0.30 * (over > 0)
    score += 0.35 if mean > 25 and top > 2.5 * mean else 0.10 if top > 30 else 0.0
    return out | {"width_mean": mean, "width_max": top, "width_cv": uneven, "erosion": lasting, "density_var": spread, "overlaps": float(over), "score": round(score, 10)}


STROKES = ("ink", "width_mean", "width_max", "width_cv", "erosion", "density_var", "overlaps", "score")


def features_of(cells: np.ndarray) -> dict[str, np.ndarray]:
    n, flat = len(cells), cells.reshape(len(cells), -1)
    dark = cells <= 127
    level = otsu_levels(flat)
    spread = np.mean([p.std((1, 2)) for p in thirds(cells)], axis=0) if min(cells.shape[1:]) >= 10 else np.zeros(n)
    thick = 2 * np.nan_to_num(middles(distances(dark).reshape(n, -1), dark.reshape(n, -1)), nan=0.0, posinf=np.inf)
    return {"ink": dark.mean((1, 2)), "density_std": spread, "otsu": level, "otsu_ink": (flat <= level[:, None]).mean(1), "thickness": thick, "separator": separators(cells)}


def upload_features_of(cells: np.ndarray) -> dict[str, np.ndarray]:
    return {"stroke": stroke_scores(cells), "separator": separators_by_area(cells), "dark": np.clip(((cells < 120).mean((1, 2)) - 0.15) / 0.25, 0, 1)}


def double_strokes_of(cells: np.ndarray) -> dict[str, np.ndarray]:
    each = [double_stroke(c) for c in cells]
    return {name: np.array([r[name] for r in each]) for name in STROKES}


def features(cell: np.ndarray) -> dict[str, float]:
    return {k: v[0] for k, v in features_of(cell[None]).items()}


def upload_features(cell: np.ndarray) -> dict[str, float]:
    return {k: v[0] for k, v in upload_features_of(cell[None]).items()}


#: Cells that are passed on before the next, and pixels that are worked on together.
CELLS, CELL_PIXELS = 1000, 1 << 18


def of_cells(measure, names: tuple[str, ...]):
    """A pandas UDF of a measure of square gray cells (0-255, row by row), which gets all cells of one size of a batch, some
    hundred at a time; cells without pixels have zeros."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType() if n == "otsu" else T.DoubleType()) for n in names]))
    def run(pixels: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in (whole.iloc[a : a + CELLS] for whole in pixels for a in range(0, len(whole), CELLS)):
            out = {n: np.zeros(len(series)) for n in names}
            sides: dict[int, list[int]] = {}
            for k, flat in enumerate(series):
                if side := int(np.sqrt(len(flat) if flat is not None else 0)):
                    sides.setdefault(side, []).append(k)
            for side, found in sides.items():
                step = max(1, CELL_PIXELS // side**2)
                for a in range(0, len(found), step):
                    some = found[a : a + step]
                    cells = np.stack([np.asarray(series.iloc[k][: side * side], np.int64) for k in some]).reshape(-1, side, side)
                    for n, v in measure(np.clip(cells, 0, 255)).items():
                        out[n][some] = v
            yield pd.DataFrame({n: out[n].astype(np.int64) if n == "otsu" else out[n] for n in names})

    return run


#: Share of dark pixels, mean deviation of the nine parts (0 under 10 pixels), Otsu threshold and the ink up to it,
#: twice the median distance within the ink, and the separator's score.
ink_features = of_cells(features_of, ("ink", "density_std", "otsu", "otsu_ink", "thickness", "separator"))
upload_scores = of_cells(upload_features_of, ("stroke", "separator", "dark"))
double_strokes = of_cells(double_strokes_of, STROKES)


def scored_cells(cells: DataFrame, pixels: Column) -> DataFrame:
    """Scores of ink, separator and density of a cell and their mean, four decimals each."""
    from .rules import thickness_band

    spread = F.when(F.col("f.density_std") < 20, 0.0).when(F.col("f.density_std") < 40, 0.3).when(F.col("f.density_std") < 60, 0.6).otherwise(1.0)
    rows = cells.withColumn("f", ink_features(pixels)).withColumns({"score_ink": thickness_band(F.col("f.ink")), "score_separator": F.col("f.separator"), "score_density": spread})
    return rows.withColumn("score", F.round((F.col("score_ink") + F.col("score_separator") + F.col("score_density")) / 3, 4))


def resize(side: int):
    """A pandas UDF that resizes square gray cells to side x side by the nearest pixel."""

    def one(flat) -> np.ndarray:
        a = np.asarray(flat if flat is not None else [], np.int64)
        n = int(np.sqrt(len(a)))
        at = (np.arange(side) * n) // side
        return a[: n * n].reshape(n, n)[np.ix_(at, at)].reshape(-1).astype(np.int32) if n else np.zeros(side * side, np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(pixels: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in pixels:
            for a in range(0, len(series), CELLS):
                yield pd.Series([one(flat) for flat in series.iloc[a : a + CELLS]])

    return run
