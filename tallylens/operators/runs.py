"""Connected runs of pixels in NumPy: rows of many images of one size are searched and linked at once."""

from __future__ import annotations

import numpy as np


def row_runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set pixels of images (n, h, w), in order; image k has the rows from k * (h + 1) on,
    so that an empty row parts neighbours."""
    h, w = masks.shape[1:]
    edge = np.diff(np.pad(masks.reshape(-1, w), ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row + row // h, first, np.nonzero(edge == -1)[1] - 1


def links(row: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that overlap, or are up to `reach` columns apart (1: they touch by a corner)."""
    span = int(last.max(initial=0)) + 2 * reach + 2
    begin = np.searchsorted(row * span + last, (row + 1) * span + np.maximum(first - reach, 0))
    stop = np.searchsorted(row * span + first, (row + 1) * span + np.minimum(last + reach, span - 1), side="right")
    count = np.maximum(stop - begin, 0)
    upper = np.repeat(np.arange(len(row)), count)
    return upper, np.arange(len(upper)) + np.repeat(begin - np.cumsum(count) + count, count)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in each one's component of n things, of which the pairs (a, b) belong together."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(masks: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Number of the component of each set pixel of images (n, h, w), 0 elsewhere: the place of its first pixel in its
    image, row by row from 1."""
    n, h, w = masks.shape
    row, first, last = row_runs(masks)
    owner = components(len(row), *links(row, first, last, int(diagonal)))
    number = row[owner] % (h + 1) * w + first[owner] + 1
    out = np.zeros(n * h * w, np.int64)
    out[masks.reshape(-1)] = np.repeat(number, last - first + 1)
    return out.reshape(masks.shape)
