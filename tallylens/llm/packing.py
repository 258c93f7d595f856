"""Packing of tokenised documents into training windows by the sum-of-squares rule.

Each partition packs its own documents as they stream by, so nothing is shuffled and a lost partition is packed again in
the same way. A document longer than a window first fills whole windows; what remains is one item. A level array counts
the partially filled windows of each fill (in steps of 1/LEVELS of a window). For an item, three kinds of places are
weighed by how much the sum of the squared counts grows: an open window that takes all of it, a new window, and an open
window that takes as much as fits and is then full, the rest going on as an item of its own; this costs CUT more, as it
cuts the document. The least growth wins; ties go to whole items, then to the fullest window. A window that is full is
written at once. As soon as several windows share a level, cutting into them is cheaper than opening another, so about
LEVELS * CUT / 2 windows are open at most, whatever the input. At the end of the partition the fullest windows are
filled from the emptiest ones, and the last, shorter remainder is cut at powers of two, which need no padding.

Defined results: a null text is empty and has its end id alone; repeated rows are packed each; an empty table
gives no rows; other columns of the input are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import task
from .encode import MEMO_ENTRIES, default_tokenizer, encoder, text_slices

WINDOW = 2048
END_ID = 1
#: Fill levels of a window, and the growth of the sum of squares that a cut must save.
LEVELS, CUT = 32, 4

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Sum-of-squares packing of one partition; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, base: int, keep_ids: bool = False):
        self.window, self.next_id, self.keep_ids = window, base, keep_ids
        self.step = max(window // LEVELS, 1)
        self.level = [0] * (window // self.step + 1)
        self.open: list[list] = []  # [sequence, pieces]
        self.fill: list[int] = []  # of the open windows, in the same order
        self.rows, self.moved = [], 0

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _write(self, sequence: int, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            row = (doc_id, start, n, zlib.crc32(ids), total, sequence, at)
            self.rows.append(row + (ids,) if self.keep_ids else row)
            at += n

    def place(self, s: int) -> int:
        """The open window that takes an item of s ids, whole or cut, or -1 for a new one."""
        n, step, window = self.level, self.step, self.window
        best, least = -1, (2 * n[s // step] + 1, 1, 0)  # a new window, after whole items and before cuts
        for k, fill in enumerate(self.fill):
            end, old = fill + s, fill // step
            if end < window:
                new = end // step
                growth = (0 if new == old else 2 * (n[new] - n[old]) + 2, 0, -fill)
            elif end == window:
                growth = (1 - 2 * n[old], 0, -fill)
            else:
                rest = (end - window) // step
                growth = (1 - 2 * n[old] + 2 * (n[rest] - (rest == old)) + 1 + CUT, 2, -fill)
            if growth < least:
                best, least = k, growth
        return best

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window * 4
        whole = len(ids) - len(ids) % step
        for k in range(0, whole, step):
            self._write(self._new(), [(doc_id, k // 4, ids[k : k + step], total)])
        start, ids = whole // 4, ids[whole:]
        while ids:
            at = self.place(len(ids) // 4)
            last = len(self.open) - 1
            if at < 0:
                fill, window = 0, [self._new(), []]
            else:  # the last open window takes its place
                fill, window = self.fill[at], self.open[at]
                self.open[at], self.fill[at] = self.open[last], self.fill[last]
                self.open.pop()
                self.fill.pop()
                self.level[fill // self.step] -= 1
            n = min(self.window - fill, len(ids) // 4)
            fill += n
            window[1].append((doc_id, start, ids[: 4 * n], total))
            start, ids = start + n, ids[4 * n :]
            if fill == self.window:
                self._write(*window)
                continue
            self.level[fill // self.step] += 1
            self.fill.append(fill)
            self.open.append(window)

    def finish(self) -> None:
        """Fill the fullest open windows from the emptiest, and cut the last one at powers of two."""
        left = sorted(([f, *w] for f, w in zip(self.fill, self.open, strict=True)), key=lambda w: (-w[0], w[1]))
        self.open, self.fill, self.level = [], [], [0] * len(self.level)
        while left:
            fill, sequence, pieces = left.pop(0)
            while fill < self.window and left:
                doc_id, start, ids, total = left[-1][2].pop()
                n = min(self.window - fill, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * n], total))
                fill, self.moved = fill + n, self.moved + n
                if 4 * n < len(ids):
                    left[-1][2].append((doc_id, start + n, ids[4 * n :], total))
                left[-1][0] -= n
                if not left[-1][2]:
                    left.pop()
            if fill == self.window:
                self._write(sequence, pieces)
                continue
            while pieces:  # the last window, shorter than all others
                room, held = 1 << (sum(len(p[2]) // 4 for p in pieces).bit_length() - 1), []
                while room:
                    doc_id, start, ids, total = pieces.pop(0)
                    n = min(room, len(ids) // 4)
                    held.append((doc_id, start, ids[: 4 * n], total))
                    room -= n
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc_id, start + n, ids[4 * n :], total))
                self._write(self._new(), held)

    def take(self) -> list:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, memo: int = MEMO_ENTRIES) -> DataFrame:
    """Pieces of all documents with their sequence and offset; with_ids adds the ids themselves (little-endian
    binary); memo bounds the chunks whose ids a worker keeps, which changes its memory and time only."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.binary())] * with_ids)

    @task("encode")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40, with_ids)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, some in text_slices(batch.column(1)):
                for doc_id, ids in zip(doc_ids[a:b], encoder(path, memo).encode(some), strict=True):
                    packer.add(doc_id, ids + end)
                if rows := packer.take():
                    yield _batch(rows, schema)
        packer.finish()
        if rows := packer.take():
            yield _batch(rows, schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
