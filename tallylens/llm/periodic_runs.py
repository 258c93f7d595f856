"""Runs: maximal stretches of words that repeat with a period, by Main and Lorentz's divide and conquer.

The words of a text are interned. Blocks of 2h words are halved at a midpoint m; a run that crosses m and spans four of
its periods p has two whole periods on one side of m, so there the Z-function of that half, taken from m (or backwards
from m - 1), reaches p at distance p: Z(p) >= p. All midpoints of one level, of all texts of a block of rows, are compared
at once: each step asks one more word of every (midpoint, p) that is still equal, so few are left after some steps.
What is left is settled in ascending order of p: the rest of Z(p) >= p, the extension to both sides, and, with the run,
the end of all candidates inside it whose distance is a multiple of p. So each run is extended once and is known by its
smallest period, and the work is near-linear on texts of one repeated word as well.

Defined results: a null or empty text has no words and no runs; a run shorter than `least` words or `times` periods doesn't
count. Rows keep all their columns; repeated rows and null ids are rows as others. A text of any length is one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WHITE, blocks, row_ends, runs, task, texts

#: Words that all candidates of a level are compared on together.
STEPS = 8
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def interned(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the words of all rows, the place where each row's words begin, and the distinct words."""
    starts, ends, rows = runs(~WHITE[raw], offs)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    data = np.ascontiguousarray(raw[~WHITE[raw]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), row_ends(rows, len(offs) - 1), coded.dictionary


def _level(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of all blocks of 2h words: (row, start of two equal stretches of p words, p); min(p, STEPS) of the words
    are compared so far. `w` ends with STEPS numbers
    that no word has."""
    count = np.maximum((hi - lo - 1) // h + 1, 0) // 2  # midpoints lo + h, lo + 3h, ... below hi
    row = np.repeat(np.arange(len(lo)), count)
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    mid = lo[row] + h + 2 * h * nth
    found = []
    p = np.arange(1, h // 2 + 1)
    part = max(1, (1 << 22) // len(p))
    for a in range(0, len(mid), part):
        m = mid[a : a + part]
        right = np.minimum(m[:, None] + p, len(w) - 1)
        for forward, equal in ((True, w[m][:, None] == w[right]), (False, w[m - 1][:, None] == w[m[:, None] - 1 - p])):
            k, q = np.nonzero(equal)
            at, q = m[k], q + 1
            if forward:
                fits = at + 2 * q <= hi[row[a + k]]
                k, at, q = k[fits], at[fits], q[fits]
            for t in range(1, STEPS):
                x = at + t if forward else at - 1 - t
                keep = (q <= t) | (w[x] == w[np.where(q > t, x + q if forward else x - q, x)])
                k, at, q = k[keep], at[keep], q[keep]
            found.append((row[a + k], at if forward else at - 2 * q, q))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _equal(w: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words from a and b on (backwards if step is -1) are equal, at most `limit`; looks at growing stretches."""
    done, size = 0, 8
    while done < limit:
        n = min(size, limit - done)
        if step > 0:
            unlike = w[a + done : a + done + n] != w[b + done : b + done + n]
        else:
            unlike = w[a - done - n + 1 : a - done + 1][::-1] != w[b - done - n + 1 : b - done + 1][::-1]
        k = int(unlike.argmax())
        if unlike[k]:
            return done + k
        done, size = done + n, size * 2
    return done


def _settled(w: np.ndarray, lo: int, hi: int, starts: np.ndarray, periods: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of one row's runs from its candidates."""
    by_place = np.argsort(starts, kind="stable")
    starts, periods = starts[by_place], periods[by_place]
    alive, found = np.ones(len(starts), bool), []
    for k in np.lexsort((starts, periods)).tolist():
        if not alive[k]:
            continue
        a, p = int(starts[k]), int(periods[k])
        if p > STEPS and _equal(w, a, a + p, p, 1) < p:
            continue
        begin = a - _equal(w, a - 1, a + p - 1, a - lo, -1)
        end = a + 2 * p + _equal(w, a + p, a + 2 * p, hi - a - 2 * p, 1)
        if end - begin >= max(least, times * p):
            found.append((begin - lo, end - begin, p))
            inside = slice(*np.searchsorted(starts, (begin, end)))
            alive[inside] &= (periods[inside] % p != 0) | (starts[inside] + 2 * periods[inside] > end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(w: np.ndarray, offs: np.ndarray, least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each row that has any; row r has the words w[offs[r]:offs[r + 1]]."""
    lo, hi = offs[:-1], offs[1:]
    w = np.concatenate([w, np.full(STEPS, -1, w.dtype)])
    h, levels, longest = 4, [], int((hi - lo).max(initial=0))
    while h < longest:
        levels.append(_level(w, lo, hi, h))
        h *= 2
    if not levels:
        return {}
    row, start, period = (np.concatenate(c) for c in zip(*levels, strict=True))
    order = np.argsort(row, kind="stable")
    row, start, period = row[order], start[order], period[order]
    cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    out = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        r = int(row[a])
        if found := _settled(w, int(lo[r]), int(hi[r]), start[a:b], period[a:b], least, times):
            out[r] = found
    return out


def _joined(w: np.ndarray, offs: np.ndarray, words: pa.Array) -> pa.Array:
    """The words of each row, joined by single spaces."""
    taken = words.take(pa.array(w))
    _, places, data = taken.buffers()
    places = np.frombuffer(places, np.int64)[taken.offset : taken.offset + len(w) + 1]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if len(w) else np.zeros(0, np.uint8)
    spaced = np.ones(len(w), bool)
    spaced[offs[:-1][offs[:-1] < offs[1:]]] = False  # none before the first word of a row
    gaps = np.concatenate([[0], np.cumsum(spaced)])
    out = np.full(len(data) + int(gaps[-1]), 0x20, np.uint8)
    if len(w):
        out[np.arange(len(data)) + np.repeat(gaps[1:], np.diff(places))] = data
    ends = (places - places[0] + gaps)[offs] if len(w) else np.zeros(len(offs), np.int64)
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(out))


def _finder(text_at: int, least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @task("periodic_runs")
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(*texts(batch.column(text_at))):
                w, at, words = interned(raw, offs)
                found = runs_of(w, at, least, times)
                change = np.zeros(len(w) + 1, np.int64)
                for r, some in found.items():
                    for s, n, p in some:
                        change[at[r] + s + p] += 1
                        change[at[r] + s + n] -= 1
                kept = np.cumsum(change[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[at]
                counts = np.array([len(found.get(r, ())) for r in range(b - a)], np.int32)
                flat = np.array([x for r in sorted(found) for x in found[r]], np.int64).reshape(-1, 3)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_RUN)),
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(np.diff(at)), listed, _joined(w[kept], left, words)],
                    names=[str(k) for k in range(batch.num_columns + 3)],
                )

    return find


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """All rows and columns of docs with n_words, runs (array of start, length, period by start, then period) and
    collapsed: the words joined by one space, where each run is left with one period. Columns of these names are
    replaced."""
    if times < 4:
        raise ValueError("a run must span four periods at least: below, it may have no two whole periods in one half")
    own = ("n_words", "runs", "collapsed")
    docs = docs.select([c for c in docs.columns if c not in own or c == text])
    kept = StructType([f for f in docs.schema if f.name not in own])
    numbered = docs.toDF(*[str(k) for k in range(len(docs.columns))])
    schema = StructType([*numbered.schema, *StructType.fromDDL(FOUND)])
    schema = StructType([f.__class__(str(k), f.dataType, True) for k, f in enumerate(schema)])
    out = numbered.mapInArrow(_finder(docs.columns.index(text), least, times), schema).toDF(*docs.columns, *[f"found.{c}" for c in own])
    return out.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`found.{c}`").alias(c) for c in own])


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each tenth document, by h = crc32 of its decimal id, repeats a stretch of its words from word
    a on: word i becomes word a + (i - a) % p, with g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id
    changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        picked = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(picked, " ")).otherwise("")

    # A one-element array names the list of words, so it is made once and not for every word.
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.element_at(F.transform(words, tail), 1)).otherwise(F.col("text")).alias("text"))


def digest_runs(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run (start, length, period, exponent_milli; nulls if none) and SHA-256 sums of all runs
    and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("top.col2")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.col3")).alias("period"),
        F.expr("1000 * top.length div -top.col3").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
