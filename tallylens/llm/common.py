"""Helpers shared by the corpus operators: Arrow blocks of text, word hashes, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy block works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_ROOT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; a null id counts as the empty text (remainder 0)."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of our own on a
    local master, as in tests; a cluster has no such folder, so there the setting is required."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallylens-")
        where = _own[context.applicationId]
    return where.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Functions that drop what a module keeps in a worker between tasks.
KEPT: list[Callable[[], None]] = []
_last = [""]


def released() -> None:
    """Give freed memory back to the system: Arrow's pool and, where the C library can, its own heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def begun(operator: str) -> None:
    if _last[0] != operator:
        for drop in KEPT:
            drop()
        released()
        _last[0] = operator


def task(operator: str) -> Callable:
    """Marks a function over Arrow batches as a task of that operator. A worker that turns to another operator first
    drops what it kept for the last one, and every task gives back freed memory at its end."""

    def mark(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun(operator)
            yield from function(batches)
            released()

        return run

    return mark


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Arrow batches of at most so many rows to Python, which bounds what a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def blocks(raw: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of at most `limit` bytes, or of one longer row."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of `inside`; runs end with their row."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _small() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT.append(_small)


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        for k, base in enumerate((_ROOT, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, from one polynomial prefix sum over the block."""
    power, inverse = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def row_ends(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows' entries begin and end in the sorted `rows`: n + 1 positions."""
    return np.searchsorted(rows, np.arange(n + 1))


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
