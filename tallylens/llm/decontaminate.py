"""Benchmark decontamination by template canonicalisation.

Words (letters, digits and bytes from 0x80) become typed placeholders where they are numbers (any digit in them),
units (a fixed list) or names (capitalised and not first in a sentence); the others are lower-cased. Windows of
WINDOW words of every item, with at least LITERAL literal words, are hashed; shorter items
are one window of their own length, and so are longer items none of whose windows has LITERAL literal words,
if the whole has them. A capitalised first word of an item is tried as a literal and as a name. Windows of the plain
lower-cased words, with no condition, are hashed in the same pass, as an exact copy may stand in other letter case or
hold few literal words; an item of one word only is thus in every document with this word. A bitmap of at most BITS bits over the window hashes is broadcast and
the documents' windows are tested against it where they are read, so that only hits with their slot values are
shuffled to the exact hash join with the items' windows.

A run is what one document and one item share at one distance between their places. It counts if it has RUN
windows, or all of a shorter item; of templates only stretches of adjacent windows count whose slots are consistent: within the
stretch, equal values of the item stand for equal values of the document. A run with other values is a
re-parameterised question, one with equal values an exact passage; so are plain words, if they are the whole item or
no template run counts.

Defined results: one row per contaminated document and item; null and empty texts and items, and those
without a word, match nothing; repeated documents or items are reported for each distinct (doc_id, item_id);
null ids are reported as null; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, lowered, mixed, row_ends, run_hashes, runs, settle, task, texts

WINDOW, LITERAL, RUN = 8, 4, 4
BITS = 1 << 27

# Units of measure and money.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons pound pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees kmh mph watt watts volt volts".split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63, 10]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMBER, _UNIT, _NAME = np.uint64(0x4E554D), np.uint64(0x554E4954), np.uint64(0x4E414D45)


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(run_hashes(raw, np.concatenate([[0], ends[:-1]]), ends))


def canonical(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, slot value or 0, row, hash of the word, whether it is capitalised where all words are) of each word."""
    low = lowered(raw)
    starts, ends, rows = runs(_WORD[raw], offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), rows, np.zeros(0, np.uint64), np.zeros(0, bool)
    value = run_hashes(low, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    number = digits[ends] > digits[starts]
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value
    head = raw[starts]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    first = np.ones(len(starts), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    name = capital & ~first & ~number & ~unit
    template = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return template, np.where(number | unit | name, value | np.uint64(1), np.uint64(0)), rows, value, capital & first & ~number & ~unit


def windows(template: np.ndarray, slot: np.ndarray | None, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the windows of `size` words within a row that have LITERAL literal words, or with
    plain words (no slots) of all."""
    room = len(template) - size + 1
    if room <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(room, size, np.uint64)
    for k in range(size):
        h = (h ^ template[k : k + room]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    good = rows[:room] == rows[size - 1 :]
    if slot is not None:
        literal = np.concatenate([[0], np.cumsum(slot == 0)])
        good &= literal[size:] - literal[:room] >= LITERAL
    at = np.flatnonzero(good)
    return at, mixed(h[at])


_SCHEMA = "id long, at int, h long, size int, words int, slots array<long>"
_KINDS = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("size", pa.int32()), ("words", pa.int32()), ("slots", pa.list_(pa.int64()))])


def _rows(ids, slot, rows, at, h, size, n) -> pa.RecordBatch:
    """Windows with their slots; plain ones (slot is None) have none and a size below 0."""
    first, width = row_ends(rows, n), size
    if slot is None:
        size, width = -size, 0
    slots = np.stack([slot[at + k] for k in range(width)], 1).view(np.int64) if len(at) and width else np.zeros((len(at), width), np.int64)
    flat = pa.array(slots.reshape(-1))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows[at])), pa.array((at - first[rows[at]]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(np.diff(first)[rows[at]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(width)), flat)],
        schema=_KINDS,
    )


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of all items: id, at, h, size (below 0 for plain words), words, slots."""

    @task("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in blocks(*texts(batch.column(1))):
                template, slot, rows, value, maybe = canonical(raw, offs)
                words, ids = np.bincount(rows, minlength=b - a), batch.column(0).slice(a, b - a)
                head = row_ends(rows, b - a)[:-1]
                maybe[np.setdiff1d(np.arange(len(rows)), head)] = False  # an item's first word alone
                named, held = np.where(maybe, _NAME, template), np.where(maybe, value | np.uint64(1), slot)
                found = np.zeros(b - a, bool)
                for size in range(1, WINDOW + 1):
                    for t, v in ((template, slot), (named, held), (value, None)):
                        at, h = windows(t, v, rows, size)
                        own = words[rows[at]]
                        fit = own >= WINDOW if size == WINDOW else own == size
                        if t is named:
                            fit &= maybe[at]
                        elif v is not None:
                            found[rows[at[fit]]] = True
                        yield _rows(ids, v, rows, at[fit], h[fit], size, b - a)
                bare = ~found & (words > WINDOW)
                for size in np.unique(words[bare]).tolist():
                    for t, v in ((template, slot), (named, held)):
                        at, h = windows(t, v, rows, size)
                        fit = bare[rows[at]] & (words[rows[at]] == size) & (maybe[at] | (t is template))
                        yield _rows(ids, v, rows, at[fit], h[fit], size, b - a)

    return items.selectExpr("cast(item_id as long) id", "text").mapInArrow(run, _SCHEMA)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, kind of every contaminated document and its items."""
    spark = docs.sparkSession
    wanted = settle(item_windows(items), "bench-windows")
    plain = F.col("size") < 0
    total = wanted.groupBy("id", plain.alias("of_plain")).agg(F.countDistinct("at").alias("item_windows"))
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # a few, and the lengths of items without templates
    count = wanted.count()
    bits = max(min(1 << (64 * count).bit_length(), BITS), 1 << 15)
    hashed = F.col("h").bitwiseAND(bits - 1)
    marks = wanted.select(F.floor(hashed / 32768).alias("block"), (hashed % 32768).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros((bits // 32768, 4096), np.uint8)
    for r in marks.collect():  # BITS bits at most
        bitmap[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    filter_ = spark.sparkContext.broadcast(bitmap.reshape(-1))

    @task("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = filter_.value
        for batch in batches:
            for a, b, raw, offs in blocks(*texts(batch.column(1))):
                template, slot, rows, value, _ = canonical(raw, offs)
                for size in sizes:
                    at, h = windows(template, slot, rows, size) if size > 0 else windows(value, None, rows, -size)
                    low = h & np.uint64(bits - 1)
                    hit = (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    if hit.any():
                        yield _rows(batch.column(0).slice(a, b - a), slot if size > 0 else None, rows, at[hit], h[hit], abs(size), b - a)

    hits = docs.selectExpr("cast(doc_id as long) id", "text").mapInArrow(run, _SCHEMA)
    d = hits.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "h", "size", F.col("slots").alias("doc_slots"))
    rank = F.dense_rank().over(Window.partitionBy("id", plain).orderBy("at"))  # adjacent windows differ by 1
    b = wanted.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "h", "size", F.col("slots").alias("item_slots"), rank.alias("rank"))
    pairs = F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda p: p["item_slots"] != 0)
    met = d.join(b, ["h", "size"]).select("doc_id", "item_id", plain.alias("plain"), "rank", (F.col("doc_at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"))
    key = ["doc_id", "item_id", "plain", "shift"]
    stretch = F.col("rank") - F.dense_rank().over(Window.partitionBy(*key).orderBy("rank"))
    runs_ = met.withColumn("stretch", stretch).groupBy(*key, "stretch").agg(F.countDistinct("rank").alias("n"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    equal = F.forall("pairs", lambda p: p["item_slots"] == p["doc_slots"])
    kept = runs_.where(consistent).groupBy(*key).agg(F.sum("n").alias("n"), F.min(equal).alias("equal"))
    good = kept.join(total, F.col("item_id").eqNullSafe(F.col("id")) & (F.col("plain") == F.col("of_plain"))).where(F.col("n") >= F.least(F.lit(RUN), "item_windows"))
    exact = F.when(F.col("plain"), F.col("n") == F.col("item_windows")).otherwise(F.col("equal"))  # plain words, unless only a part beside other values
    return good.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.when(F.max(exact) | F.min("plain"), "exact").otherwise("reparameterised").alias("kind"))
