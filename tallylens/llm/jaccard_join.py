"""N-gram Jaccard self-join of documents by a grouped prefix join, and its connected classes.

1. Scan. Shingles are hashed to 64 bits. Every document gets the key of its set (a class is all documents with one
   set), and each task counts its shingles and words in CELLS cells.
2. Order. A shingle's level is how far its cell is above the mean, its cost how rare its words are; shingles are
   ordered by level, then rarest words first, then hash. Any fixed order is correct; this one puts shared passages
   and runs of common words behind a document's own words, so they hardly enter a prefix.
3. Groups. Two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles. Classes with the same
   prefix and size are one group with one entry in the inverted lists. Only prefix tokens that occur twice are kept.
4. Pairs. In a group, each member pairs with the first; in each list, each group pairs with the list's first. The
   join makes a row only if sizes, the places of the token and short sketches allow the threshold. Pairs whose long
   sketches allow it too are verified on whole sets, which are read again for the classes in pairs only.
5. Sifts. In lists of over SMALL classes that are not in one component, few members, then more (SIFTS), meet those of
   other components, and components are found anew after each turn. A large group of near copies, of which any two may
   be just under the threshold, so becomes one component by a few pairs for each member, not by all pairs.
6. Rest. Lists whose members, expanded to classes, are not yet in one component go on: lists up to SMALL classes
   (or all, if they cost at most REST tests a class) are tested for all pairs of different components, larger ones
   with some members against all, which then leave the list: as many as REST tests a class allow, PIVOTS at least.
   A pair whose entries both know one of their first PREVIOUS tokens before it is left to that token's list, and one
   that could not reach the threshold if this token were its first common one to the list of an earlier token.
   This ends when every list is in one component or all its pairs were tested: no link between two components is
   missed, while members of one component need not meet.

Defined results: null and empty texts and texts without words have no shingles, link with nothing and are their
own component; texts with fewer words than a shingle have their whole sequence as one; repeated rows and rows
that share a doc_id belong to the classes of their texts; a class of null doc_ids only has a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, batches_of, blocks, lowered, mixed, row_ends, run_hashes, runs, settle, task, texts
from .components import connected_components

CELLS = 1 << 19
#: Bytes of text that one NumPy block works on here.
BLOCK = 1 << 18
#: Rows of an Arrow batch, as texts may be long.
BATCH = 2000
#: 64-bit words of the short sketch in the lists. Bit k of a sketch is the parity of the shingles that hash to k, so
#: sketches differ in at most as many bits as sets differ in shingles; a class's long sketch has over two bits a shingle.
SKETCH = 4
#: Earlier tokens that an entry knows.
PREVIOUS = 4
SMALL = 48
#: Tests for each class in one round over the rest of all lists, and members of a large list that each round takes at least.
REST = 256
PIVOTS = 8
#: Members of a large list that each sift takes at most, on the average; each meets its list once.
SIFTS = (8, 64)
#: Bits of the bitmaps that say which documents are read again and which tokens are kept; false hits are joined away.
BITMAP = 1 << 27
#: Class keys that may be broadcast (8 bytes each).
BROADCAST = 1_000_000
_CHUNK = 1 << 13


def shingles(raw: np.ndarray, offs: np.ndarray, width: int, costs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased rows, where each row's begin (n + 1 positions), and the hashes of all
    words, or with `costs` (by cell) the summed costs of each shingle's words."""
    n = len(offs) - 1
    starts, ends, rows = runs(~WHITE[raw], offs)
    first = row_ends(rows, n)
    words = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    h = run_hashes(raw, starts, ends)
    room = max(len(h) - width + 1, 0)
    joined = np.zeros(len(h), np.uint64)
    for k in range(width):
        joined[:room] = mixed(joined[:room] * np.uint64(0xD6E8FEB86659FD93) + h[k : k + room])
    size = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    keep = np.ones(len(h), bool)
    for k in range(width - 1):  # the last places of a row begin no shingle
        at = first[1:] - 1 - k
        keep[at[(words > k)]] = False
    for r in np.flatnonzero((words > 0) & (words < width)).tolist():
        value = np.array([words[r]], np.uint64)
        for x in h[first[r] : first[r + 1]]:
            value = mixed(value * np.uint64(0xA0761D6478BD642F) + x)
        joined[first[r]] = value[0]
        keep[first[r]] = True
    out = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=out[1:])
    if costs is None:
        return joined[keep], out, h
    own = costs[(h >> np.uint64(45)).astype(np.int64)].astype(np.int64)
    total = np.zeros(len(h), np.int64)
    for k in range(width):
        total[:room] += own[k : k + room]
    return joined[keep], out, total[keep]


def _sets(raw: np.ndarray, offs: np.ndarray, width: int, costs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, int, int, np.ndarray | None]]:
    """(row, sorted distinct shingles, class key, size, costs of the shingles) of rows with shingles."""
    h, first, cost = shingles(raw, offs, width, costs)
    for r in np.flatnonzero(np.diff(first)).tolist():
        own = None
        if costs is None:
            u = np.unique(h[first[r] : first[r + 1]])
        else:
            u, at = np.unique(h[first[r] : first[r + 1]], return_index=True)
            own = cost[first[r] + at]
        s1, s2 = np.add.reduce(u), np.add.reduce(mixed(u ^ np.uint64(0x5851F42D4C957F2D)))
        key = mixed(np.array([s1 ^ np.uint64(len(u)), s2], np.uint64))
        yield r, u, int((key[0] + key[1] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)), len(u), own


def _scanned(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, cid and n of every document (cid is null without shingles), and at the end of each task the counts of
    its shingles and words by cell, packed in chunks; settled."""
    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    @task("join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for a, b, raw, offs in blocks(*texts(batch.column(1)), limit=BLOCK):
                low = lowered(raw)
                h, _, words = shingles(low, offs, width)
                total[:CELLS] += np.bincount((h >> np.uint64(45)).astype(np.int64), minlength=CELLS)
                total[CELLS:] += np.bincount((words >> np.uint64(45)).astype(np.int64), minlength=CELLS)
                cid, n = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                with np.errstate(over="ignore"):
                    for r, _, key, size, _ in _sets(low, offs, width):
                        cid[r], n[r] = key, size
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(cid, mask=n == 0), pa.array(n), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], schema=kinds)
        if total.any():
            parts = [pa.compress(total[k : k + _CHUNK].astype("<i8").tobytes(), "zstd", asbytes=True) for k in range(0, 2 * CELLS, _CHUNK)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=kinds)

    return settle(rows.mapInArrow(run, "doc_id long, mark long, cid long, n long, chunk int, counts binary"), "join-ids")


def cell_levels(scanned: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell: the level of shingles (0 up to 1.3 times the mean count, then four to each doubling), and the cost of
    words (four to each halving of their share, 255 / width at most)."""

    @task("join")
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(pa.decompress(raw.as_buffer(), 8 * _CHUNK, "zstd"), "<i8")
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    parts = scanned.where("chunk is not null").select("chunk", "counts").repartition(2 * CELLS // _CHUNK, "chunk")
    total = np.zeros(2 * CELLS, np.int64)
    for r in parts.mapInArrow(add, "chunk int, counts binary").collect():  # 2 x CELLS counts
        total[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, "<i8")
    ratio = total[:CELLS] / max(total[:CELLS].mean(), 1.0)
    levels = np.where(ratio < 1.3, 0, np.minimum(1 + np.floor(4 * np.log2(np.maximum(ratio, 1))), 127)).astype(np.uint8)
    share = np.maximum(total[CELLS:], 1) / max(total[CELLS:].sum(), 1)
    return levels, np.minimum(np.floor(-4 * np.log2(share)), 255 // width).astype(np.uint8)


def prefixes(raw: np.ndarray, offs: np.ndarray, width: int, percent: int, model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(row, prefix in order, sorted distinct shingles, class key, size) of rows with shingles."""
    level, costs = model
    for r, u, key, size, cost in _sets(raw, offs, width, costs):
        p = size - (percent * size + 99) // 100 + 1
        token = level[(u >> np.uint64(45)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | (255 - cost).astype(np.uint64) << np.uint64(48) | u >> np.uint64(16)
        yield r, np.sort(np.partition(token, p - 1)[:p]).view(np.int64), u, key, size


def sketched(u: np.ndarray) -> np.ndarray:
    """The long sketch of a set: 512 bits, or the power of two from two bits a shingle on."""
    bits = max(512, 1 << (2 * len(u) - 1).bit_length())
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class Bitmap:
    """A broadcast bitmap of 16 bits for each of the distinct values of one column, BITMAP bits at most; a value that is
    not among them passes with the share of bits that are set, so whoever uses it joins exactly afterwards."""

    def __init__(self, values: DataFrame, hashed: bool):
        spark, self.hashed = values.sparkSession, hashed
        self.bits = max(min(1 << (16 * values.count()).bit_length(), BITMAP), 1 << 15)
        place = self.place(F.col(values.columns[0]))
        marks = values.select(F.floor(place / 32768).alias("at"), (place % 32768).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bitmap = np.zeros((self.bits // 32768, 4096), np.uint8)
        for r in marks.collect():  # BITMAP bits at most
            bitmap[r["at"]] = np.frombuffer(r["bits"], np.uint8)
        self.shared = spark.sparkContext.broadcast(bitmap.reshape(-1))

    def place(self, value):
        return F.pmod(F.xxhash64(value), F.lit(self.bits)) if self.hashed else value.bitwiseAND(self.bits - 1)


def _passes(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _classes(rows: DataFrame, firsts: DataFrame, width: int, percent: int, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per class: cid, doc, n, same (key of prefix and size), the tokens of its prefix that other classes may
    hold, in order, their places in it, the long and the short sketch; settled.

    Texts are read for the first document of each class: once to count the tokens of all prefixes, and once more to keep
    only those that occur twice, so single tokens (most of a prefix) are shuffled as bare counts and never stored."""
    spark = rows.sparkSession
    known, first = spark.sparkContext.broadcast(model), Bitmap(firsts.select("doc"), True)  # model: 2 x CELLS bytes
    rows = rows.withColumn("place", first.place(F.col("doc_id")))
    wanted = first.shared

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(wanted.value, np.asarray(batch.column(2)))))
            for a, b, raw, offs in blocks(*texts(batch.column(1)), limit=BLOCK):
                with np.errstate(over="ignore"):
                    yield batch.column(0).slice(a, b - a), list(prefixes(lowered(raw), offs, width, percent, known.value))

    @task("join")
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in chosen(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[1] for f in found]))], names=["token"])

    lists = settle(rows.mapInArrow(tokens, "token long").groupBy("token").count().where("count > 1").select("token"), "join-tokens")
    twice = Bitmap(lists, False)
    shared, bits = twice.shared, twice.bits
    schema = "doc_id long, cid long, n long, same long, tokens array<long>, places array<int>, sketch array<long>, " + ", ".join(f"f{k} long" for k in range(SKETCH))

    @task("join")
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in chosen(batches):
            kept = [np.flatnonzero(_passes(shared.value, f[1] & (bits - 1))) for f in found]
            ends = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            flat = np.concatenate([f[1][k] for f, k in zip(found, kept, strict=True)]) if found else np.zeros(0, np.int64)
            where = np.concatenate(kept).astype(np.int32) if found else np.zeros(0, np.int32)
            with np.errstate(over="ignore"):
                same = [int(np.add.reduce(mixed(f[1].view(np.uint64) ^ np.uint64(f[4]))).view(np.int64)) for f in found]
            long = [sketched(f[2]) for f in found]
            short = np.array([np.bitwise_xor.reduce(x.reshape(-1, SKETCH), axis=0) for x in long], np.int64).reshape(-1, SKETCH)
            size = pa.array(np.cumsum([0, *map(len, long)]), pa.int32())
            columns = [ids.take(pa.array([f[0] for f in found], pa.int64())), *(pa.array(x, pa.int64()) for x in ([f[3] for f in found], [f[4] for f in found], same))]
            columns += [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(where)), pa.ListArray.from_arrays(size, pa.array(np.concatenate(long) if long else np.zeros(0, np.int64)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(short[:, k].copy()) for k in range(SKETCH)], names=[x.split()[0] for x in schema.split(", ")])

    signed = rows.mapInArrow(sign, schema)
    rest = [F.first(c).alias(c) for c in signed.columns if c not in ("doc_id", "cid")]
    return settle(signed.groupBy("cid").agg(F.min("doc_id").alias("doc"), *rest), "join-classes")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose long sketches, folded to one length, allow the threshold; settled."""
    one, two = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for c, k in (("a", 1), ("b", 2)))
    h = lambda s: (F.size(s) / 2).cast("int")
    half = lambda s: F.zip_with(F.slice(s, 1, h(s)), F.slice(s, h(s) + 1, h(s)), lambda x, y: x.bitwiseXOR(y))
    fold = lambda s, t: F.when(F.size(s) > F.size(t), half(s)).otherwise(F.col(s))
    differ = F.aggregate(F.zip_with(fold("s1", "s2"), fold("s2", "s1"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    most = F.col("n1") + F.col("n2") - 2 * F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent) - 1e-6)
    far = F.greatest(F.size("s1"), F.size("s2")) > 2 * F.least(F.size("s1"), F.size("s2"))  # only thresholds under 50 meet such
    return settle(pairs.join(one, "a").join(two, "b").where(far | (differ <= most)).select("a", "b"), "join-near")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets, read again and compared by all 64 bits, reach the threshold."""
    pairs = _near(pairs, classes, percent)
    wanted = settle(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(classes.select("cid", "doc"), "cid"), "join-wanted")
    bitmap = Bitmap(wanted.select("doc"), True)
    shared = bitmap.shared

    @task("join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a class give one set in each task
        for batch in batches:
            batch = batch.filter(pa.array(_passes(shared.value, np.asarray(batch.column(2)))))
            for a, b, raw, offs in blocks(*texts(batch.column(1)), limit=BLOCK):
                with np.errstate(over="ignore"):
                    found = [(r, key, u) for r, u, key, _, _ in _sets(lowered(raw), offs, width) if key not in seen]
                seen.update(f[1] for f in found)
                if found:
                    ends = pa.array(np.cumsum([0, *(len(f[2]) for f in found)]), pa.int32())
                    words = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[2] for f in found]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), words], names=["cid", "words"])

    read = rows.withColumn("place", bitmap.place(F.col("doc_id"))).mapInArrow(run, "cid long, words array<long>")
    few, count = wanted.select("cid"), wanted.count()
    sets = settle(read.join(F.broadcast(few) if count <= BROADCAST else few, "cid", "left_semi"), "join-sets")
    if sets.count() > count:
        sets = settle(sets.groupBy("cid").agg(F.first("words").alias("words")), "join-sets")
    one, two = (sets.select(F.col("cid").alias(c), F.col("words").alias(w)) for c, w in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(two, "b")
    enough = F.size(F.array_intersect("x", "y")) * F.lit(100 + percent) >= (F.size("x") + F.size("y")) * F.lit(percent)
    return settle(both.where(enough).select("a", "b"), "join-links")


def _possible(percent: int, first: bool):
    """Sizes n1, n2, places p1, p2 of a common token and the sketches leave room for the threshold; with `first`, if the
    sets have nothing in common before this token, which holds in the list of a pair's first common token."""
    n1, n2, p1, p2 = (F.col(c) for c in ("n1", "n2", "p1", "p2"))
    need = (n1 + n2) * percent / (100 + percent)
    differ = sum((F.bit_count(F.col(f"f{k}1").bitwiseXOR(F.col(f"f{k}2"))) for k in range(1, SKETCH)), F.bit_count(F.col("f01").bitwiseXOR(F.col("f02"))))
    before = F.lit(0) if first else F.least(p1, p2)
    sizes = (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) + before >= need - 1e-6)
    return sizes & (differ <= n1 + n2 - 2 * F.ceil(need - 1e-6))


_COLUMNS = ["n", "p", "prev", *(f"f{k}" for k in range(SKETCH))]


def _entries(classes: DataFrame, components: DataFrame | None) -> DataFrame:
    """A row for each kept token of each class: token, id, component, the place p and the first tokens before it."""
    named = classes.withColumn("component", F.col("cid")) if components is None else classes.join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    each = named.drop("sketch").select("*", F.posexplode("tokens").alias("k", "token"))
    return each.select("token", F.col("cid").alias("id"), "component", "n", F.col("places")[F.col("k")].alias("p"), F.slice("tokens", 1, F.least("k", F.lit(PREVIOUS))).alias("prev"), *_COLUMNS[3:])


def _renamed(entries: DataFrame, components: DataFrame) -> DataFrame:
    """entries with the components as they are now."""
    named = entries.drop("component", "c", "lo").join(components.select("id", F.col("component").alias("now")), "id", "left")
    return named.withColumn("component", F.coalesce("now", "id")).drop("now")


def _open(entries: DataFrame) -> DataFrame:
    """token, number of classes and least component of the lists that are not in one component."""
    return entries.groupBy("token").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "c", "lo")


def _met(one: DataFrame, two: DataFrame, condition, percent: int, first: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, of entries in one list and in different components that may reach the threshold; with
    `first`, only those whose first common token may be the list's."""
    left = one.select("token", F.col("id").alias("a"), F.col("component").alias("c1"), *[F.col(c).alias(f"{c}1") for c in _COLUMNS], *[c for c in ("left", "lead") if c in one.columns])
    right = two.select("token", F.col("id").alias("b"), F.col("component").alias("c2"), *[F.col(c).alias(f"{c}2") for c in _COLUMNS])
    pairs = left.join(right, "token").where((F.col("c1") != F.col("c2")) & condition).where(_possible(percent, first))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(components: DataFrame, found: DataFrame) -> DataFrame:
    """The components with the links found since."""
    return connected_components(components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))


def jaccard_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, cid (the class of equal sets), component (its key) and mark (the hash of the text)
    of every document."""
    with batches_of(docs.sparkSession, BATCH):
        return _joined(docs, width, percent)


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = _scanned(rows.withColumn("mark", F.xxhash64("text")), width)
    ids = scanned.where("chunk is null").select("doc_id", "mark", "cid", "n")
    firsts = settle(ids.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc")), "join-firsts")
    classes = _classes(rows, firsts, width, percent, cell_levels(scanned, width))
    total = max(classes.count(), 1)

    # groups of one prefix and size: their first members stand for them in the lists, the others meet the first
    groups = classes.groupBy("same", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("size")).where("size > 1").select("same", "n", "gid")
    members = settle(classes.select("cid", "same", "n").join(groups, ["same", "n"]).where("cid <> gid").select("cid", "gid"), "join-members")
    heads = classes.join(members.select("cid"), "cid", "left_anti") if members.limit(1).count() else classes
    state = _entries(heads, None)
    state = settle(state.join(_open(state), "token"), "join-lists")
    star = _met(state.where("id = lo"), state, F.lit(True), percent, False)
    checked = settle(star.union(members.select(F.least("gid", "cid"), F.greatest("gid", "cid"))).distinct(), "join-pairs")
    links = _verified(checked, rows, classes, width, percent)
    components = connected_components(links)

    # large lists: some members against those of other components, so that the rest has few components to part
    state = None
    for turn, some in enumerate(SIFTS):
        state = _entries(classes, components) if state is None else _renamed(state, components)
        state = settle(state.join(_open(state).where(F.col("c") > SMALL), "token"), "join-sift")
        if not state.limit(1).count():
            break
        # powers of two, so that lists of about one size share their members taken
        every = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("c") / some)), F.lit(0))).cast("long")
        taken = state.where(F.pmod(F.xxhash64("id", F.lit(-1 - turn)), every) == 0)
        pairs = _met(taken, state, ~F.arrays_overlap("prev1", "prev2"), percent, True)
        pairs = settle(pairs.join(checked, ["a", "b"], "left_anti"), "join-pairs")
        if pairs.limit(1).count():
            found = _verified(pairs, rows, classes, width, percent)
            checked = checked.union(pairs)
            if found.limit(1).count():
                components = _merged(components, found)

    # the rest: lists of all classes that are not in one component
    turn, whole = 0, None
    while True:
        turn += 1
        state = _entries(classes, components)
        if whole is not None:
            state = state.join(whole, ["token", "id"], "left_semi")
        state = settle(state.join(_open(state), "token"), "join-rest")
        cost, large = state.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > SMALL, 1))).first()
        pivots = max(PIVOTS, REST * total // max(large, 1))
        lead = F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest(F.ceil(F.col("c") / pivots), F.lit(1)).cast("long")) == 0
        state = state.withColumns({"left": F.lit(cost <= REST * total) | (F.col("c") <= SMALL), "lead": lead})
        # pairs that share an earlier known token meet in its list
        once = ((F.col("a") < F.col("b")) | ~F.col("left")) & ~F.arrays_overlap("prev1", "prev2")
        pairs = _met(state.where("left or lead"), state, once, percent, True)
        pairs = settle(pairs.join(checked, ["a", "b"], "left_anti"), "join-pairs")
        if pairs.limit(1).count():
            found = _verified(pairs, rows, classes, width, percent)
            checked = checked.union(pairs)
            if found.limit(1).count():
                components = _merged(components, found)
        whole = settle(state.where("not (left or lead)").select("token", "id"), "join-left")
        if not whole.limit(1).count():
            break
    named = classes.select("cid", "doc").join(components.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = named.select("cid", "component").join(least, "component").select("cid", "component", "component_id")
    out = ids.join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cid", "component", "mark")
