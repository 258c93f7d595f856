"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ, Gao and Long, 2024).

1. Vectors with the same components are one class, represented by its smallest id; null, zero and non-finite
   vectors, and those with null components, link with nothing.
2. Each representative is rotated by a seeded random orthogonal matrix; the signs are its binary code, and the
   inner product of the rotated unit vector with its code is the stored correction factor.
3. Candidate search: bands of signs under further seeded projections. Two representatives meet in a band when
   all of its bits agree; BANDS bands of band_bits(n) bits find a pair at cosine 0.9 with probability over 0.99.
   A band's bucket of more than BUCKET vectors is dealt into blocks, and every pair of its blocks meets once, so
   no task holds a whole large bucket. A pair counts only in the first band in which its bits agree.
4. In a block, the codes give an unbiased estimate of each inner product; only pairs whose upper confidence bound
   reaches the threshold are computed exactly, in double precision. Each vector gets its number of links and
   one link to the smallest member of its part of the block; pairs never leave the task.

Defined results: invalid vectors have no links and are their own component; vectors of different lengths are not
compared; a repeated vec_id counts as a further vector of that id; a null vec_id links with nothing (its
component is null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import connected_components

THRESHOLD = 0.9
SEED = 20240521
#: Probability that a pair at the threshold is missed by all bands, at most.
MISS = 0.005
BUCKET = 1024
#: Width of the confidence bound in units of the estimator's deviation.
EPSILON = 3.0


def band_bits(n: int) -> int:
    """Bits of a band such that n unrelated vectors leave about 32 in a bucket."""
    return min(30, max(6, math.ceil(math.log2(max(n, 1) / 32)))) if n > 64 else 6


def bands(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their signs (+1, -1) and correction factors."""
    turned = unit @ turn.T
    signs = np.where(turned >= 0, 1.0, -1.0).astype(np.float32)
    return turned, signs, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def estimate(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rows of `turned` with the coded vectors, and the half-width of their bounds."""
    dim = signs.shape[1]
    near = (turned.astype(np.float32) @ signs.T) / (math.sqrt(dim) * factor.astype(np.float32))
    return near, epsilon * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))


def _units(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component under the links (i, j)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(ids, copies, halves, cross, keys, x, band, threshold, out) -> None:
    """Links of one block with itself, or where `cross` of the rows of half 0 with those of half 1."""
    n = len(ids)
    if n < 2:
        return
    turned, signs, factor = codes(x, rotation_of(x.shape[1]))
    near, width = estimate(turned, signs, factor)
    maybe = (near + width >= threshold) | (near + width >= threshold).T
    if cross:
        maybe &= halves[:, None] != halves[None, :]
    i, j = np.nonzero(np.triu(maybe, 1))
    if band and len(i):
        fresh = ~(keys[i, :band] == keys[j, :band]).any(1)
        i, j = i[fresh], j[fresh]
    true = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    i, j = i[true >= threshold], j[true >= threshold]
    if not len(i):
        return
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    order = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    least = ids[order[_least(n, place[i], place[j])[place]]]
    hit = np.flatnonzero(links)
    out.append((ids[hit], links[hit].astype(np.int64), least[hit]))


_rotations: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = rotation(dim)
    return _rotations[dim]


def link_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of table(vec_id, embedding)."""
    spark = table.sparkSession
    kind = "float" if dict(table.dtypes)["embedding"] == "array<float>" else "double"
    x = F.col("embedding").cast(f"array<{kind}>")
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable & F.col("vec_id").isNotNull(), F.transform(x, lambda v: (v + F.lit(0).cast(kind)).cast(kind))).alias("x"))
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(7), "x")})
    classes = rows.where("x is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = settle(classes, "vectors")
    bits = band_bits(classes.count())
    count = bands(bits, threshold)

    kinds = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("x", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("keys", pa.binary()), ("dim", pa.int32())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(2)))
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                planes = np.random.default_rng(SEED + 1).standard_normal((count * bits, dim))
                for k in range(0, part.num_rows, 4096):
                    some = part.slice(k, 4096)
                    sign = _units(some.column(2)) @ planes.T >= 0
                    keys = (sign.reshape(-1, count, bits) * weights).sum(2).astype("<i4")
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(np.full(len(keys), dim), pa.int32())], schema=kinds)

    plain = classes.select("id", "copies", "x").mapInArrow(keyed, f"id long, copies long, x array<{kind}>, keys binary, dim int")
    plain = settle(plain, "vector-codes")
    key = lambda b: F.substring("keys", 4 * b + 1, 4)
    meets = plain.select("id", "copies", "x", "keys", "dim", F.posexplode(F.array(*[key(b) for b in range(count)])).alias("band", "key"))
    sizes = plain.select("dim", F.posexplode(F.array(*[key(b) for b in range(count)])).alias("band", "key")).groupBy("dim", "band", "key").count().where("count > 1")
    meets = meets.join(sizes, ["dim", "band", "key"]).withColumn("blocks", F.ceil(F.col("count") / BUCKET).cast("int"))
    own = F.pmod(F.xxhash64("id", "band"), "blocks").cast("int")
    meets = meets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("dim", "band", "key", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("half"), "id", "copies", "keys", "x")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    group = ["dim", "band", "key", "b0", "b1"]
    dealt = meets.repartition(parts, *group).sortWithinPartitions(*group, "half", "id")
    result = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table, last: bool) -> tuple[pa.Table | None, list]:
            t = t.combine_chunks()
            cols = [t.column(c) for c in group]
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for c in cols:
                codes_ = np.asarray(pa.compute.dictionary_encode(c.combine_chunks()).indices) if pa.types.is_binary(c.type) else np.asarray(c)
                change[1:] |= codes_[1:] != codes_[:-1]
            starts = [*np.flatnonzero(change).tolist(), t.num_rows]
            if not last:
                if len(starts) <= 2:
                    return t, []
                rest = t.slice(starts[-2])
                starts = starts[:-1]
            else:
                rest = None
            out: list = []
            band, half = np.asarray(t.column("band")), np.asarray(t.column("half"))
            ids, copies = np.asarray(t.column("id")), np.asarray(t.column("copies"))
            b0, b1 = np.asarray(t.column("b0")), np.asarray(t.column("b1"))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a > 1:
                    part = t.slice(a, b - a)
                    x = _units(part.column("x").combine_chunks())
                    keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), "<i4").reshape(b - a, -1)
                    _block(ids[a:b], copies[a:b], half[a:b], bool(b0[a] != b1[a]), keys, x, int(band[a]), threshold, out)
            return rest, out

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * BUCKET:
                continue
            t = pa.Table.from_batches(held)
            rest, out = solve(t if rest is None else pa.concat_tables([rest, t]), False)
            held = []
            for o in out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in o], schema=result)
        if held or rest is not None:
            t = pa.Table.from_batches(held) if held else None
            t = rest if t is None else t if rest is None else pa.concat_tables([rest, t])
            for o in solve(t, True)[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in o], schema=result)

    found = settle(dealt.mapInArrow(linked, "id long, links long, least long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    whole = classes.select("h1", "h2", "id", "copies").join(links, "id", "left").join(components, "id", "left")
    joined = rows.select("vec_id", F.when(F.col("x").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("x").isNotNull(), F.col("h2")).alias("h2")).join(whole, ["h1", "h2"], "left")
    component = F.coalesce("component", "id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
