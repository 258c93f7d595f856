"""Language-model scores of documents: prediction by partial matching (escape method D, with symbol exclusion).

Model. A trie of byte contexts up to ORDER bytes over the lower-cased training texts, each between marks of byte
0xFF (which no UTF-8 text holds). Spark counts the (ORDER + 1)-grams of all training documents; counts are added
up by partition and shuffled in packed chunks, one for each group of contexts by their last two bytes. No gram is
dropped: a chunk holds all grams of its contexts of two bytes or more, of which shorter contexts are sums, and the
counts of byte pairs (65,536 at most) are broadcast for the orders below. A slab of documents sends its distinct grams
to the chunks, which answer with a probability for each, and the slab's text is scored from these. In a context with N occurrences of d symbols, a symbol seen n times has (2n - 1) / 2N and the escape
d / 2N; after an escape the shorter context leaves out the symbols of the longer one; below the empty
context the bytes never seen are equally likely. The score is the base-10 logarithm of the product over all bytes
of a text and its end mark: its adaptive code length under the pretrained trie.

Base. Word counts of the training documents by 64-bit hash. A task packs the distinct words of a slab of
documents, their counts and the (word, document) pairs into one row per hash range; a range's rows meet in one
task, which adds up the counts and sends each slab the sums of its documents. A frequent word is one entry per
slab, so no word makes a large group, and no vocabulary is broadcast.

Defined results: null and empty texts have the end alone; repeated rows are scored each (and counted each in
training); a null doc_id counts as the empty text for its fold; without training documents the base score is 0
and the model's bytes are equally likely; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, blocks, fold, lowered, mixed, run_hashes, runs, settle, task, texts

ORDER = 5
MARK = 0xFF
#: Groups of contexts, and the grams that a task holds before it sends their counts.
CHUNKS, HELD = 256, 3_000_000
#: Bytes and documents of a slab.
SLAB_BYTES, SLAB_DOCS = 8 << 20, 60_000


def marked(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts, each after ORDER marks and before one; and the places of their bytes with the end mark."""
    n, extra = len(offs) - 1, ORDER + 1
    out = np.full(len(raw) + n * extra, MARK, np.uint8)
    sizes = np.diff(offs)
    shift = np.repeat(np.arange(n) * extra + ORDER, sizes)
    out[np.arange(len(raw)) + shift] = raw
    begin = offs[:-1] + np.arange(n) * extra + ORDER
    places = np.arange(len(raw) + n) + np.repeat(np.arange(n) * ORDER + ORDER, sizes + 1)
    assert n == 0 or places[0] == begin[0]
    return out, places


def gram_keys(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes that end at each place, as one number; the last byte is the lowest."""
    wide, key = text.astype(np.uint64), np.zeros(len(text), np.uint64)
    for k in range(length):
        key[k:] |= wide[: len(wide) - k] << np.uint64(8 * k)
    return key[places]


def chunks_of(keys: np.ndarray) -> np.ndarray:
    """The chunk of each gram, by the last two bytes of its context."""
    return (mixed((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(CHUNKS)).astype(np.int64)


def by_chunk(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of the sorted keys by chunk and key, and where in it each chunk begins and ends."""
    chunk = chunks_of(keys)
    order = np.argsort(chunk, kind="stable")
    return order, np.searchsorted(chunk[order], np.arange(CHUNKS + 1)).tolist()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(chunk, keys, counts) of all (ORDER + 1)-grams of docs(text), packed; settled."""
    kinds = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    schema = "chunk int, keys binary, counts binary"

    def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

    def batch_of(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1].astype("<u8").tobytes() for p in parts], pa.binary()), pa.array([p[2].astype("<i8").tobytes() for p in parts], pa.binary())], schema=kinds)

    @task("lm")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            k, n = merged(keys, counts)
            order, cuts = by_chunk(k)
            k, n = k[order], n[order]
            return batch_of([(c, k[a:b], n[a:b]) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

        keys, counts, least = [], [], 0
        for batch in batches:
            for _, _, raw, offs in blocks(*texts(batch.column(0))):
                k, n = np.unique(gram_keys(*marked(lowered(raw), offs), ORDER + 1), return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 1_500_000 + 2 * least:
                    k, n = merged(keys, counts)
                    keys, counts, least = [k], [n], len(k)
                    if least > HELD:
                        yield sent()
                        keys, counts, least = [], [], 0
        if keys:
            yield sent()

    @task("lm")
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for c, k, n in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                keys, counts = held.setdefault(c, ([], []))
                keys.append(np.frombuffer(k, "<u8"))
                counts.append(np.frombuffer(n, "<i8"))
                if len(keys) > 16:
                    held[c] = tuple([x] for x in merged(keys, counts))
        if held:
            yield batch_of([(c, *merged(*kn)) for c, kn in held.items()])

    return settle(docs.select("text").mapInArrow(count, schema).repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "chunk").mapInArrow(add, schema), "lm-grams")


def pair_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs of bytes and their counts, 65,536 at most."""

    @task("lm")
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount((np.frombuffer(k, "<u8") & np.uint64(0xFFFF)).astype(np.int64), np.frombuffer(n, "<i8"), 1 << 16).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["pair", "n"])

    rows = sorted(grams.select("keys", "counts").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect())  # 65,536 rows at most
    return np.array([r["pair"] for r in rows], np.uint64), np.array([r["n"] for r in rows], np.int64)


class _Table:
    """Open addressing: the index of each of the distinct keys."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(3 * len(keys)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int64), self._home(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several that want one place, one stays
            won = self.at[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        look = np.flatnonzero((there != keys) & (self.at[slot] >= 0))
        slot = slot[look]
        while len(look):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[look]
            out[look[hit]] = self.at[slot[hit]]
            go = ~hit & (self.at[slot] >= 0)
            look, slot = look[go], slot[go]
        return out


class Trie:
    """Contexts of all orders with their log10 probabilities. Where keys are those of one chunk, pairs are the counts
    of byte pairs of all chunks."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.orders = []
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                short = keys & np.uint64((1 << (8 * (k + 1))) - 1)
                keys, at = np.unique(short, return_inverse=True)
                counts = np.bincount(at, counts, len(keys)).astype(np.int64)
            if k == 1 and pairs is not None:
                keys, counts = pairs
            context, first = np.unique(keys >> np.uint64(8), return_index=True)
            of = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(keys))))
            total = np.bincount(of, counts, len(context)) if len(keys) else np.zeros(0)
            kinds = np.bincount(of, minlength=len(context)) if len(keys) else np.zeros(0)
            self.orders.insert(0, {"keys": keys, "n": counts, "context": context, "of": of, "N": total, "d": kinds})
        for k, o in enumerate(self.orders):
            o["log_n"] = np.log10(np.maximum(2 * o["n"] - 1, 1))
            o["den"] = np.log10(np.maximum(2 * o["N"], 1))
            o["esc"] = np.log10(np.maximum(o["d"], 1)) - o["den"]
            o["fresh"] = (o["log_n"] - o["den"][o["of"]]) if len(o["keys"]) else np.zeros(0)
            o["entry"], o["node"] = _Table(o["keys"]), _Table(o["context"])
            if k:  # the shorter context without the symbols of this one
                low = self.orders[k - 1]
                mask = np.uint64((1 << (8 * k)) - 1)
                parent = np.searchsorted(low["keys"], o["keys"] & mask)
                gone = np.bincount(o["of"], low["n"][parent], len(o["context"])) if len(o["keys"]) else np.zeros(0)
                up = np.searchsorted(low["context"], o["context"] & (mask >> np.uint64(8)))
                rest, kinds = low["N"][up] - gone, low["d"][up] - o["d"]
                o["up_den"] = np.log10(np.maximum(2 * rest, 1))
                o["up_esc"] = np.where(kinds > 0, np.log10(np.maximum(kinds, 1)) - o["up_den"], 0.0)
        self.floor = -math.log10(max(256 - len(self.orders[0]["keys"]), 1))

    def log10(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log10 probability of each byte and end mark, text by text."""
        return self.of_grams(gram_keys(*marked(raw, offs), ORDER + 1))

    def of_grams(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the others."""
        out = np.zeros(len(keys))
        open_, child = np.arange(len(keys)), np.full(len(keys), -1, np.int64)
        for k in range(ORDER, -1, -1):
            o = self.orders[k]
            key = keys[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            found = o["entry"].find(key)
            hit = found >= 0
            fresh = child < 0
            a = hit & fresh
            out[open_[a]] += o["fresh"][found[a]]
            b = hit & ~fresh
            if b.any():
                out[open_[b]] += o["log_n"][found[b]] - self.orders[k + 1]["up_den"][child[b]]
            open_, child, key = open_[~hit], child[~hit], key[~hit]
            node = o["node"].find(key >> np.uint64(8))
            seen, fresh = node >= 0, child < 0
            a = seen & fresh
            out[open_[a]] += o["esc"][node[a]]
            b = seen & ~fresh
            if b.any():
                out[open_[b]] += self.orders[k + 1]["up_esc"][child[b]]
            child = node.astype(np.int64)
        out[open_] += self.floor
        return out


_PART = "range int, slab long, kind int, a binary, b binary, c binary, d binary, e binary"
_PART_KINDS = pa.schema([("range", pa.int32()), ("slab", pa.int64()), ("kind", pa.int32())] + [(x, pa.binary()) for x in "abcde"])


def _parts(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PART_KINDS.types, strict=True)], schema=_PART_KINDS)


def _slab_rows(slab: int, ids: list, train: np.ndarray, h: np.ndarray, rows: np.ndarray, text: np.ndarray, sizes: np.ndarray, grams: list, ranges: int) -> list:
    """The slab's documents (kind 0), per hash range its words with training counts and its pairs (kind 1), and per
    chunk, as a range after those of the words, its distinct grams (kind 4)."""
    n = len(ids)
    words = np.bincount(rows, minlength=n)
    null = np.array([i is None for i in ids])
    out = [(slab % ranges, slab, 0, np.array([i or 0 for i in ids], "<i8").tobytes(), null.tobytes(), words.astype("<i8").tobytes(), pa.compress(text.tobytes(), "zstd", asbytes=True), sizes.astype("<i8").tobytes())]
    keys = np.unique(np.concatenate(grams))
    order, cuts = by_chunk(keys)
    keys = keys[order].astype("<u8")
    out += [(ranges + c, slab, 4, keys[a:b].tobytes(), b"", b"", b"", b"") for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    order = np.argsort(h, kind="stable")
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    word = np.cumsum(new) - 1
    distinct = h[new]
    counts = np.bincount(word, train[rows], len(distinct)).astype("<i8")
    pair = np.ones(len(h), bool)  # rows are in order within a word
    pair[1:] = new[1:] | (rows[1:] != rows[:-1])
    first = np.flatnonzero(pair)
    times = np.diff([*first, len(h)]).astype("<u4")
    pair_word, pair_doc = word[first], rows[first].astype("<u2")
    per_word = np.bincount(pair_word, minlength=len(distinct)).astype("<u4")
    edges = np.searchsorted(distinct, (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64))
    cuts = [0, *edges.tolist(), len(distinct)]
    pairs = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            p, q = pairs[a], pairs[b]
            out.append((k, slab, 1, distinct[a:b].astype("<u8").tobytes(), counts[a:b].tobytes(), per_word[a:b].tobytes(), pair_doc[p:q].tobytes(), times[p:q].tobytes()))
    return out


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, of which few are held at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, 16):
            yield from batch.slice(k, 16).to_pylist()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each key of a partition that is sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def score_documents(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    fold_ = fold("doc_id", parts)
    grams = gram_counts(docs.where(fold_ != held))
    pairs = spark.sparkContext.broadcast(pair_counts(grams))  # 65,536 pairs at most
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_ != held).alias("train"))

    @task("lm")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = TaskContext.get().partitionId() << 24
        ids, train, h, at, text, sizes, grams, size = [], [], [], [], [], [], [], 0

        def packed() -> pa.RecordBatch:
            return _parts(_slab_rows(slab, ids, np.concatenate(train), np.concatenate(h), np.concatenate(at), np.concatenate(text), np.concatenate(sizes), grams, ranges))

        for batch in batches:
            doc_ids, marks = batch.column(0).to_pylist(), np.asarray(batch.column(2).cast(pa.uint8())).astype(bool)
            for a, b, raw, offs in blocks(*texts(batch.column(1))):
                for c in range(a, b, SLAB_DOCS):
                    d = min(b, c + SLAB_DOCS)
                    part, own = raw[offs[c - a] : offs[d - a]], offs[c - a : d - a + 1] - offs[c - a]
                    if ids and (size + len(part) > SLAB_BYTES or len(ids) + d - c > SLAB_DOCS):
                        yield packed()
                        slab += 1
                        ids, train, h, at, text, sizes, grams, size = [], [], [], [], [], [], [], 0
                    low = lowered(part)
                    starts, ends, row = runs(~WHITE[low], own)
                    h.append(run_hashes(low, starts, ends))
                    at.append(row + len(ids))
                    text.append(low)
                    sizes.append(np.diff(own))
                    grams.append(np.unique(gram_keys(*marked(low, own), ORDER + 1)))
                    ids += doc_ids[c:d]
                    train.append(marks[c:d])
                    size += len(part)
        if ids:
            yield packed()

    def answers(rows: Iterator[dict]) -> Iterator[tuple]:
        """A chunk's model (kind 3, first) meets the grams of the slabs, one slab at a time."""
        trie = None
        for r in rows:
            if r["kind"] == 3:
                trie = Trie(np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<i8"), pairs.value)
            else:
                if trie is None:  # no training text has such a context
                    trie = Trie(np.zeros(0, np.uint64), np.zeros(0, np.int64), pairs.value)
                yield r["range"], r["slab"], 5, b"", b"", b"", trie.of_grams(np.frombuffer(r["a"], "<u8")).astype("<f8").tobytes(), b""

    @task("lm")
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for range_, rows in itertools.groupby(_single(batches), lambda r: r["range"]):
            if range_ >= ranges:
                found = answers(rows)
                while out := list(itertools.islice(found, 64)):
                    yield _parts(out)
                continue
            group = list(rows)
            out = [(r["range"], r["slab"], 0, r["a"], r["b"], r["c"], r["d"], r["e"]) for r in group if r["kind"] == 0]
            group = [r for r in group if r["kind"] == 1]
            if group:
                words = [np.frombuffer(r["a"], "<u8") for r in group]
                distinct, where = np.unique(np.concatenate(words), return_inverse=True)
                count = np.bincount(where, np.concatenate([np.frombuffer(r["b"], "<i8") for r in group]), len(distinct))
                out.append((group[0]["range"], -1, 2, np.array([(count > 0).sum(), count.sum()], "<i8").tobytes(), b"", b"", b"", b""))
                value, known, k = np.log10(count + 1)[where], (count > 0)[where], 0
                for r, w in zip(group, words, strict=True):
                    per = np.frombuffer(r["c"], "<u4")
                    doc, times = np.frombuffer(r["d"], "<u2"), np.frombuffer(r["e"], "<u4")
                    n = int(doc.max()) + 1
                    sums = np.bincount(doc, np.repeat(value[k : k + len(w)], per) * times, n)
                    hits = np.bincount(doc, np.repeat(known[k : k + len(w)], per) * times, n).astype("<u4")
                    here = np.flatnonzero(np.bincount(doc, minlength=n))
                    out.append((r["range"], r["slab"], 1, here.astype("<u2").tobytes(), sums[here].astype("<f8").tobytes(), hits[here].tobytes(), b"", b""))
                    k += len(w)
            for k in range(0, len(out), 64):
                yield _parts(out[k : k + 64])

    empty = [F.lit(b"").alias(x) for x in "cde"]
    model = grams.select((F.col("chunk") + ranges).alias("range"), F.lit(-1).cast("long").alias("slab"), F.lit(3).alias("kind"), F.col("keys").alias("a"), F.col("counts").alias("b"), *empty)
    found = rows.mapInArrow(read, _PART).union(model).repartition(ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(meet, _PART)
    found = settle(found, "lm-sums")
    seen = [np.frombuffer(r["a"], "<i8") for r in found.where("kind = 2").select("a").collect()]  # one row per range
    trained = docs.where(fold_ != held).count()
    total = int(sum(x[1] for x in seen)) + trained
    kinds = int(sum(x[0] for x in seen)) + (trained > 0)

    def scored(head: dict, answers: list[dict]) -> np.ndarray:
        """Scores of a slab's documents by the answers to its grams, chunk by chunk."""
        offs = np.concatenate([[0], np.cumsum(np.frombuffer(head["e"], "<i8"))])
        text = np.frombuffer(pa.decompress(head["d"], int(offs[-1]), "zstd", asbytes=True), np.uint8)
        places = []
        for _, _, low, own in blocks(text, offs):
            keys, where = np.unique(gram_keys(*marked(low, own), ORDER + 1), return_inverse=True)
            places.append((keys, where.astype(np.uint32), own))
        keys = np.unique(np.concatenate([p[0] for p in places]))
        value = np.zeros(len(keys))
        value[by_chunk(keys)[0]] = np.concatenate([np.frombuffer(r["d"], "<f8") for r in answers])
        return np.concatenate([np.add.reduceat(value[np.searchsorted(keys, k)][w], own[:-1] + np.arange(len(own) - 1)) for k, w, own in places])

    @task("lm")
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "slab"):
            head = next(r for r in group if r["kind"] == 0)
            ids, null = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["b"], bool)
            sums, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for r in sorted((r for r in group if r["kind"] == 1), key=lambda r: r["range"]):
                at = np.frombuffer(r["a"], "<u2")
                sums[at] += np.frombuffer(r["b"], "<f8")
                known[at] += np.frombuffer(r["c"], "<u4")
            words, score = np.frombuffer(head["c"], "<i8"), scored(head, sorted((r for r in group if r["kind"] == 5), key=lambda r: r["range"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(words + 1), pa.array(known + (trained > 0)), pa.array(sums + math.log10(trained + 1) - (words + 1) * math.log10(total + kinds + 1)), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    sums = found.where("kind <> 2").repartition(ranges, "slab").sortWithinPartitions("slab").mapInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return sums.select("doc_id", (fold_ == held).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
