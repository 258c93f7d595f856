"""Byte-level BPE ids of whole texts and back, by tree reduction over a monoid.

The ids of a stretch of bytes are an element; joining neighbours is the operation. A pattern match (a pre-token) is encoded
by encoding its halves, down to LEAF bytes, and joining them: a window of the last i ids on the left and the first j on
the right is encoded anew, and i or j grows while the window's outermost id doesn't stand apart from the id beyond it.

Why that is enough: call ids a and b apart if the bytes of both, encoded together, give [a, b]. BPE merges the leftmost pair
of lowest rank until none is left. Let x1 ... xn be ids of which all neighbours are apart, and take the first merge, in
the encoding of all bytes, across some border xi | xi+1. Until then all merges lay inside single x's, so what happened to
the bytes of xi xi+1 is what happens when they are encoded alone, where the same merge is the lowest one too; but parts
never split, so these two would not be apart. So no merge crosses a border, and x1 ... xn are the ids of the whole. The same
restriction argument shows that neighbours within the ids of any stretch are apart. Hence a window whose two outer borders are
apart makes the join exact, whatever lies beyond.

Between matches, joining is plain concatenation: the pattern always ends a match before a space that a non-space follows,
so a text is a product of chunks; the distinct chunks of a block of rows are encoded once each, and their ids are joined in
order. Decoding maps each id to its bytes and concatenates; as that is associative, the tree may be folded flat.

Defined results: a null or empty text has no ids; ids null or empty decode to no bytes, an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import KEPT, WHITE, blocks, task, texts

#: Bytes of a leaf of the tree, encoded merge by merge. Halves are whole leaves, so that in a row of one character, whose
#: longest ids have 2^k characters, the leaves' ids already stand as in the whole.
LEAF = 64
#: Chunks, matches and pairs of ids that a worker remembers, each; a memo is emptied when it is full.
MEMO = 300_000
#: Longer chunks are not remembered, nor are matches of more than LEAF / 4 characters, which always fit a leaf.
MEMO_BYTES = 64
#: Bytes of text that one block encodes the distinct chunks of.
BLOCK_BYTES = 1 << 22


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = ranks = read_ranks(path)
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        splits = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([(a << 32) | b for a, b in splits], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(splits.values()), np.int64)[order]
        self.none = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.borders: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merges the leftmost pair of lowest rank until none is left."""
        if len(data) > LEAF:
            return self._merged_long(data)
        get, none = self.ranks.get, len(self.ranks)
        cuts = list(range(len(data) + 1))
        pairs = [get(data[k : k + 2], none) for k in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            del cuts[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = get(data[cuts[k] : cuts[k + 2]], none)
            if k:
                pairs[k - 1] = get(data[cuts[k - 1] : cuts[k + 1]], none)
        return [self.ranks[data[a:b]] for a, b in pairwise(cuts)]

    @staticmethod
    def _remember(memo: dict, key, value):
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = value
        return value

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that begins at a byte
        before = list(range(-1, n - 1))  # begin of the part before it
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            if middle <= k or middle >= n or end[middle] != stop:
                continue  # one of the two parts is gone
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (r := ranks.get(data[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if (p := before[k]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : end[k]]])
            k = end[k]
        return out

    def apart(self, a: int, b: int) -> bool:
        known = self.borders.get((a, b))
        if known is None:
            known = self._remember(self.borders, (a, b), self.merged(self.bytes[a] + self.bytes[b]) == [a, b])
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of both stretches together."""
        if not left or not right or self.apart(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(map(self.bytes.__getitem__, left[len(left) - i :] + right[:j])))
            l_done = i == len(left) or self.apart(left[len(left) - i - 1], window[0])
            r_done = j == len(right) or self.apart(window[-1], right[j])
            if l_done and r_done:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if l_done else min(2 * i, len(left))), (j if r_done else min(2 * j, len(right)))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = -(-len(data) // (2 * LEAF)) * LEAF
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of ids merge to; `none` where they don't."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.none)

    def merged_all(self, parts: list[bytes]) -> list[bytes]:
        """What `merged` gives for each of many short parts, as 32-bit integers: all parts take their next merge at once."""
        if not parts:
            return []
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        part, ids = np.repeat(np.arange(len(parts)), size), self.single[data]
        inner = part[:-1] == part[1:]
        table = self._pairs(*(x.ravel() for x in np.meshgrid(self.single, self.single, indexing="ij")))
        rank = np.append(np.where(inner, table[data[:-1].astype(np.int64) * 256 + data[1:]], self.none), self.none)
        done = []
        while len(ids):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), first)
            merges = best >> 32 < self.none
            ended = np.repeat(~merges, np.diff(np.append(first, len(ids))))
            done.append((part[ended], ids[ended]))
            k = best[merges] & 0xFFFFFFFF
            ids[k] = rank[k]
            rank[k] = rank[k + 1]
            left = ~ended
            left[k + 1] = False
            place = np.cumsum(left) - 1
            part, ids, rank, k = part[left], ids[left], rank[left], place[k]
            more = k[(k + 1 < len(ids)) & (part[np.minimum(k + 1, len(ids) - 1)] == part[k])] if len(k) else k
            rank[more] = self._pairs(ids[more], ids[more + 1])
            less = k[(k > 0) & (part[k - 1] == part[k])] if len(k) else k
            rank[less - 1] = self._pairs(ids[less - 1], ids[less])
        part, ids = (np.concatenate(c) for c in zip(*done, strict=True))
        ids = ids[np.argsort(part, kind="stable")].astype(np.int32).tobytes()
        ends = np.cumsum(np.bincount(part, minlength=len(parts)) * 4).tolist()
        return [ids[a:b] for a, b in pairwise([0, *ends])]

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, as 32-bit integers."""
        out = list(map(self.chunks.get, chunks))
        lacking = [k for k, x in enumerate(out) if x is None]
        found = [self.matches(chunks[k].decode()) for k in lacking]
        known, ids_of = self.known, self.known.__getitem__
        wanted = set(chain.from_iterable(found))
        if len(known) + len(wanted) > MEMO:
            known.clear()
        wanted -= known.keys()
        short = [m for m in wanted if len(m) <= LEAF // 4]
        known.update(zip(short, self.merged_all([m.encode() for m in short]), strict=True))
        long = [m for m in wanted if len(m) > LEAF // 4]
        known.update((m, array("i", self.tree(m.encode())).tobytes()) for m in long)
        for k, some in zip(lacking, found, strict=True):
            out[k] = ids_of(some[0]) if len(some) == 1 else b"".join(map(ids_of, some))
        for m in long:
            del known[m]
        if len(self.chunks) + len(lacking) > MEMO:
            self.chunks.clear()
        self.chunks.update((chunks[k], out[k]) for k in lacking if len(chunks[k]) <= MEMO_BYTES)
        return out


def chunk_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks begin: at rows, and at spaces that a non-space follows. After lead bytes that some white space
    shares (C2, E1, E2, E3) none begins, which only makes chunks longer."""
    after = ~WHITE
    after[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    begins = np.zeros(len(raw) + 1, bool)
    begins[:-2] = (raw[:-1] == 0x20) & after[raw[1:]]
    begins[offs] = True
    return np.flatnonzero(begins[:-1])


_codecs: dict[tuple[str, str], Codec] = {}
_tables: dict[str, pa.Array] = {}
KEPT.extend([_codecs.clear, _tables.clear])


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_rows(own: Codec, raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A list of ids for each row."""
    starts = chunk_starts(raw, offs)
    places = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, places, pa.py_buffer(np.ascontiguousarray(raw))])
    coded = chunks.dictionary_encode()
    ids = own.encode_chunks(coded.dictionary.to_pylist())
    counts = np.array([len(x) for x in ids], np.int64) // 4
    once = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    flat = once.take(coded.indices).flatten()
    each = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy(zero_copy_only=False)])])
    return pa.ListArray.from_arrays(pa.array(each[np.searchsorted(starts, offs)].astype(np.int32)), flat)


def _encoder(text_at: int, path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @task("byte_bpe")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b, raw, offs in blocks(*texts(batch.column(text_at)), limit=BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, encode_rows(own, raw, offs)], names=[str(k) for k in range(batch.num_columns + 1)])

    return encode


def _decoder(ids_at: int, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @task("byte_bpe")
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tables:
            ranks = read_ranks(path)
            tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                tokens[rank] = token
            _tables[path] = pa.array(tokens, pa.large_binary())
        for batch in batches:
            lists = batch.column(ids_at)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], lists.type)
            ids = lists.flatten()
            taken = _tables[path].take(ids)
            if taken.null_count:
                raise ValueError("an id is null or outside the vocabulary")
            places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(ids) else np.zeros(1, np.int64)
            ends = places[np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])]
            data = taken.buffers()[2] if len(ids) else pa.py_buffer(b"")
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], names=[str(k) for k in range(batch.num_columns + 1)])

    return decode


def _mapped(df: DataFrame, function: Callable, name: str, kind: str) -> DataFrame:
    numbered = df.toDF(*[str(k) for k in range(len(df.columns))])
    schema = StructType([*numbered.schema, StructField(str(len(df.columns)), StructType.fromDDL(f"x {kind}")[0].dataType)])
    return numbered.mapInArrow(function, schema).toDF(*df.columns, name)


def encode_texts(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """All rows and columns of docs with `ids`, an array of the text's ids; a column of that name is replaced."""
    docs = docs.drop("ids") if text != "ids" else docs
    return _mapped(docs, _encoder(docs.columns.index(text), ranks or default_ranks(), pattern or default_pattern()), "ids", "array<int>")


def decode_ids(encoded: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """All rows and columns with `decoded`, the bytes of the ids; a column of that name is replaced."""
    encoded = encoded.drop("decoded") if ids != "decoded" else encoded
    return _mapped(encoded, _decoder(encoded.columns.index(ids), ranks or default_ranks()), "decoded", "binary")


def digest_ids(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 sums of the decimal ids, joined by single spaces, and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
