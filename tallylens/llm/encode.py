"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word chunk encoded once per worker.

Byte-level BPE splits a text before every space that a non-space follows, so the ids of a text are the ids of
its chunks (" word", " word,", ...) in order. Chunks repeat; a worker keeps their ids in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import KEPT, blocks, quiet_tokenizers, texts

#: Entries of a worker's memo (about 250 bytes each), in two halves: when the newer one is full, it becomes the older
#: one and the older one goes, while chunks that are met again move to the newer one.
MEMO_ENTRIES = 1_200_000
#: Chunks of more characters are encoded without the memo.
MEMO_CHARS = 48

#: Marks that end a chunk; after a letter they are a piece of their own, so " word." is " word" and ".".
MARKS = ".,;:!?"

_ODD_SPACE = re.compile(r" (?=\s)| $")
_CHUNK = re.compile(r" (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.older: dict[str, bytes] = {}
        self.entries = MEMO_ENTRIES
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():
            self.widths[k] = len(token)  # byte-level: one character stands for each byte
        self.tails: dict[str, bytes] = {}
        self.parted = self._parts_marks()

    def _parts_marks(self) -> bool:
        """Whether this tokenizer parts marks from the letter before them, and no added token holds one."""
        if self.tokenizer.pre_tokenizer is None or any(m in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for m in MARKS):
            return False
        return all(self.tokenizer.pre_tokenizer.pre_tokenize_str(f" ab{m}")[-1][1] == (3, 3 + len(m)) for m in (*MARKS, MARKS, "..."))

    def _bare(self, part: str) -> str:
        """The chunk without its marks at the end, if a letter of ASCII is before them, or nothing."""
        bare = part.rstrip(MARKS) if part[-1:] in MARKS else ""
        return bare if bare and bare[-1].isascii() and bare[-1].isalpha() else ""

    def _one(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of chunks that each begin with a space: encoded as one text, cut where the chunks' bytes end."""
        if not parts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
        ends = np.cumsum(self.widths[ids])
        cuts = np.cumsum([len(p.encode()) for p in parts])
        at = np.searchsorted(ends, cuts)
        if not len(ends) or at[-1] >= len(ends) or (ends[at] != cuts).any():
            return [self._one(p) for p in parts]  # such as a special token's text across two chunks
        raw, at = ids.tobytes(), ((at + 1) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > self.entries // 2:
            self.older, self.memo = self.memo, {}
        memo, heads, found, lacking = self.memo, [], [], []
        wanted: set[str] = set()
        for t in texts:
            parts = _CHUNK.split(t) if _ODD_SPACE.search(t) else t.split(" ")
            heads.append(parts.pop(0))
            ids = list(map(memo.get, parts))  # one look-up for each chunk
            found.append(ids)
            if None in ids:
                at = [k for k, x in enumerate(ids) if x is None]
                wanted.update([parts[k] for k in at])
                lacking.append((parts, ids, at))
        again = wanted & self.older.keys()
        memo.update((p, self.older[p]) for p in again)
        wanted -= again
        marked: list[tuple[str, str]] = []
        if self.parted:
            marked = [(p, bare) for p in wanted if len(p) <= MEMO_CHARS and (bare := self._bare(p)) and (bare in memo or bare in wanted)]
            wanted.difference_update([p for p, _ in marked])
        once: dict[str, bytes] = {}
        for parts, into in (([p for p in wanted if len(p) <= MEMO_CHARS], memo), ([p for p in wanted if len(p) > MEMO_CHARS], once)):
            for k in range(0, len(parts), 512):
                into.update(zip(parts[k : k + 512], self._ids([" " + p for p in parts[k : k + 512]]), strict=True))
        for p, bare in marked:  # a bare chunk ends with a letter, so none of them is marked itself
            tail = p[len(bare) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._one(tail)
            memo[p] = memo[bare] + self.tails[tail]
        for parts, ids, at in lacking:
            for k in at:
                ids[k] = memo[p] if len(p := parts[k]) <= MEMO_CHARS else once[p]
        return [(self._one(head) if head else b"") + b"".join(ids) for head, ids in zip(heads, found, strict=True)]


_encoders: dict[str, Encoder] = {}


KEPT.append(_encoders.clear)


def encoder(path: str, entries: int = MEMO_ENTRIES) -> Encoder:
    """This worker's encoder of that vocabulary, with a memo of so many entries."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].entries = entries
    return _encoders[path]


def text_slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of consecutive rows of at most `limit` bytes, or of one longer text; nulls are empty.
    Only these are Python strings at a time."""
    for a, b, _, _ in blocks(*texts(column), limit=limit):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
