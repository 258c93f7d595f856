"""Token counts of documents under a unigram segmentation, by dynamic programming over a trie of pre-tokens.

Pre-tokens are maximal runs of non-white bytes, each with the space mark of the vocabulary before it. A worker
gathers the distinct pre-tokens of a block that it has not seen, sorts them, and walks them as a trie: the scores
of the forward pass (best log probability and its token count up to each byte) are kept on a stack along the
current path, so a prefix that several pre-tokens share is computed once; at each terminal the count is stored.
A document's count is the sum of its pre-tokens' counts, its score the sum of their scores. Nothing is shuffled.

The unigram vocabulary comes from a public piece list and is never trained: the piece of rank r (from 0) has the
log probability of Zipf's law, -log(r + 1) - log(H), with H the sum of 1 / (r + 1). A byte that no piece covers
is one token of FALLBACK. Equal scores go to fewer tokens.

Defined results: null and empty texts and those of white space have 0 tokens and score 0; repeated rows are
counted each; an empty table gives no rows; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITE, blocks, run_hashes, runs, task, texts

SPACE = "▁".encode()
FALLBACK = -25.0
#: Pre-tokens that a worker keeps; a full memo is emptied.
MEMO_ENTRIES = 1_000_000
#: Bytes of a pre-token beyond which it is not kept.
MEMO_BYTES = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigrams(path: str) -> dict[bytes, float]:
    """Log probabilities of the ordinary pieces of a sentencepiece file, by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)))
    pieces = [model.id_to_piece(k).encode() for k in usable]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class TrieCounter:
    """Forward scores over the trie of given pre-tokens."""

    def __init__(self, pieces: dict[bytes, float]):
        # pieces by their last bytes: a node of the reversed-piece trie is {byte: node}, None holds a piece's score
        self.back: dict = {}
        for piece, score in pieces.items():
            node = self.back
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[None] = score

    def count(self, words: list[bytes]) -> dict[bytes, tuple[int, float]]:
        """(tokens, score) of each distinct word; words are walked in order, so shared prefixes are computed once."""
        out, path, best, back = {}, b"", [(0.0, 0)], self.back
        for word in sorted(words):
            whole = SPACE + word
            same, limit = 0, min(len(path), len(whole))
            while same < limit and path[same] == whole[same]:
                same += 1
            del best[same + 1 :]
            for end in range(same + 1, len(whole) + 1):
                score, tokens = best[end - 1]
                top = (score + FALLBACK, -tokens - 1)
                node, at = back, end - 1
                while at >= 0 and (node := node.get(whole[at])) is not None:
                    if None in node:
                        score, tokens = best[at]
                        now = (score + node[None], -tokens - 1)
                        if now > top:
                            top = now
                    at -= 1
                best.append((top[0], -top[1]))
            path = whole
            out[word] = (best[-1][1], best[-1][0])
        return out


_counters: dict[str, tuple[TrieCounter, dict]] = {}


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score of every document."""
    path = vocabulary or default_vocabulary()

    @task("counts")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = (TrieCounter(unigrams(path)), {})
        counter, memo = _counters[path]
        for batch in batches:
            total, tokens, score = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64))
            for a, b, raw, offs in blocks(*texts(batch.column(1))):
                starts, ends, rows = runs(~WHITE[raw], offs)
                if not len(starts):
                    continue
                _, first, where = np.unique(run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                data = raw.tobytes()
                words = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                new = [w for w in words if w not in memo]
                found = counter.count(new)
                if len(memo) + len(found) > MEMO_ENTRIES:
                    memo.clear()
                    found |= counter.count([w for w in words if w not in found])
                memo.update((w, v) for w, v in found.items() if len(w) <= MEMO_BYTES)
                values = np.array([found.get(w) or memo[w] for w in words], np.float64)[where]
                total[a:b] += np.bincount(rows, minlength=b - a)
                tokens[a:b] += np.bincount(rows, values[:, 0], b - a).astype(np.int64)
                score[a:b] += np.bincount(rows, values[:, 1], b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(tokens), pa.array(score)], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")
