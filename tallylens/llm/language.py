"""Language identification by mixture inference over byte n-grams.

Training: for every language of the labelled training documents, counts of byte trigrams within words (letters
and bytes from 0x80, ASCII lower-cased, a space at either side), folded into BUCKETS cells; counts are grouped
and summed by Spark over all training rows. The model is one matrix of log probabilities, a row of BUCKETS for every label
(256 KB each), which is broadcast; texts are scored in blocks that shrink as labels grow.

Prediction: each word of a document comes from one language, with a likelihood from its n-grams. Expectation-
maximisation estimates the proportions of all languages; then the sets of the k largest, k = 1, 2, ..., are
compared by the log likelihood of their own proportions less a penalty of 2 log(words) for each further language
(an unsupported language costs more than it explains). The prediction is the language of the largest proportion
in the chosen set; its proportion is the score (1 where one language is chosen). Sets of every size are tried, until
the penalty alone outweighs what any larger set could explain (the likelihood is concave in the proportions, so its
tangent at the estimate bounds it).

Defined results: `und` with score 0 for null texts and texts without a letter, and where no language was learned;
ties go to the language first in order; an empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, fold, lowered, runs, settle, task, texts

BUCKETS = 1 << 16
ROUNDS = 12
#: Log likelihood that a further language of the set must add, for each log(words).
PENALTY = 2.0
#: A word's likelihood per n-gram is tempered, as neighbouring n-grams are dependent.
TEMPER = 0.5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of the n-gram that ends at each byte, its word, words' first n-gram, words' rows).
    A word of n bytes has n n-grams; the first two see the space before it."""
    letter = _LETTER[raw]
    starts, ends, rows = runs(letter, offs)
    low = np.where(letter, lowered(raw), np.uint8(32)).astype(np.uint32)
    sizes = ends - starts
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts, sizes)
    inside = at - np.repeat(starts, sizes)
    one = np.where(inside >= 1, low[at - 1], 32)
    two = np.where(inside >= 2, low[at - 2], 32)
    cell = (low[at] | (one << 8) | (two << 16)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return cell, first, rows, sizes


def training_counts(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(lang, cell, n) over the labelled documents outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", parts) != held)).select("lang", "text")
    kinds = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    @task("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            label, langs = np.asarray(names.indices), names.dictionary.to_pylist()
            for a, b, raw, offs in blocks(*texts(batch.column(1)), limit=BLOCK_BYTES // 4):
                cell, first, rows, sizes = grams(raw, offs)
                of = np.repeat(label[a:b][rows], sizes)
                for k in np.unique(label[a:b]).tolist():
                    counts = np.bincount(cell[of == k], minlength=BUCKETS)
                    total[langs[k]] = total[langs[k]] + counts if langs[k] in total else counts
        for lang, counts in total.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit, pa.int32()), pa.array(counts[hit], pa.int64())], schema=kinds)

    return rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (languages x BUCKETS, float32)."""
    counts = settle(counts, "language-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row per label
    table = counts.toArrow()  # at most BUCKETS rows per label
    n = np.zeros((len(langs), BUCKETS), np.float32)
    place = {lang: k for k, lang in enumerate(langs)}
    n[[place[x] for x in table["lang"].to_pylist()], np.asarray(table["cell"])] = np.asarray(table["n"])
    n += 0.5
    total = n.sum(1, keepdims=True, dtype=np.float64)
    return langs, np.log(n) - np.log(total).astype(np.float32)


def _sums(x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of x over each of n documents, whose words stand in order."""
    out = np.zeros((n, *x.shape[1:]))
    has = np.unique(rows)
    if len(has):
        out[has] = np.add.reduceat(x, np.searchsorted(rows, has), axis=0)
    return out


def _em(like: np.ndarray, rows: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many steps from `weight`, and the log likelihood of every document."""
    m = np.maximum(np.bincount(rows, minlength=len(weight)), 1)[:, None]
    for _ in range(steps):
        share = like * weight[rows]
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        weight = _sums(share, rows, len(weight)) / m
    return weight, _sums(np.log(np.maximum((like * weight[rows]).sum(1), 1e-300)), rows, len(weight))


def infer(words: np.ndarray, rows: np.ndarray, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: log likelihoods (words x languages), rows: their documents in order. Returns for each of n documents
    the proportions within the chosen set (0 outside), its size, and the best language."""
    k = words.shape[1]
    like = np.exp(words - words.max(1, keepdims=True))
    m = np.bincount(rows, minlength=n)
    weight, value = _em(like, rows, np.full((n, k), 1.0 / k), rounds)
    mix = np.maximum((like * weight[rows]).sum(1), 1e-300)
    most = value + np.maximum(_sums(like / mix[:, None], rows, n).max(1, initial=0) - m, 0)  # above any likelihood
    order = np.argsort(-weight, axis=1, kind="stable")
    cost = PENALTY * np.log(np.maximum(m, 2))
    best, gain, size = np.zeros((n, k)), np.full(n, -np.inf), np.zeros(n, np.int64)
    for s in range(1, k + 1):
        left = np.flatnonzero(gain < most - cost * (s - 1) + 1e-6)  # whose best set may still be of this size or larger
        if not len(left):
            break
        at = np.full(n, -1)
        at[left] = np.arange(len(left))
        own = at[rows] >= 0
        chosen, top = np.zeros((len(left), k)), order[left, :s]
        np.put_along_axis(chosen, top, np.maximum(np.take_along_axis(weight[left], top, 1), 1e-9), 1)
        chosen /= chosen.sum(1, keepdims=True)
        chosen, value = _em(like[own], at[rows[own]], chosen, 3 if s > 1 else 0)
        value -= cost[left] * (s - 1)
        better = value > gain[left]
        best[left[better]], gain[left[better]], size[left[better]] = chosen[better], value[better], s
    return best, size, best.argmax(1)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, lang_pred, score and langs (the chosen set, in order of proportion) of every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, table))  # BUCKETS float32 per label
    source = docs.select(*dict.fromkeys((*keep, text)))
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, langs string"

    @task("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        wide = np.ascontiguousarray(table.T)
        for batch in batches:
            n = batch.num_rows
            pred, score, sets = [UNKNOWN] * n, np.zeros(n), [""] * n
            column = batch.column(batch.schema.get_field_index(text))
            for a, b, raw, offs in blocks(*texts(column), limit=BLOCK_BYTES * 4 // max(len(langs), 16)) if langs else ():
                cell, first, rows, sizes = grams(raw, offs)
                if not len(rows):
                    continue
                words = np.add.reduceat(wide[cell], first[:-1], axis=0) * TEMPER
                mix, _, best = infer(words, rows, b - a)
                ascii_letter = np.bincount(rows, minlength=b - a) > 0
                for k in np.flatnonzero(ascii_letter).tolist():
                    part = raw[offs[k] : offs[k + 1]]
                    if not (_LETTER[:128][part[part < 128]]).any() and not any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace")):
                        continue
                    pred[a + k], score[a + k] = langs[best[k]], mix[k, best[k]]
                    sets[a + k] = langs[best[k]] if mix[k, best[k]] == 1 else ",".join(langs[x] for x in np.argsort(-mix[k], kind="stable") if mix[k, x] > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(pred), pa.array(np.minimum(score, 1.0)), pa.array(sets)], names=[*(f.name for f in kept), "lang_pred", "score", "langs"])

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Fit on the training folds of docs and predict all of docs: doc_id, held_out, lang_pred, score, langs."""
    langs, table = fit(training_counts(docs, parts, held))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, table)
    return found.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "lang_pred", "score", "langs")
