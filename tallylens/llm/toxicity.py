"""Toxicity by a weighted finite-state pattern grammar over clauses.

Lexical transducer: a word is mapped to classes. Threat verbs, targets, negations and reported-speech verbs are
the fixed lists below; insults are the fixed list and the stems learned from labels. Clause transducers: negation,
reported speech and target are one machine each, whose state counts the words that its scope still covers and which
marks the insults and threats in it. They are composed once into one machine that reads a clause (up to . ! ? ; or
a line end) from the left; the target machine then reads what that wrote from the right, for targets that follow,
and a last transducer turns marked words into patterns. The weight on a pattern's arc is the share of toxic labels
among the training texts whose gravest pattern it is, smoothed; of the arcs of a clause the gravest counts, and a
text's score combines its clauses as independent evidence, so more matched clauses score higher and a text without
one scores the share of toxic labels among such texts.

Learning: at most SAMPLE labelled training documents (those of the least hash of their id) are used, the one
bound of the classifier. Stems are the 4, 5, 6 and 8 byte beginnings of words; Spark counts the toxic and the
clean documents of each, and from the stems that are frequent in toxic and absent from nearly all clean documents
a greedy cover keeps the fewest that explain the toxic documents, most documents first. Features are words of the
text alone; labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no clause and get the score of such texts; without labels, the fixed
lists and a prior weight are used; several labels of one document count as toxic if any is; an empty table gives
no rows; words of any length are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold, lowered, mixed, runs, settle, task, texts

# The grammar's word lists.
INSULTS = "idiot moron imbecile scum stupid pathetic worthless loser trash clown disgusting dumb vermin filth bastard jerk coward fool garbage".split()
THREATS = "kill hurt destroy beat strangle shoot stab crush murder burn".split()
TARGETS = "you your yours yourself he she they him her them his their everyone people".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without nobody hardly".split()
REPORTS = "said says say told claimed claims reported reports wrote quoted according called".split()

#: Labelled documents that stems and weights are learned from, at most.
SAMPLE = 24_000
#: Toxic documents that a stem must explain anew, at least; and the share of toxic among its documents.
SUPPORT, PURITY = 3, 0.9
#: Words between an insult or threat and its target, negation or reporting verb.
REACH = 6
PRIOR = {"insult": 0.9, "threat": 0.8, "negated": 0.5, "reported": 0.5, "none": 0.02}
CUT = 0.7

_WIDTHS = (4, 5, 6, 8)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[33, 46, 59, 63, 10]] = True


def _tagged(key: np.ndarray, width: int) -> np.ndarray:
    return mixed(key ^ np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))


def stem_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Keys of the first 4, 5, 6 and 8 bytes of each word; a shorter word is padded with zeros (the 8-byte key of a
    word under 8 bytes is the whole word), and has no key of a width that it does not fill but 8."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    size, key, out = ends - starts, np.zeros(len(starts), np.uint64), []
    for k in range(8):
        key = key | np.where(k < size, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in _WIDTHS:
            tagged = _tagged(key, k + 1)
            out.append(tagged if k == 7 else np.where(size > k, tagged, np.uint64(0)))
    return out


def word_key(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(stem_keys(raw, np.array([0]), np.array([len(raw)]))[3][0])


def labelled(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most about `sample` labelled training documents."""
    marks = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", parts) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = settle(marks, "toxic-labels")
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id")


def _stem_rows(rows: DataFrame) -> DataFrame:
    """(key, toxic documents, clean documents), summed in each task before the shuffle."""
    kinds = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, toxic = [], []
        for batch in batches:
            marks = np.asarray(batch.column(1)) > 0
            for a, b, raw, offs in blocks(*texts(batch.column(0))):
                low = lowered(raw)
                starts, ends, rows = runs(_WORD[low], offs)
                for key in stem_keys(low, starts, ends):
                    has = key != 0
                    order = np.lexsort((rows[has], key[has]))
                    k, r = key[has][order], rows[has][order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                    keys.append(k[new])
                    toxic.append(marks[a:b][r[new]])
        if keys:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            t = np.concatenate(toxic)
            hits, total = np.bincount(at, t, len(k)).astype(np.int64), np.bincount(at, minlength=len(k))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(hits), pa.array(total - hits)], schema=kinds)

    return rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "key long, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learn_stems(rows: DataFrame) -> np.ndarray:
    """Sorted keys of the learned stems. rows is bounded by SAMPLE, and so is what the cover reads on the driver; as each
    stem explains SUPPORT toxic documents anew, there are at most SAMPLE / SUPPORT."""
    pure = _stem_rows(rows).where((F.col("t") >= SUPPORT) & (F.col("t") >= PURITY * (F.col("t") + F.col("c")))).select("key", "t", "c").toArrow()
    if not pure.num_rows:
        return np.zeros(0, np.uint64)
    wanted = np.sort(np.asarray(pure["key"]).astype(np.int64).view(np.uint64))
    kinds = pa.schema([("doc", pa.int64()), ("key", pa.int64())])

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, raw, offs in blocks(*texts(batch.column(1))):
                low = lowered(raw)
                starts, ends, rows = runs(_WORD[low], offs)
                for key in stem_keys(low, starts, ends):
                    hit = _in(key, wanted)
                    if hit.any():
                        found = np.unique(np.stack([ids[a:b][rows[hit]], key[hit].view(np.int64)], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=kinds)

    pairs = rows.where("toxic > 0").select("doc_id", "text").mapInArrow(run, "doc long, key long").toArrow()
    holders: dict[int, set] = defaultdict(set)
    for doc, key in zip(pairs["doc"].to_pylist(), pairs["key"].to_pylist(), strict=True):
        holders[key].add(doc)
    clean = dict(zip(pure["key"].to_pylist(), pure["c"].to_pylist(), strict=True))
    chosen, covered = [], set()
    for key in sorted(holders, key=lambda k: (-(len(holders[k]) - 4 * clean[k]), k)):
        fresh = holders[key] - covered
        if len(fresh) >= SUPPORT and (len(fresh) >= 0.2 * len(holders[key]) or len(fresh) >= 25):
            chosen.append(key)
            covered |= fresh
    return np.sort(np.array(chosen, np.int64).view(np.uint64)) if chosen else np.zeros(0, np.uint64)


def _in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(wanted, keys)
    return wanted[np.minimum(at, len(wanted) - 1)] == keys


def lexicon(stems: np.ndarray) -> list[tuple[str, np.ndarray]]:
    whole = lambda words: np.sort(np.array([word_key(w) for w in words], np.uint64))
    return [("I", np.unique(np.concatenate([stems, whole(INSULTS)]))), ("H", whole(THREATS)), ("T", whole(TARGETS)), ("N", whole(NEGATIONS)), ("R", whole(REPORTS))]


# Clause transducers. A machine is a list of states; a state maps the symbol it reads to (next state, symbol it writes).
Machine = list[dict[str, tuple[int, str]]]

#: Symbols: other words, classes, and insults and threats (I, H) with the marks n, r (negated, reported) and + (target).
GRAVE = [kind + mark + target for kind in "IH" for mark in ("", "n", "r") for target in ("", "+")]
TAPE = ["o", "T", "N", "R", *GRAVE]


def scope(opens: str, mark: str, over: list[str]) -> Machine:
    """Writes `mark` behind a symbol of `over` that stands at most REACH words after `opens`; everything else is copied.
    The state is the number of words that the scope still covers."""
    return [{s: (REACH if s == opens else max(left - 1, 0), s + mark if left and s in over else s) for s in TAPE} for left in range(REACH + 1)]


def compose(first: Machine, second: Machine) -> Machine:
    """One machine that writes what `second` writes on reading what `first` writes; states are the reachable pairs."""
    pairs = [(0, 0)]
    number, machine = {(0, 0): 0}, []
    for a, b in pairs:
        arcs = {}
        for symbol, (a_next, between) in first[a].items():
            b_next, out = second[b][between]
            if (a_next, b_next) not in number:
                number[a_next, b_next] = len(pairs)
                pairs.append((a_next, b_next))
            arcs[symbol] = (number[a_next, b_next], out)
        machine.append(arcs)
    return machine


def idle(machine: Machine) -> list[list[int]]:
    """The state that each state becomes after 0 to REACH other words, beyond which it stays."""
    steps = [list(range(len(machine)))]
    for _ in range(REACH):
        steps.append([machine[state]["o"][0] for state in steps[-1]])
    return steps


#: Target before or after; and negation, then report, then target, as one machine.
TARGETED = scope("T", "+", [s for s in GRAVE if not s.endswith("+")])
FORWARD = compose(compose(scope("N", "n", ["I", "H"]), scope("R", "r", ["I", "H"])), TARGETED)
TARGETED_IDLE, FORWARD_IDLE = idle(TARGETED), idle(FORWARD)
#: What the last transducer writes for a marked word; a threat without a target is no match.
ACCEPTED = {"I": "insult", "I+": "insult+target", "H+": "threat+target", "In": "negated", "In+": "negated+target", "Hn+": "negated+target", "Ir": "reported", "Ir+": "reported+target", "Hr+": "reported+target"}
#: Patterns from the gravest.
GRADES = ["insult+target", "insult", "threat+target", "reported+target", "reported", "negated+target", "negated"]


def read(machine: Machine, steps: list[list[int]], words: list[tuple[int, str]]) -> list[str]:
    """What the machine writes for the words (position, symbol) in their order, other words between them being left out."""
    state, last, out = 0, None, []
    for at, symbol in words:
        if last is not None:
            state = steps[min(abs(at - last) - 1, REACH)][state]
        state, written = machine[state][symbol]
        out.append(written)
        last = at
    return out


def clause_pattern(classes: list[tuple[int, str]]) -> str | None:
    """The gravest pattern of one clause, from its classed words (position, class) in order: FORWARD reads them from the
    left, TARGETED what that wrote from the right. Linear in the words, however long the clause is."""
    forward = read(FORWARD, FORWARD_IDLE, classes)
    marked = read(TARGETED, TARGETED_IDLE, [(at, mark) for (at, _), mark in zip(classes[::-1], forward[::-1], strict=True)])
    return min((ACCEPTED[m] for m in marked if m in ACCEPTED), key=GRADES.index, default=None)


def patterns(docs: DataFrame, words: list[tuple[str, np.ndarray]], keep: list[str]) -> DataFrame:
    """keep columns (first column: the text) and the number of matched clauses of each pattern, as an array."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", found array<int>"

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [[0] * len(GRADES) for _ in range(batch.num_rows)]
            for a, _, raw, offs in blocks(*texts(batch.column(0))):
                low = lowered(raw)
                starts, ends, rows = runs(_WORD[low], offs)
                if not len(starts):
                    continue
                keys = stem_keys(low, starts, ends)
                kind = np.zeros(len(starts), np.uint8)
                for name, wanted in words[::-1]:
                    hit = _in(keys[3], wanted)
                    if name == "I":
                        for key in keys[:3]:
                            hit |= _in(key, wanted)
                    kind[hit] = ord(name)
                grave = np.flatnonzero((kind == ord("I")) | (kind == ord("H")))
                if not len(grave):
                    continue
                stop = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(_SPACE[raw], out=stop[1:])
                clause = stop[starts] + rows * 0
                for g in np.unique(np.stack([rows[grave], clause[grave]], 1), axis=0):
                    lo = np.searchsorted(rows, g[0])
                    hi = np.searchsorted(rows, g[0], side="right")
                    lo, hi = lo + np.searchsorted(clause[lo:hi], g[1]), lo + np.searchsorted(clause[lo:hi], g[1], side="right")
                    at = np.flatnonzero(kind[lo:hi])
                    name = clause_pattern([(int(p), chr(kind[lo + p])) for p in at])
                    if name:
                        found[a + int(g[0])][GRADES.index(name)] += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(found, pa.list_(pa.int32()))], names=[*keep, "found"])

    return docs.mapInArrow(run, schema)


def weights(rows: DataFrame) -> dict[str, float]:
    """Share of toxic labels by the gravest pattern of a labelled text, smoothed towards PRIOR."""
    first = F.coalesce(*[F.when(F.col("found")[k] > 0, F.lit(name)) for k, name in enumerate(GRADES)], F.lit("none"))
    seen = {r.name: (r.t, r.n) for r in rows.groupBy(first.alias("name")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    out = {}
    for name in [*GRADES, "none"]:
        t, n = seen.get(name, (0, 0))
        out[name] = (float(t) + 5 * PRIOR[name.split("+")[0]]) / (n + 5)
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and the gravest pattern of every document."""
    train = settle(labelled(docs, labels, parts, held).where("text is not null"), "toxic-sample")
    words = lexicon(learn_stems(train))
    weight = weights(patterns(train.select("text", "doc_id", F.col("toxic").cast("int").alias("toxic")), words, ["doc_id", "toxic"]))
    found = patterns(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), words, ["doc_id"])
    matched = sum((F.col("found")[k] for k in range(len(GRADES))), F.lit(0))
    # a text is clean if no clause makes it toxic; smoothing keeps every weight below 1, so all clauses count in logs
    clean = sum((F.col("found")[k] * F.lit(math.log1p(-weight[name])) for k, name in enumerate(GRADES)), F.lit(0.0))
    score = F.when(matched == 0, F.lit(float(weight["none"]))).otherwise(-F.expm1(clean))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    pattern = F.coalesce(*[F.when(F.col("found")[k] > 0, F.lit(name)) for k, name in enumerate(GRADES)], F.lit("none"))
    return found.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"), pattern.alias("pattern"))
