import random

import numpy as np
import pytest
from tallylens.llm import toxicity as T

from .conftest import ODD_ROWS


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = T.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 100
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8  # some labels are wrong
    assert sum(r.predicted for r in clean) / len(clean) < 0.02


def stems(*words):
    keys = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        keys.append(int(T.stem_keys(raw, np.array([0]), np.array([len(raw)]))[1][0]))
    return np.sort(np.array(keys, np.uint64))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What a fine day.", []),
        ("You are an idiot", ["insult+target"]),
        ("the IDIOT here; pathetic!", ["insult", "insult"]),
        ("He is not an idiot", ["negated+target"]),
        ("someone said idiot once", ["reported"]),
        ("I will kill you. kill time", ["threat+target"]),
        ("loweischaft und loweind", ["insult"]),
        ("idiotic", []),
        ("", []),
        (None, []),
        ("idiot " * 5000, ["insult"]),
    ],
)
def test_grammar(spark, text, want):
    docs = spark.createDataFrame([(text, 1)], "text string, doc_id long")
    found = T.patterns(docs, T.lexicon(stems("lowei")), ["doc_id"]).first().found
    assert sorted(n for n, k in zip(T.GRADES, found, strict=True) for _ in range(k)) == sorted(want)


def brute_pattern(classes):
    """The gravest pattern by looking at every pair of words."""
    names = []
    for at, kind in classes:
        if kind in "IH":
            near = {k for p, k in classes if k == "T" and abs(p - at) <= T.REACH or k in "NR" and 0 < at - p <= T.REACH}
            if kind == "I" or "T" in near:
                name = "negated" if "N" in near else "reported" if "R" in near else "insult" if kind == "I" else "threat"
                names.append(name + ("+target" if "T" in near else ""))
    return min(names, key=T.GRADES.index, default=None)


def test_composed_machine_equals_brute_force():
    random.seed(3)
    seen = set()
    for k in range(4000):
        words = random.choices("oIHTNR", [random.choice([1, 6, 20]), 2, 2, 2, 2, 2], k=random.randint(0, 200 if k % 50 == 0 else 16))
        classes = [(at, c) for at, c in enumerate(words) if c != "o"]
        assert T.clause_pattern(classes) == brute_pattern(classes), words
        seen.add(T.clause_pattern(classes))
    assert seen == {None, *T.GRADES}


def test_negation_in_a_long_clause(spark):
    text = "you " * 1000 + "not an idiot " + "you " * 1000
    docs = spark.createDataFrame([(text, 1)], "text string, doc_id long")
    found = T.patterns(docs, T.lexicon(stems("lowei")), ["doc_id"]).first().found
    assert dict(zip(T.GRADES, found, strict=True)) == {g: int(g == "negated+target") for g in T.GRADES}


def test_every_clause_counts(spark):
    """The score by its definition, for texts of up to 40 matched clauses, which no bound cuts off."""
    base = [(k, "you are an idiot" if k % 2 else "a fine day") for k in range(60)]
    docs = [*base, *((100 + n, "She was not an idiot. " * n + "A fine day.") for n in range(41))]
    labels = [(k, k % 2) for k in range(60)] + [(100 + n, int(n % 4 == 0)) for n in range(41)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = T.labelled(docs, labels, 3, 1).where("text is not null")
    words = T.lexicon(T.learn_stems(train))
    weight = T.weights(T.patterns(train.select("text", "doc_id", "toxic"), words, ["doc_id", "toxic"]))
    found = {r.doc_id: r.found for r in T.patterns(docs.select("text", "doc_id"), words, ["doc_id"]).collect()}
    got = {r.doc_id: r.score for r in T.score_toxicity(docs, labels).collect()}
    for i, counts in found.items():
        clean = 1.0
        for name, n in zip(T.GRADES, counts, strict=True):
            clean *= (1 - weight[name]) ** n
        assert abs(got[i] - (1 - clean if sum(counts) else weight["none"])) < 1e-12
    assert max(map(sum, found.values())) == 40 and got[108] < got[109] < got[120] <= 1


def test_odd(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = T.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert T.score_toxicity(empty, labels).count() == 0
    assert T.score_toxicity(odd, labels.limit(0)).count() == len(ODD_ROWS)
