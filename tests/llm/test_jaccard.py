import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tallylens.llm import jaccard_join as J

from .conftest import ODD_ROWS


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(rows, width, percent):
    """{doc_id: (size, component)} by all pairs that share a shingle."""
    sets = {i: plain_set(t, width) for i, t in rows}
    holders, label = defaultdict(list), {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for w in s:
            holders[w].append(i)
    seen = set()
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in seen and top(i) != top(j):
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((top(i), top(j)))
                        label[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_shingles_equal_plain_sets():
    texts_ = ["a b c d A b c", "", "x", "x y", " lead  two\tthree\nfour ", "ñ 日本 É é x", "one two"]
    raw = np.frombuffer("".join(texts_).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts_])
    for width in (1, 2, 3, 5):
        h, first, _ = J.shingles(J.lowered(raw), offs, width)
        sizes = [len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])]
        assert sizes == [len(plain_set(t, width)) for t in texts_]
        same = {t: np.unique(h[a:b]).tobytes() for t, a, b in zip(texts_, first[:-1], first[1:])}
        assert len({same[t] for t in texts_ if t}) == len({plain_set(t, width) for t in texts_ if t})


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(J.jaccard_classes(docs, width, percent)) == brute(rows, width, percent)


@pytest.mark.parametrize(("small", "rest"), [(2, 0), (48, 16)])
def test_chains_groups_and_shared_passages(spark, monkeypatch, small, rest):
    """Chains that drift word by word, groups of copies, and unlike texts around one passage."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "REST", rest)
    monkeypatch.setattr(J, "PIVOTS", 2)
    random.seed(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(4):
        base = random.choices(words, k=60)
        for k in range(40):
            if family % 2:
                base = base[:]
                base[random.randrange(60)] = random.choice(words)  # drifts away from the first text
                rows.append(base)
            else:
                text = base[:]
                for _ in range(random.randrange(4)):
                    text[random.randrange(60)] = random.choice(words)
                rows.append(text)
    passage = random.choices(words, k=55)
    rows += [random.choices(words, k=3) + passage + random.choices(words, k=random.randrange(8)) for _ in range(60)]
    rows += [rows[0]] * 5 + [["a"], ["a"], ["b", "a"], []]
    random.shuffle(rows)
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    got = result(J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90))
    assert got == brute(rows, 3, 90)


def test_odd(spark, odd, empty):
    rows = J.jaccard_classes(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id != 5} == {(3, 3), (1, 1), (2, 2), (6, 6), (None, None)}
    assert J.jaccard_classes(empty).count() == 0


def test_long_texts_at_the_threshold(spark):
    """Sets of 120,000 shingles just under and at the threshold: every shingle counts, and texts are beyond one block."""
    random.seed(11)
    base = [f"{random.getrandbits(40):x}" for _ in range(120_002)]

    def changed(k):  # replaces the last words: k shingles fewer in common
        return base[: len(base) - k] + [f"z{j}" for j in range(k)]

    need = -(-180 * 120_000 // 190)  # 100 s >= 90 (2 n - s)
    rows = [(1, base), (2, changed(120_000 - need)), (3, changed(120_000 - need + 1))]
    rows = [(k, " ".join(w)) for k, w in rows]
    docs = spark.createDataFrame(rows[:1] + rows[2:], "doc_id long, text string")
    assert {i: c for i, (_, c) in result(J.jaccard_classes(docs, 3, 90)).items()} == {1: 1, 3: 3}
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string")
    assert {i: c for i, (_, c) in result(J.jaccard_classes(docs, 3, 90)).items()} == {1: 1, 2: 1}


def test_oracle(spark):
    """The registered SQL gives the same rows."""
    import duckdb

    from tallylens.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op4_jaccard_join"]).fetchall())
    got = QUERIES["op4_jaccard_join"](spark, sf)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of which about half of all pairs reach the threshold become one component by some pairs for each copy."""
    random.seed(3)
    base = [f"{random.getrandbits(24):x}" for _ in range(150)]
    rows = []
    for k in range(600):
        text = base[:]
        for at in random.sample(range(5, 145), 1 + (k % 3 > 0) + (k % 12 == 5)):
            text[at] = f"{random.getrandbits(24):x}"
        rows.append((k, " ".join(text)))
    tested, near = [], J._near
    monkeypatch.setattr(J, "_near", lambda pairs, *rest: tested.append(pairs.count()) or near(pairs, *rest))
    got = result(J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80))
    assert got == brute(rows, 5, 80)
    assert sum(tested) <= 16 * len(rows), tested
