import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallylens.llm import periodic_runs
from tallylens.llm.periodic_runs import digest_runs, find_runs, repeated_tails, runs_of
from tallylens.llm.queries import op12_periodic_runs


def brute(w, least=6, times=4):
    """Every period, every maximal stretch of equal words at that distance; a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def wanted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, gone = brute(w), set()
    for s, length, p in found:
        gone.update(range(s + p, s + length))
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    sums = ("".join("%d,%d,%d\n" % r for r in found), " ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, *(hashlib.sha256(x.encode()).hexdigest() for x in sums))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(op12_periodic_runs(spark, sf_dir))
    assert got == sorted((wanted(*r) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=8), max_size=4))
def test_runs_of_texts_side_by_side(texts):
    rows = [[x for block, n in text for x in block * n] for text in texts]
    flat, offs = np.array([x for r in rows for x in r], np.int64), np.cumsum([0, *map(len, rows)])
    got = runs_of(flat, offs, 6, 4)
    assert [got.get(k, []) for k in range(len(rows))] == [brute(r) for r in rows]


def test_long_rows():
    """One word throughout, and Fibonacci and Thue-Morse words, which repeat at every size."""
    assert runs_of(np.zeros(300_000, np.int64), np.array([0, 300_000]), 6, 4) == {0: [(0, 300_000, 1)]}
    a, b = [1], [1, 2]
    while len(b) < 1000:
        a, b = b, b + a
    thue = [k.bit_count() % 2 for k in range(1024)]
    for w in (b, thue, (b[:300] + thue[:200]) * 4):
        assert runs_of(np.array(w), np.array([0, len(w)]), 6, 4).get(0, []) == brute(w)


def test_steps_do_not_matter(monkeypatch):
    w = np.array(([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 5 + [0]) * 3)
    want = runs_of(w, np.array([0, len(w)]), 6, 4)
    monkeypatch.setattr(periodic_runs, "STEPS", 2)
    assert runs_of(w, np.array([0, len(w)]), 6, 4) == want == {0: brute(w.tolist())}


def test_odd_rows(spark, odd, empty):
    odd = odd.withColumns({"runs": F.lit(1), "period": F.lit("p"), "length": F.lit(0), "n_words": F.lit(0), "collapsed": F.lit("")})
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = find_runs(odd)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows_of(digest_runs(find_runs(repeated_tails(odd)))) == sorted((wanted(*r) for r in rows), key=str)
    for r in got.collect():
        assert r.n_words == len(words(r.text))
        assert [tuple(x) for x in r.runs] == brute(words(r.text))
    assert find_runs(empty).collect() == []
    assert digest_runs(find_runs(repeated_tails(empty))).collect() == []
    big = spark.createDataFrame([(9, "ab cd " * 600_000), (10, "z" * 3_000_000)], "doc_id long, text string")
    assert [(r.n_words, [tuple(x) for x in r.runs], len(r.collapsed)) for r in find_runs(big).orderBy("doc_id").collect()] == [(1_200_000, [(0, 1_200_000, 2)], 5), (1, [], 3_000_000)]
    with pytest.raises(ValueError, match="four periods"):
        find_runs(odd, times=3)
