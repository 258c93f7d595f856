import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tallylens.llm import lm_score as L

from .conftest import ODD_ROWS


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base(rows):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]) for i, t in rows]
    train = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for w in ws)
    total, kinds = sum(train.values()), len(train)
    return [(i, len(ws), sum(train[w] > 0 for w in ws), total, sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in ws)) for i, ws in tokens]


def ppm(train, text, order=L.ORDER):
    """log10 probability by a dictionary trie, symbol by symbol."""
    count = defaultdict(Counter)
    for t in train:
        s = [L.MARK] * order + list(lower(t).encode()) + [L.MARK]
        for k in range(order, len(s)):
            for o in range(order + 1):
                count[tuple(s[k - o : k])][s[k]] += 1
    s, total = [L.MARK] * order + list(lower(text).encode()) + [L.MARK], 0.0
    for k in range(order, len(s)):
        out: set = set()
        for o in range(order, -1, -1):
            c = {x: n for x, n in count[tuple(s[k - o : k])].items() if x not in out} if tuple(s[k - o : k]) in count else {}
            if not c:
                continue
            den = 2 * sum(c.values())
            if s[k] in c:
                total += math.log10((2 * c[s[k]] - 1) / den)
                break
            total += math.log10(len(c) / den)
            out |= set(c)
        else:
            total -= math.log10(256 - len(out))
    return total


def close(a, b):
    return abs(a - b) <= 1e-6 * max(1, abs(b))


def test_equals_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.score_documents(docs).collect()}
    for i, n, known, total, value in base(rows):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total) and close(got[i].base_score, value)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, t in sorted(rows, key=lambda r: len(r[1]))[:25]:
        assert close(got[i].score, ppm(train, t)), i
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.score < 0 for r in held)


def test_compresses_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in L.score_documents(docs).join(docs.selectExpr("doc_id", "octet_length(text) size"), "doc_id").collect() if r.held_out]
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(r["size"] + 1 for r in rows)
    assert len(rows) > 80 and bits < 2.6


def test_probabilities_of_a_context_add_up():
    texts_ = ["abracadabra", "abc", "cab"]
    raw = np.frombuffer("".join(texts_).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t) for t in texts_])
    keys, counts = np.unique(L.gram_keys(*L.marked(raw, offs), L.ORDER + 1), return_counts=True)
    trie = L.Trie(keys, counts.astype(np.int64))
    for prefix in (b"", b"abra", b"zab", b"cada", b"abracad"):
        total = 0.0
        for x in range(256):
            s = np.frombuffer(prefix + bytes([x]), np.uint8)
            total += 10 ** trie.log10(s, np.array([0, len(s)]))[len(prefix)]
        assert abs(total - 1) < 1e-9


def test_odd(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(L, "SLAB_BYTES", 10)
    rows = L.score_documents(odd).collect()
    want = base([r[:2] for r in ODD_ROWS])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in rows) == sorted((str(w[0]), *w[1:4]) for w in want)
    assert L.score_documents(empty).count() == 0
    alone = spark.createDataFrame([(k, "some text") for k in range(60)], "doc_id long, text string").where(L.fold("doc_id", 7) == 2)
    assert {(r.base_score, r.train_tokens, round(r.score, 6)) for r in L.score_documents(alone).collect()} == {(0.0, 0, round(-10 * math.log10(256), 6))}


def test_rare_grams_count_in_any_number(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 20)
    rows = [(k, f"w{k} the {k * 7919 % 1000} house é{k}" if k % 5 else "the house") for k in range(40)]
    got = {r.doc_id: r.score for r in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert all(close(got[i], ppm(train, t)) for i, t in rows)
