import re

from tallylens.llm import token_counts as C

from .conftest import ODD_ROWS


def viterbi(word, pieces):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + C.FALLBACK, -best[end - 1][1] - 1)]
        options += [(best[at][0] + pieces[word[at:end]], -best[at][1] - 1) for at in range(max(0, end - 64), end) if word[at:end] in pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1], best[-1][0]


def plain(text, pieces):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    values = [viterbi(C.SPACE + w, pieces) for w in words]
    return len(words), sum(v[0] for v in values), sum(v[1] for v in values)


def test_equals_plain_segmentation(spark):
    pieces = C.unigrams(C.default_vocabulary())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    want = {r.doc_id: plain(r.text, pieces) for r in docs.collect()}
    for r in C.count_tokens(docs).collect():
        n, tokens, score = want[r.doc_id]
        assert (r.n_pretokens, r.n_tokens) == (n, tokens) and abs(r.score - score) < 1e-6 * max(1, abs(score))


def test_shared_prefixes_and_full_memo(monkeypatch):
    pieces = {b"a": -1.0, b"ab": -1.5, b"abc": -4.0, b"c": -1.0, C.SPACE: -1.0, C.SPACE + b"a": -1.2}
    counter = C.TrieCounter(pieces)
    words = [b"abc", b"ab", b"abcab", b"zab", b"", b"a" * 50]
    assert counter.count(words) == {w: viterbi(C.SPACE + w, pieces) for w in words}


def test_odd(spark, odd, empty, monkeypatch):
    pieces = C.unigrams(C.default_vocabulary())
    rows = C.count_tokens(odd.where("doc_id <> 6 or doc_id is null")).collect()
    want = sorted((str(r[0]), *plain(r[1], pieces)[:2]) for r in ODD_ROWS if r[0] != 6)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in rows) == want
    assert C.count_tokens(odd).count() == len(ODD_ROWS)
    assert C.count_tokens(empty).count() == 0
