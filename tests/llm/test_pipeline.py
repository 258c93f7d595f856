import re

import corpus_pipeline as C
from tallylens.llm.pii import find_pii

from .conftest import ODD_ROWS
from .test_jaccard import brute
from .test_pii import plain
from .test_tokens import check_pieces


def test_stages_equal_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    first = C.settle(C.languages(spark, docs, sf), "t")
    a, b = texts(docs), texts(first)
    assert b == {i: t for i, t in a.items() if t and any(c.isalpha() for c in t)} and first.columns == docs.columns
    second = C.settle(C.near_duplicates(spark, first, sf), "t")
    c = texts(second)
    assert c == {i: b[i] for i, (_, least) in brute(list(b.items()), 5, 80).items() if i == least}
    third = C.settle(C.benchmark(spark, second, sf), "t")
    d = texts(third)
    bare = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [bare(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert d == {i: t for i, t in c.items() if not any(x in bare(t) for x in items)}
    fourth = C.settle(C.personal_data(spark, third, sf), "t")
    e = texts(fourth)
    assert set(e) == set(d) and fourth.columns == docs.columns
    for r in find_pii(third).collect():
        text, out, at = d[r.doc_id], "", 0
        for s, e_, kind in sorted((x.s, x.e, x.kind) for x in r.spans):
            if s >= at:
                out += text[at:s] + f"[{kind.upper()}]"
            at = max(at, e_)
        assert e[r.doc_id] == out + text[at:]
        assert not plain(e[r.doc_id]) and (plain(text) or r.spans or e[r.doc_id] == text)
    assert {r.doc_id: r.n_chars for r in fourth.collect()} == {i: len(t) for i, t in e.items()}
    assert check_pieces(C.packing(spark, fourth, sf).collect(), e) == 0


def test_odd(spark, odd, empty):
    sf, rows = "/root/testdata/sf0.001", odd
    for name, stage in C.STAGES:
        rows = C.settle(stage(spark, rows, sf), "t")
        if name != "packing":
            assert rows.columns == odd.columns
    assert {r.doc_id for r in rows.collect()} == {3, 5, 6, None}
    rows = empty
    for _, stage in C.STAGES:
        rows = C.settle(stage(spark, rows, sf), "t")
    assert rows.count() == 0
    assert len(ODD_ROWS) == 7


def test_rows_that_share_an_id(spark):
    """Rows are judged by their own texts: only the copies go, and only the contaminated row."""
    sf = "/root/testdata/sf0.001"
    a, b = "one text that nobody else has in this table at all", "another text that stands here twice in the same words"
    docs = spark.createDataFrame([(7, a), (7, b), (3, b), (None, b), (None, a + " more words behind it"), (7, a)], "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in C.near_duplicates(spark, docs, sf).collect())
    assert left == sorted([(7, a), (3, b), (0, a + " more words behind it")])
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(7, a), (7, item), (None, item), (None, b)], "doc_id long, text string")
    assert {r.text for r in C.benchmark(spark, docs, sf).collect()} == {a, b}
