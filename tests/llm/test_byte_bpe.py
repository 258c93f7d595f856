import functools
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tallylens.llm import byte_bpe
from tallylens.llm.byte_bpe import Codec, decode_ids, default_pattern, default_ranks, digest_ids, encode_rows, encode_texts, read_ranks
from tallylens.llm.common import texts
from tallylens.llm.queries import op13_byte_bpe


@functools.cache
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=read_ranks(default_ranks()), special_tokens={})


@functools.cache
def own():
    return Codec(default_ranks(), default_pattern())


def ids_of(rows):
    return encode_rows(own(), *texts(pa.array(rows, pa.string()))).to_pylist()


def check(rows):
    assert ids_of(rows) == [library().encode_ordinary(x) for x in rows]


def test_query_equals_library(spark, sf_dir):
    def row(doc_id, text):
        ids = library().encode_ordinary(text or "")
        return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in op13_byte_bpe(spark, sf_dir).collect()) == sorted(row(*r) for r in docs)


def test_code_points_in_context():
    points = [x for x in [*range(0x3400), *range(0xA000, 0xD7A4, 7), *range(0xE000, 0x20000, 11)] if not 0xD800 <= x < 0xE000]
    check([f"b{chr(x)}c 1{chr(x)} {chr(x)}\n{chr(x)}{chr(x)} d" for x in points])


def test_chunks_of_mixed_texts():
    random.seed(1)
    parts = ["a", "b", "ab", "the", " ", "  ", "\n", "é", "日本", "1", "22", ".", "--", "'s", "😀", "　", "\xa0", "“"]
    check(["".join(random.choice(parts) for _ in range(random.randint(0, 200))) for _ in range(1500)])


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "=-", "日本語", "0123456789", "\n \t"])
def test_joins_in_long_matches(letters, monkeypatch):
    """Long matches are trees of joins; leaves of other sizes give the same ids."""
    random.seed(2)
    rows = ["".join(random.choice(letters) for _ in range(n)) for n in (1, 63, 64, 65, 127, 129, 500, 3001)]
    for leaf in (64, 4, 1):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        for x in rows:
            for m in own().matches(x):
                assert own().tree(m.encode()) == library().encode_ordinary(m)


def test_windows_grow_until_borders_stand_apart():
    """Any cut of a match may be joined, also where all ids right of the cut change."""
    for text in ("a" * 100, "abcabcabc" * 9, "=" * 77, "antidisestablishmentarianism" * 3, "tototototo"):
        data, whole = text.encode(), library().encode_ordinary(text)
        for cut in range(len(data) + 1):
            assert own().join(own().tree(data[:cut]), own().tree(data[cut:])) == whole


def test_memo_may_be_small(monkeypatch):
    rows = [" ".join(f"w{k}x{k % 7}" for k in range(300)) for _ in range(3)]
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    check(rows)


def test_odd_rows(spark, odd, empty):
    odd = odd.withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    big = spark.createDataFrame([(9, "ab cd " * 500_000), (10, "z" * 3_000_000)], "doc_id long, text string")
    for docs in (odd, big):
        got = decode_ids(encode_texts(docs))
        assert set(docs.columns) == set(got.columns) - {"ids", "decoded"} | set(docs.columns) & {"ids", "decoded"}
        for r in got.collect():
            assert r.ids == library().encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    assert digest_ids(decode_ids(encode_texts(empty))).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in decode_ids(lists).collect()} == {1: b"", 2: b"", 3: b"ab"}
    with pytest.raises(PythonException):
        decode_ids(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
