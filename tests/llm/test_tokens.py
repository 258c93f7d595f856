import functools
import random
import zlib

import numpy as np
import pytest
from tallylens.llm.encode import default_tokenizer, encoder
from tallylens.llm.packing import CUT, Packer, pack
from tallylens.llm.token_files import FileReader, encode_corpus, read_documents, write_files

from .conftest import ODD_ROWS


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(text, end):
    t = library()
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def test_chunks_equal_whole_texts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "  a  b ", "x\n y\t z  \n\n q ", "a \x1c b \x85c", "trail ", "<|endoftext|> a <|endof text|>", " <|endoftext|>"]
    for text, got in zip(texts, encoder(default_tokenizer()).encode(texts), strict=True):
        assert got + b"\1\0\0\0" == ids_of(text, 1)


def test_place_is_least_sum_of_squares():
    """Against all places tried out on a copy of the level counts."""
    random.seed(1)
    window, step = 64, 2
    p = Packer(window, 0)
    assert p.step == step
    for k in range(400):
        s = random.randint(1, window - 1)
        fills = p.fill[:]

        def squares(left):
            n = [0] * (window // step + 1)
            for f in left:
                n[f // step] += 1
            return sum(x * x for x in n)

        tried = [(squares(fills + [s]), 1, 0, -1)]
        for i, f in enumerate(fills):
            left = fills[:i] + fills[i + 1 :]
            if f + s <= window:
                tried.append((squares(left + [f + s] * (f + s < window)), 0, -f, i))
            else:
                tried.append((squares(left + [f + s - window]) + CUT, 2, -f, i))
        got = p.place(s)
        assert next(t[:3] for t in tried if t[3] == got) == min(t[:3] for t in tried)
        p.add(k, b"\0\0\0\0" * s)
    assert len(p.open) <= window // step * (CUT // 2 + 1)


def test_few_ids_move_at_the_end():
    random.seed(2)
    p, total = Packer(2048, 0), 0
    for k in range(5000):
        n = random.choice([30, 200, 700, 1500, 5000])
        n, total = n + random.randrange(n), total + n
        p.add(k, b"\0\0\0\0" * n)
    assert len(p.open) <= 32 * (CUT // 2 + 1)
    p.finish()
    assert p.moved < 0.02 * total


def check_pieces(rows, texts, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids, at = ids_of(text, 1), 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids) // 4)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at * 4 == len(ids)
    assert not by_doc
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad


def test_pack_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check_pieces(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}) == 0


def test_pack_odd(spark, odd, empty):
    once = {r[0]: r[1] for r in ODD_ROWS}
    rows = pack(odd.dropDuplicates()).collect()
    check_pieces(rows, once)
    assert sum(r.length for r in pack(odd).collect()) == sum(len(ids_of(r[1], 1)) // 4 for r in ODD_ROWS)
    assert pack(empty).count() == 0


def test_files_round_trip(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, at = sorted(encode_corpus(spark, docs).collect(), key=lambda r: r.doc_id), 0
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert [r.doc_id for r in got] == [t[0] for t in texts]
    for r, (_, text) in zip(got, texts, strict=True):
        ids = ids_of(text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert encode_corpus(spark, odd).count() == len(ODD_ROWS)
    assert encode_corpus(spark, empty).count() == 0


def test_files_follow_text_bytes_and_split_ties(spark, tmp_path):
    """More text makes more files, and rows of one id (or of none) are dealt over several of them, in order."""
    docs = spark.createDataFrame([(None if k % 2 else 7, "same words" if k % 3 else f"other {k}") for k in range(4000)], "doc_id long, text string")
    files = write_files(docs, f"file://{tmp_path}/t", file_bytes=2000).collect()
    assert len(files) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(f.docs for f in files) == 4000 and max(f.docs for f in files) < 1000
    got = sorted(encode_corpus(spark, docs, f"file://{tmp_path}/u", file_bytes=2000).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None] * 2000 + [7] * 2000
    want = sorted((r.doc_id or 0, zlib.crc32(ids_of(r.text, 2))) for r in docs.collect())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == want


def test_reader_reads_wanted_frames_and_checks_them(spark, tmp_path, odd):
    files = write_files(odd, f"file://{tmp_path}/t", parts=1)
    assert {r.doc_id for r in read_documents(files, {5, 6}).collect()} == {5, 6}
    raw = bytearray((tmp_path / "t/part-000000.tzs").read_bytes())

    class Source:
        def __init__(self, raw):
            self.raw, self.at = raw, 0

        def size(self):
            return len(self.raw)

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.at += n
            return bytes(self.raw[self.at - n : self.at])

    reader = FileReader(Source(raw))
    doc = next(d for d in reader.docs if d[0] == 6)
    assert reader.read(doc) == ids_of("x" * 30000, 2)
    size, _, check = doc[4][0]
    reader.frames[0] = (size, doc[4][0][1], check ^ 1)
    with pytest.raises(ValueError):
        reader.read((*doc[:4], [(size, doc[4][0][1], check ^ 1)]))


def test_marked_chunks_come_from_bare_ones(monkeypatch):
    """Chunks with marks at their end take the ids of the bare chunk, and texts have the ids of the plain tokenizer."""
    from tallylens.llm.encode import Encoder, default_tokenizer

    coder, asked = Encoder(default_tokenizer()), []
    plain = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda parts: asked.extend(parts) or plain(parts))
    texts = ["a wordly wordly. wordly?! wordly... it's it's. né né. x1 x1. .. a.b a.b. don't, <|endoftext|> <|endoftext|>. wordly'. é.. Wordly;", "b wordly!"]
    got = coder.encode(texts) + coder.encode(texts)
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert " wordly" in asked and not {" wordly.", " wordly?!", " wordly!"} & set(asked)
