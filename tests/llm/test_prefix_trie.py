import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tallylens.llm import prefix_trie
from tallylens.llm.prefix_trie import borrowed_paths, own_paths, prefix_nodes
from tallylens.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def built(rows, borrow=True):
    turns = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            turns[r[0]].append((r[1], r[2] or "", r[3] or ""))
    for c in turns:
        turns[c].sort(key=lambda t: (t[0] is not None, t[0] or 0))
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        out[c] = tuple(t[1:] for t in [*turns.get(c - c % 20, [])[:h], *turns[c][h:]])
    return out


def brute(paths):
    """Nodes by walking every prefix of every conversation."""
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    for v in members:
        if v:
            children[v[:-1]] += 1
    for v in members:
        words = (len(members[v]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0)
        for d in range(len(v) + 1):
            saved[v[:d]] += words
            leaves[v[:d]] += children[v] == 0
    ends = {v: ",".join(str(c) for c in m if len(paths[c]) == len(v)) for v, m in members.items()}
    return sorted(
        (m[0], len(v), members[v[:-1]][0] if v else None, len(m), children[v], leaves[v], saved[v], hashlib.sha256(ends[v].encode()).hexdigest())
        for v, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_nodes_equal_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows_of(op11_prefix_trie(spark, sf_dir)) == brute(built(table.collect()))
    assert rows_of(prefix_nodes(own_paths(table))) == brute(built(table.collect(), borrow=False))


def test_odd_rows(spark):
    rows = [
        (20, 1, "u", "hello there"), (20, None, None, None), (20, 2, "a", ""), (21, 1, "u", "x"), (22, 0, "u", "hello there"),
        (23, 1, "u", "w " * 1_500_000), (24, 1, "u", "w " * 1_500_000), (63, 1, "a", "only"), (105, 4, None, "b"), (-3, 1, "u", "x"),
        (None, 1, "u", "nobody's"), (0, 1, "u", "hello there"), (1, 1, "u", "hello there"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("depth", "k", "a", "b", "words", "family", "owner", "last")})
    assert rows_of(prefix_nodes(own_paths(df))) == brute(built(rows, borrow=False))
    want = {c: t for c, t in built([r for r in rows if r[0] != -3]).items()}
    got = rows_of(prefix_nodes(borrowed_paths(df.where("conv_id <> -3"))))
    assert got == brute(want)
    assert any(len(t) == 0 for t in want.values())  # turnless conversations are members of the root


def test_hot_node_and_blocks(spark, monkeypatch):
    """Thousands of copies, whose ids fill several blocks, give the same sums with blocks of another size."""
    rows = [(c, t, "u", f"turn {t}") for c in range(3000) for t in (1, 2)] + [(c, 1, "u", f"own {c}") for c in range(3000, 3100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(built(rows, borrow=False))
    assert rows_of(prefix_nodes(own_paths(df))) == want
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    assert rows_of(prefix_nodes(own_paths(df))) == want


@pytest.mark.parametrize("paths", [own_paths, borrowed_paths])
def test_empty(spark, paths):
    assert prefix_nodes(paths(spark.createDataFrame([], SCHEMA))).collect() == []
