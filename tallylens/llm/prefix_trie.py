"""Prefix trie of conversations: shared histories, and the tokens that storing each of them once would save.

Every conversation is a path from the textless root; a node is a distinct sequence of first turns. Each node belongs
to its smallest member, so a conversation owns exactly the lower end (a suffix) of its own path: from the depth where
it becomes the smallest member down to its last turn. A node's subtree holds the same tokens as its members' paths below
that depth, less the repetitions: what its members' turns hold, minus what the members own there. So subtree sums need
no walk over the tree: one group-by on the prefix sums both over the occurrences.

Turns become two 64-bit hashes and a word count before anything is shuffled; a prefix is known by two exclusive sums of
its turns' hashes with their depths (128 bits). The owner of a node is a minimum by group-by, not a window over the
node: the root and common first turns have all conversations in one group, and a minimum combines on the map side.

Defined results: rows without conv_id belong to no conversation; a null turn comes first, turns of equal number are
ordered by their hashes; null role and text are empty; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, settle, task

#: The sorted ids of the conversations that end at a node are joined in blocks of 2^10 neighbouring ids (20 KB at most).
BLOCK_BITS = 10
_NODE = ("p1", "p2")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (place by turn, from 1), a and b (hashes of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(text, F.lit(2), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return turns.repartition(family(F.col("conv_id"))).withColumn("family", family(F.col("conv_id")))


def family(conv_id: Column, size: int = 20) -> Column:
    return conv_id - conv_id % size


def _row(depth: Column, turn: Column | None = None) -> Column:
    a, b, words = (turn[c] if turn is not None else F.lit(0) for c in ("a", "b", "words"))
    return F.struct(depth.cast("long").alias("depth"), *(x.cast("long").alias(c) for c, x in (("a", a), ("b", b), ("words", words))))


def _placed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("k", F.row_number().over(Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")))


def own_paths(conversations: DataFrame) -> DataFrame:
    """The conversations as they are: (family, conv_id, depth, a, b, words), with a row of depth 0 for each."""
    turn = F.struct("a", "b", "words")
    rows = F.concat(F.when(F.col("k") == 1, F.array(_row(F.lit(0)))).otherwise(F.array()), F.array(_row(F.col("k"), turn)))
    return _placed(hashed_turns(conversations)).select("family", "conv_id", F.inline(rows))


def borrowed_paths(conversations: DataFrame, heads: int = 4) -> DataFrame:
    """Conversations that begin with the first h turns of their family's first one (conv_id divisible by 20) instead of
    their own first h turns; h = crc32 of the decimal conv_id modulo `heads`. Rows as of own_paths.

    One shuffle by family serves the places, the heads and, later, the sums along the paths."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    turn = F.struct("k", "a", "b", "words")
    lead = F.when((F.col("conv_id") == F.col("family")) & (F.col("k") < heads), turn)
    placed = _placed(hashed_turns(conversations)).withColumn("h", h.cast("int"))
    placed = placed.withColumn("lead", F.array_sort(F.collect_list(lead).over(Window.partitionBy("family"))))
    n = F.least("h", F.size("lead"))
    first = F.concat(F.array(_row(F.lit(0))), F.transform(F.slice("lead", 1, n), lambda t: _row(t["k"], t)))
    rows = F.concat(
        F.when(F.col("k") == 1, first).otherwise(F.array()),
        F.when(F.col("k") > F.col("h"), F.array(_row(n + F.col("k") - F.col("h"), turn))).otherwise(F.array()),
    )
    return placed.select("family", "conv_id", F.inline(rows))


def _sums(paths: DataFrame) -> DataFrame:
    """Adds the prefix (p1, p2), its parent's (q1, q2), the last depth and the words from this depth on."""
    conv = Window.partitionBy("family", "conv_id")
    upto = conv.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = paths.withColumns({"t1": F.xxhash64("depth", "a", "b"), "t2": F.xxhash64("b", "depth", "a")})
    one = one.select(
        "conv_id", "depth", "t1", "t2", "words",
        F.bit_xor("t1").over(upto).alias("p1"), F.bit_xor("t2").over(upto).alias("p2"), F.sum("words").over(upto).alias("before"),
        F.max("depth").over(conv).alias("last"), F.sum("words").over(conv).alias("all"),
    )
    q1, q2 = (F.col(p).bitwiseXOR(F.col(t)) for p, t in (("p1", "t1"), ("p2", "t2")))
    return one.select("conv_id", "depth", "last", "p1", "p2", q1.alias("q1"), q2.alias("q2"), (F.col("all") - F.col("before") + F.col("words")).alias("ahead"))


@task("prefix_trie")
def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks, which come sorted; one block is held at a time."""
    key, digest = None, None
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
            if key == (p1, p2):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (p1, p2), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)] if done else [pa.array([], f.type) for f in schema], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, digest.hexdigest()), schema, strict=True)], schema=schema)


def _ends(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node. Ids meet in blocks of a bounded range of ids, so no
    group is large whatever the number of copies; only finished blocks meet by node, in order, and stream through."""
    blocks = (
        paths.where("depth = last")
        .groupBy(*_NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    )
    with batches_of(paths.sparkSession, 1000):
        return settle(blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block").mapInArrow(_hash_blocks, "p1 long, p2 long, ends_sha256 string"), "trie-ends")


def prefix_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `paths` has the columns of own_paths."""
    paths = settle(_sums(paths), "trie-paths")
    owned = paths.groupBy(*_NODE, "depth").agg(F.min("conv_id").alias("owner"), F.min_by("ahead", "conv_id").alias("ahead"), (F.count("*") == F.count_if(F.col("depth") == F.col("last"))).alias("leaf"))
    suffix = owned.groupBy("owner").agg(F.min("depth").alias("from"), F.min_by("ahead", "depth").alias("owned"), F.max("leaf").alias("leaf"))
    marked = paths.join(suffix, F.col("conv_id") == F.col("owner"), "left")
    above = F.coalesce(F.col("depth") < F.col("from"), F.lit(True))  # nodes of others on this path
    child = F.coalesce(F.col("from") <= F.col("depth") + 1, F.lit(False)) & (F.col("depth") < F.col("last"))
    nodes = settle(
        marked.groupBy(*_NODE, "depth").agg(
            F.min("conv_id").alias("conv_id"),
            F.min_by("from", "conv_id").alias("from"),
            F.first("q1").alias("q1"),
            F.first("q2").alias("q2"),
            F.count("*").alias("n_convs"),
            F.count_if(child).alias("n_children"),
            F.count_if("leaf").alias("n_leaves"),
            F.sum(F.when(above, F.col("ahead") - F.coalesce("owned", F.lit(0))).otherwise(0)).alias("saved_tokens"),
        ),
        "trie-nodes",
    )
    # A node below the first that its owner owns has the same owner's node above it; the first one's parent is looked up.
    top = nodes.where("depth = from AND depth > 1").select(*_NODE, "q1", "q2")
    over = nodes.where("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    found = top.join(over, ["q1", "q2"]).select(*_NODE, "parent")
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root"))
    parent = F.when(F.col("depth") > F.col("from"), F.col("conv_id")).when(F.col("depth") == 1, F.col("root")).otherwise(F.col("parent"))
    full = nodes.join(_ends(paths), [*_NODE], "left").join(found, [*_NODE], "left").crossJoin(F.broadcast(root))  # one row
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
