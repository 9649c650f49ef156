"""Trie of conversations by their first turns, with totals of every subtree by leaf-peeling message passing.

A node is a distinct sequence of turns, known by 128 bits of hashes of its turns and their places. Its smallest member names it:
the nodes of one smallest member lie on one path, and a path hangs on a node of another path with a smaller member.
So (smallest member, depth) is a key of nodes, and paths are the units that pass messages. Every path holds a counter of
the paths that hang on it and haven't reported; a path whose counter is 0 is complete and sends the totals of its
subtree to the path it hangs on; rounds go on until only the root's path is left and finishes. There are as many rounds as paths
hang on each other at most, not as many as a conversation has turns. Totals of single nodes are running sums of the messages along
each path, from its end upwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import lasting, scope, written

GROUP, LONGEST = 5, 9  # conversations that begin with the first one's turns; remainders of how many turns
SEGMENT = 1 << 16  # ids that a task joins before it sends them on
ID = ["depth", "a", "b"]


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, h1, h2, bytes) of every turn of the rebuilt conversations; (conv, n_turns) of every one of them.

    conversations have conv_id, turn, role, text. Turns come by number, null first, then by role and text; null role and
    text are empty. Conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own after
    its first h, h being crc32 of c's decimal digits modulo 9. Rows without conv_id take no part.
    """
    src = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv is not null")
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    keep = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text"), "bytes": F.octet_length("text").cast("long")}
    turns = written(running(src, "conv", order, {"r": ("sum", F.lit(1).cast("long"))}, keep, written))
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"base": F.col("conv") - F.col("conv") % GROUP, "h": F.crc32(F.col("conv").cast("string")) % LONGEST})
    own = written(own)
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    first = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = written(own.join(bases, "base", "left").select("conv", "base", "h", first.alias("first"), (first + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    begin = turns.where(F.col("r") < LONGEST).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base").where("r <= h")
    rest = turns.join(convs.select("conv", "h", "first"), "conv").where("r > h").withColumn("r", F.col("first") + F.col("r") - F.col("h"))
    cols = ["conv", F.col("r").alias("depth"), "h1", "h2", "bytes"]
    return begin.select(*cols).unionByName(rest.select(*cols)), convs.select("conv", "n_turns")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and id: the ids of each node joined, some at a time, with the first of them."""
    node, first, held, rows = None, None, [], []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 4, pa.string()))], [*ID, "first", "ids"])

    for batch in batches:
        for *here, conv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held and (here != node or len(held) == SEGMENT):
                rows.append((*node, first, ",".join(held)))
                held = []
            if not held:
                node, first = here, conv
            held.append(str(conv))
        if len(rows) >= 1024:
            yield out(rows)
            rows = []
    if held:
        rows.append((*node, first, ",".join(held)))
    yield out(rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of joined ids sorted by node and first id: the digest of each node's, fed piece by piece."""
    node, digest, rows = None, None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 3, pa.string()))], [*ID, "ends_sha256"])

    for batch in batches:
        for *here, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if here == node:
                digest.update(b",")
            else:
                if digest:
                    rows.append((*node, digest.hexdigest()))
                node, digest = here, hashlib.sha256()
            digest.update(ids.encode())
        if len(rows) >= 1024:
            yield out(rows)
            rows = []
    if digest:
        rows.append((*node, digest.hexdigest()))
    yield out(rows)


def _ends(ends: DataFrame) -> DataFrame:
    """Node and digest of the ids of conversations that end there. A digest is one chain, so a node's ids pass through one
    task in the end, but joined beforehand and never held together."""
    order = [*ID, "conv"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, a long, b long, first long, ids string")
    return joined.repartition(*ID).sortWithinPartitions(*ID, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def _peeled(paths: DataFrame) -> DataFrame:
    """conv, depth, leaves, saved: the messages of all paths, to the node that the sender hangs on.

    paths have conv, parent_conv, at (depth of that node), remaining, leaves, saved. Every round is a written table.
    """
    sent, state = [], written(paths)
    while not state.isEmpty():
        complete = state.where("remaining = 0 and parent_conv is not null").select(F.col("parent_conv").alias("conv"), F.col("at").alias("depth"), "leaves", "saved")
        sent.append(complete)
        sums = complete.groupBy("conv").agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"), F.count("*").alias("__done"))
        got = lambda c: F.coalesce(c, F.lit(0))
        state = written(state.where("remaining > 0").join(sums, "conv", "left").select("conv", "parent_conv", "at", (F.col("remaining") - got("__done")).alias("remaining"), (F.col("leaves") + got("__leaves")).alias("leaves"), (F.col("saved") + got("__saved")).alias("saved")))
    out = paths.select("conv", F.lit(0).cast("long").alias("depth"), "leaves", "saved").limit(0)
    for m in sent:
        out = out.unionByName(m)
    return out.groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations have conv_id, turn, role, text and are rebuilt as rebuilt_turns says; other columns are ignored, a
    repeated row is a turn of its own, rows without conv_id take no part, and an empty table has no nodes, not even a
    root. saved_tokens counts UTF-8 bytes of a node's last text once for each member but the first.
    """
    with scope(conversations.sparkSession):
        return lasting(_trie(*rebuilt_turns(conversations)))


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    place = lambda *first: F.xxhash64(*first, "depth", "h1", "h2")
    k = {"k1": place(), "k2": place(F.lit(1)), "depth": F.col("depth"), "bytes": F.col("bytes")}
    whole = running(turns, "conv", [F.col("depth")], {"a": ("xor", k["k1"]), "b": ("xor", k["k2"])}, k, written)
    none = F.lit(0).cast("long")
    roots = convs.select("conv", *[none.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "bytes")])
    placed = written(whole.select("conv", *ID, F.col("a").bitwiseXOR(F.col("k1")).alias("up_a"), F.col("b").bitwiseXOR(F.col("k2")).alias("up_b"), "bytes").unionByName(roots))
    nodes = written(placed.groupBy(*ID).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("bytes").alias("bytes")))
    ends = placed.join(convs.select("conv", F.col("n_turns").alias("depth")), ["conv", "depth"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent_conv"))
    tied = nodes.join(parents, ["depth", "up_a", "up_b"], "left").join(_ends(ends), ID, "left")
    tied = written(tied.select("conv", "depth", "parent_conv", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))

    children = tied.where("parent_conv is not null").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    full = written(tied.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    tops = full.where("parent_conv is null or parent_conv <> conv").select("conv", "parent_conv", (F.col("depth") - 1).alias("at"))
    own = full.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hanging = tops.where("parent_conv is not null").groupBy(F.col("parent_conv").alias("conv")).agg(F.count("*").alias("remaining"))
    paths = tops.join(own, "conv").join(hanging, "conv", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    messages = _peeled(paths.select("conv", "parent_conv", "at", "remaining", "leaves", "saved")).select("conv", "depth", F.col("leaves").alias("__leaves"), F.col("saved").alias("__saved"))

    got = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
    totals = {"n_leaves": ("sum", got("leaves", "__leaves")), "saved_tokens": ("sum", got("saved", "__saved"))}
    keep = {c: F.col(c) for c in ("depth", "parent_conv", "n_convs", "n_children", "ends_sha256")}
    out = running(full.join(messages, ["conv", "depth"], "left"), "conv", [F.desc("depth")], totals, keep, written)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
