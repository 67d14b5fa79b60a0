"""Prefix trie of conversations by adaptive radix trees.

Every distinct turn (role, text) gets a number, written as 8 big-endian bytes; a
conversation is the concatenation of its turns' numbers. Conversations with equal
keys are counted together first, so copies of one conversation are one key.

The distinct keys are range-partitioned and sorted. Each task puts its keys into an
adaptive radix tree: inner nodes hold 4, 16, 48 or 256 children and grow from one
layout to the next; a chain of single children is kept as the prefix of the node
below it. Only byte depths at a turn boundary stand for trie nodes: a walk over
the tree emits, per such depth, the node's members, children, leaves and token
sums within the task.

A trie node whose members lie in several tasks is emitted by each of them. Spark
adds the partial rows of a node; what they count twice (the node as a child of
its parent, its own text length in the sums above it, the node as a leaf where a
task saw no child) is taken away again from the few nodes that span tasks, for
them and every node above them.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import stored

#: Bytes of a turn number.
WIDTH = 8
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class ArtNode:
    """An inner or end node: a compressed prefix, children by next byte, maybe a key's value."""

    __slots__ = ("prefix", "capacity", "keys", "slots", "kids", "value")

    def __init__(self, prefix: bytes = b""):
        self.prefix = prefix
        self.capacity = 4
        self.keys = bytearray()  # layouts 4 and 16: sorted bytes beside kids
        self.slots: bytearray | None = None  # layout 48: byte -> place in kids + 1
        self.kids: list = []
        self.value = None

    def find(self, byte: int):
        if self.capacity <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.capacity == 48:
            at = self.slots[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, child: ArtNode) -> None:
        if self.capacity <= 16 and len(self.keys) == self.capacity or self.capacity == 48 and len(self.kids) == 48:
            self._grow()
        if self.capacity <= 16:
            at = 0
            while at < len(self.keys) and self.keys[at] < byte:
                at += 1
            self.keys.insert(at, byte)
            self.kids.insert(at, child)
        elif self.capacity == 48:
            self.kids.append(child)
            self.slots[byte] = len(self.kids)
        else:
            self.kids[byte] = child

    def _grow(self) -> None:
        if self.capacity == 4:
            self.capacity = 16
        elif self.capacity == 16:
            self.capacity, self.slots = 48, bytearray(256)
            for at, byte in enumerate(self.keys):
                self.slots[byte] = at + 1
            self.keys = bytearray()
        else:
            direct = [None] * 256
            for byte in range(256):
                if self.slots[byte]:
                    direct[byte] = self.kids[self.slots[byte] - 1]
            self.capacity, self.slots, self.kids = 256, None, direct

    def children(self) -> list[ArtNode]:
        return [k for k in self.kids if k is not None]

    def moved_below(self, cut: int) -> None:
        """Splits the prefix at ``cut``: this node keeps the head, a new child the rest."""
        lower = ArtNode(self.prefix[cut + 1 :])
        lower.capacity, lower.keys, lower.slots, lower.kids, lower.value = (
            self.capacity, self.keys, self.slots, self.kids, self.value,
        )
        byte = self.prefix[cut]
        self.prefix, self.capacity, self.keys, self.slots, self.kids, self.value = (
            self.prefix[:cut], 4, bytearray(), None, [], None,
        )
        self.add(byte, lower)


def insert(root: ArtNode, key: bytes, value) -> None:
    """Puts a key into the tree; the root's prefix stays empty."""
    node, depth = root, 0
    while True:
        prefix = node.prefix
        same = 0
        limit = min(len(prefix), len(key) - depth)
        while same < limit and prefix[same] == key[depth + same]:
            same += 1
        if same < len(prefix):
            node.moved_below(same)
        depth += same
        if depth == len(key):
            node.value = value
            return
        child = node.find(key[depth])
        if child is None:
            leaf = ArtNode(key[depth + 1 :])
            leaf.value = value
            node.add(key[depth], leaf)
            return
        node, depth = child, depth + 1


def trie_nodes(keys: list[tuple[bytes, int, int, list[int]]], width: int = WIDTH) -> list[tuple]:
    """Trie nodes of the keys of one task, with sums over the task's keys only.

    ``keys``: (key, conversations with this key, their smallest id, code points of
    each turn's text). Rows: (prefix, depth, n_convs, min_conv, n_children, n_leaves,
    sum of n_convs times last length in the subtree, sum of last lengths in the
    subtree, 1 if a leaf, last length).
    """
    root = ArtNode()
    for key, n, least, lengths in keys:
        insert(root, key, (n, least, lengths, key))
    out: list[tuple] = []
    deepest = max((len(k[0]) for k in keys), default=0)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * deepest + 1000))

    def visit(node: ArtNode, entry: int) -> list[tuple]:
        end = entry + 1 + len(node.prefix)
        below: list[tuple] = []
        for child in node.children():
            below.extend(visit(child, end))
        first = 0 if entry < 0 else (entry // width + 1) * width
        if first > end:
            return below
        n = sum(b[0] for b in below)
        least = min((b[1] for b in below), default=None)
        sample = below[0][5] if below else None
        if node.value is not None:
            n += node.value[0]
            least = node.value[1] if least is None else min(least, node.value[1])
            sample = node.value
        leaves = sum(b[2] for b in below) or 1
        weighted = sum(b[3] for b in below)
        lengths = sum(b[4] for b in below)
        children = len(below)
        for depth in range(end - (end - first) % width, first - 1, -width):
            last = sample[2][depth // width - 1] if depth else 0
            weighted += n * last
            lengths += last
            out.append(
                (sample[3][:depth], depth // width, n, least, children, leaves, weighted, lengths,
                 int(children == 0), last)
            )
            children = 1
        return [(n, least, leaves, weighted, lengths, sample)]

    if keys:
        visit(root, -1)
    return out


PARTIAL = (
    "prefix binary, depth long, n_convs long, min_conv long, n_children long, n_leaves long, "
    "weighted long, lengths long, leaf long, last_len long"
)


def _art(batches):
    keys = []
    for batch in batches:
        keys.extend(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
    rows = trie_nodes(keys)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 10
    types = [pa.binary()] + [pa.int64()] * 9
    names = [f.split()[0] for f in PARTIAL.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _ends(batches):
    """SHA-256 of each key's conversation ids, ascending, joined by commas; rows sorted by key, id."""
    key, digest, first = None, None, True
    out_keys, out_sha = [], []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    out_keys.append(key)
                    out_sha.append(digest.hexdigest())
                key, digest, first = k, hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(c).encode())
            first = False
        if len(out_keys) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_sha)], ["key", "ends_sha256"])
            out_keys, out_sha = [], []
    if digest is not None:
        out_keys.append(key)
        out_sha.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_sha)], ["key", "ends_sha256"])


def rebuilt_keys(conversations: DataFrame) -> DataFrame:
    """Per conversation id: its rebuilt key and the code points of each rebuilt turn's text.

    Turns are ordered by turn (null first), then role and text; null role or text is
    empty. Conversation c takes the first h turns of c - c % 100 (all if fewer, none
    if absent), then its own turns after its first h; h = crc32(decimal c) % 6.
    Rows with a null conv_id belong to no conversation.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(order) - 1)
    # Numbers of distinct turns, written so that a task that runs again finds the same ones.
    numbered = stored(
        turns.select("role", "text").distinct().withColumn("tid", F.monotonically_increasing_id()), "turn-ids"
    )
    turns = turns.join(numbered, ["role", "text"]).select(
        "conv_id", "pos", "tid", F.length("text").cast("long").alias("chars")
    )
    convs = (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id")
        .distinct()
        .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    )
    head = (
        convs.join(turns.withColumnRenamed("conv_id", "base"), "base")
        .where(F.col("pos") < F.col("h"))
        .select("conv_id", F.lit(0).alias("part"), "pos", "tid", "chars")
    )
    tail = (
        turns.join(convs.select("conv_id", "h"), "conv_id")
        .where(F.col("pos") >= F.col("h"))
        .select("conv_id", F.lit(1).alias("part"), "pos", "tid", "chars")
    )
    listed = (
        head.unionByName(tail)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "pos", "tid", "chars"))).alias("t"))
    )
    hexed = F.concat_ws("", F.transform("t", lambda x: F.lpad(F.hex(x["tid"]), 2 * WIDTH, "0")))
    return convs.select("conv_id").join(listed, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.unhex(hexed), F.lit(bytearray())).alias("key"),
        F.coalesce(F.transform("t", lambda x: x["chars"]), F.array().cast("array<bigint>")).alias("lengths"),
    )


def conversation_trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """All nodes of the prefix trie of rebuilt conversations.

    Columns, all long but the digest: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs`` (members; every rebuilt
    conversation, turnless ones too, belongs to the root), ``n_children``, ``n_leaves``
    (childless nodes in the subtree, itself included), ``saved_tokens`` (over the
    subtree, (n_convs - 1) times the code points of the node's last text; the root's
    is 0), ``ends_sha256`` (SHA-256 of the ids of members with exactly ``depth`` turns,
    ascending, joined by commas; of '' if none). Repeated rows are repeated turns.
    An empty table or one without conv_id gives no node. Other columns are ignored.
    """
    spark = conversations.sparkSession
    keys = stored(rebuilt_keys(conversations), "conversation-keys")
    distinct = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("lengths").alias("lengths")
    )
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = (
        distinct.repartitionByRange(parts, "key")
        .sortWithinPartitions("key")
        .select("key", "n", "least", "lengths")
        .mapInArrow(_art, PARTIAL)
    )
    merged = partial.groupBy("prefix").agg(
        F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.min("min_conv").alias("conv_id"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("weighted").alias("weighted"),
        F.sum("lengths").alias("lengths"),
        F.sum("leaf").alias("leaf"),
        F.count(F.lit(1)).alias("tasks"),
        F.first("last_len").alias("last_len"),
    )
    merged = stored(merged, "trie-nodes")
    # Nodes seen by several tasks, and what they counted too often above them.
    spanning = merged.where(F.col("tasks") > 1).select(
        "prefix", "depth", "leaf", (F.col("tasks") - 1).alias("extra"), "last_len"
    )
    above = spanning.select(
        F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("up"), "prefix", "depth", "leaf", "extra", "last_len"
    ).select(
        F.expr(f"substring(prefix, 1, {WIDTH} * up)").alias("prefix"),
        "leaf",
        (F.col("extra") * F.col("last_len")).alias("extra_len"),
        F.when(F.col("up") == F.col("depth") - 1, F.col("extra")).otherwise(0).alias("extra_child"),
    )
    fixes = above.groupBy("prefix").agg(
        F.sum("leaf").alias("fix_leaves"), F.sum("extra_len").alias("fix_len"), F.sum("extra_child").alias("fix_kids")
    )
    nodes = merged.join(fixes, "prefix", "left").select(
        "prefix",
        "depth",
        "conv_id",
        "n_convs",
        (F.col("n_children") - F.coalesce("fix_kids", F.lit(0))).alias("n_children"),
        (F.col("n_leaves") - F.coalesce("fix_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("weighted") - F.col("lengths") + F.coalesce("fix_len", F.lit(0))).alias("saved_tokens"),
    )
    parents = nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = (
        keys.select("key", "conv_id")
        .repartition("key")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_ends, "key binary, ends_sha256 string")
    )
    linked = nodes.withColumn(
        "parent", F.when(F.col("depth") > 0, F.expr(f"substring(prefix, 1, {WIDTH} * (depth - 1))"))
    ).join(parents, "parent", "left")
    return linked.join(ends, linked["prefix"] == ends["key"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
