"""Conversation prefix trie over padded turn-id matrices.

Conversations with the same turns are combined first, so a hot group of copies is one weighted sequence.
Distinct sequences are range-sorted by the ids of their first turns and cut into blocks of bounded size.  In a
block, sequences are the rows of a matrix of turn ids, padded after their last turn and sorted by ``lexsort``;
where a column differs from the row above, an OR along the row marks that every deeper node starts
anew, and ``reduceat`` over the starts aggregates all nodes of a depth at once.

A node may go on in the next block only if it lies on the path of the block's first or last sequence (or, beyond
EDGE turns, if it shares their first EDGE turns).  Such boundary nodes leave the block as parts; they are few,
are recombined by a digest of their path, and sum up their subtrees by pointer jumping, in as many rounds as the
depth has bits.  All other nodes are complete inside their block.

Cases: rows without a conversation id belong to no conversation; null roles and texts are empty; rows of one
turn go by role, then by text; repeated rows are turns of their own; a rebuilt conversation without turns is a
member of the root alone; an empty table has no nodes, not even a root; further columns of any name are not
read.  Turns are told apart by two 64-bit hashes of role and text.  A text of any length is carried as
these and its length, so a conversation takes some 20 bytes a turn in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored

#: Conversations ``c - c % FAMILY`` lend their first turns, ``crc32(c) % HEADS`` of them.
FAMILY, HEADS = 100, 6
#: Turns that the range sort looks at, and cells of a block's matrix.
EDGE, CELLS = 64, 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of each conversation, turns in order as (lo, hi, size): two hashes and code points."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ties = rows.groupBy("conv_id", "turn").count().filter("count > 1").select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"))
    tie = F.lit(None).cast("string")
    if not ties.isEmpty():  # only tied rows are ordered by their texts, so only they carry them
        rows = rows.join(ties, (F.col("conv_id") == F.col("__c")) & F.col("turn").eqNullSafe(F.col("__t")), "left")
        tie = F.when(F.col("__c").isNotNull(), F.col("text"))
    own = F.struct(
        F.col("turn").isNotNull().alias("has"), "turn", "role", tie.alias("tie"),
        F.xxhash64("role", "text").alias("lo"), F.xxhash64(F.lit(7), "role", "text").alias("hi"), F.length("text").cast("long").alias("size"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi"), t["size"].alias("size"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversations whose first turns are those of the first of their family, then their own turns after as many."""
    first = lists.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, heads - 1).alias("head"))
    size = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = lists.withColumn("__base", F.col("conv_id") - F.col("conv_id") % family).join(first, "__base", "left").withColumn("h", size)
    after = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    before = F.when(F.col("head").isNotNull(), F.slice(F.col("head"), F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(before, after).alias("turns"))


def ending_digests(members: DataFrame) -> DataFrame:
    """(d1, d2, ends): SHA-256 of the ids of equal conversations in order.  Sorted rows are streamed through the
    digest, so a group of any size takes constant memory."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []
        for batch in batches:
            d1, d2, ids = (batch.column(k).to_numpy() for k in range(3))
            edges = [0, *(np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1).tolist(), len(ids)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                joined = ",".join(map(str, ids[start:end].tolist())).encode()
                if (d1[start], d2[start]) == name:
                    digest.update(b"," + joined)
                    continue
                if name is not None:
                    done.append((*name, digest.hexdigest()))
                name, digest = (d1[start], d2[start]), hashlib.sha256(joined)
            if len(done) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if name is not None:
            done.append((*name, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return members.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(hashed, "d1 long, d2 long, ends string")


def sequences(conversations: DataFrame, folder: str) -> DataFrame:
    """Distinct sequences: turns, n (conversations), least (conv_id), ends, and the digest d1, d2."""
    turns = F.col("turns")
    whole = stored(rebuilt(stored(turn_lists(conversations), folder, "turns")).withColumn("d1", F.xxhash64(turns)).withColumn("d2", F.xxhash64(F.lit(7), turns)), folder, "rebuilt")
    alike = whole.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"))
    return alike.join(ending_digests(whole.select("d1", "d2", "conv_id")), ["d1", "d2"])


#: What blocks give: nodes, complete ones (key is null, parent is the key of a boundary node or null) and boundary parts.
NODES = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends_sha256", pa.string()),
])
NODES_DDL = (
    "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
)


def path_keys(lo: np.ndarray, hi: np.ndarray, depth: int) -> list[bytes]:
    """Digests of the paths to the nodes of depth 0 to ``depth`` of one sequence."""
    digest, keys = xxhash.xxh3_128(), []
    keys.append(digest.digest())
    for a, b in zip(lo[:depth].tolist(), hi[:depth].tolist(), strict=True):
        digest.update(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True))
        keys.append(digest.digest())
    return keys


class Block:
    """Distinct sequences as a padded matrix of turn ids, and the nodes they give."""

    def __init__(self, rows: list[tuple], edge: int = EDGE):
        lens = np.array([len(r[0]) for r in rows])
        m, width = len(rows), int(lens.max())
        here = np.arange(width)[None, :] < lens[:, None]
        lo, hi, size = (np.zeros((m, width), np.int64) for _ in range(3))
        for matrix, k in ((lo, 0), (hi, 1), (size, 2)):
            matrix[here] = np.concatenate([r[k] for r in rows])
        alike = lambda row: np.logical_and.accumulate((lo == lo[row]) & here & here[row], axis=1).sum(1)
        touch = np.maximum(alike(0), alike(m - 1))  # leading turns shared with the first or last sequence of the block
        flat = np.lexsort((hi[here], lo[here]))
        a, b = lo[here][flat], hi[here][flat]
        ids = np.empty(len(flat), np.int64)
        ids[flat] = np.cumsum(np.concatenate(([1], (np.diff(a) != 0) | (np.diff(b) != 0)))) if len(flat) else 0
        turn = np.zeros((m, width), np.int64)
        turn[here] = ids
        order = np.lexsort(turn.T[::-1]) if width else np.arange(m)
        self.turn, self.lens, self.here, self.lo, self.hi, self.size, touch = (x[order] for x in (turn, lens, here, lo, hi, size, touch))
        self.n, self.least = np.array([r[3] for r in rows])[order], np.array([r[4] for r in rows])[order]
        self.ends = np.array([r[5] for r in rows], object)[order]
        changed = np.ones((m, width), bool)
        changed[1:] = self.turn[1:] != self.turn[:-1]
        self.new = np.logical_or.accumulate(changed, axis=1)
        self.open_to = np.where(touch >= edge, self.lens, touch)  # nodes of a row up to this depth are boundary nodes
        goes_on = np.zeros(m, bool)  # whether the next sequence starts with this one
        short = self.lens[:-1]
        shared = np.where(short > 0, ~self.new[np.arange(1, m), np.maximum(short - 1, 0)], True) if width else np.zeros(m - 1, bool)
        goes_on[:-1] = shared & (self.lens[1:] > short)
        self.leaf = ~goes_on & (self.open_to < self.lens)  # sequences that end in a complete, childless node

    def nodes(self) -> Iterator[dict]:
        m, width = self.turn.shape
        saved, deeper = np.zeros(m, np.int64), np.zeros(m, np.int64)
        keys: dict[int, list[bytes]] = {}

        def key(row: int, depth: int) -> bytes:
            if row not in keys:
                keys[row] = path_keys(self.lo[row], self.hi[row], int(self.open_to[row]))
            return keys[row][depth]

        for depth in range(width, -1, -1):
            bounds = np.flatnonzero(self.new[:, depth - 1]) if depth else np.zeros(1, np.int64)
            n, least = np.add.reduceat(self.n, bounds), np.minimum.reduceat(self.least, bounds)
            is_node = self.here[bounds, depth - 1] if depth else np.ones(1, bool)
            is_open = self.open_to[bounds] >= depth
            size = self.size[bounds, depth - 1] if depth else np.zeros(1, np.int64)
            complete = is_node & ~is_open
            saved[bounds[complete]] += ((n - 1) * size)[complete]
            sums, leaves, children = (np.add.reduceat(x, bounds) for x in (saved, self.leaf.astype(np.int64), deeper))
            if depth:
                above = np.flatnonzero(self.new[:, depth - 2]) if depth > 1 else np.zeros(1, np.int64)
                parent = above[np.searchsorted(above, bounds, side="right") - 1]
                parent_least = np.minimum.reduceat(self.least, above)[np.searchsorted(above, bounds, side="right") - 1]
                parent_open = self.open_to[parent] >= depth - 1
            for j in np.flatnonzero(is_node).tolist():
                row = int(bounds[j])
                has_open_parent = bool(depth and parent_open[j])
                yield {
                    "key": key(row, depth) if is_open[j] else None,
                    "parent": key(int(parent[j]), depth - 1) if has_open_parent else None,
                    "conv_id": int(least[j]), "depth": depth, "parent_conv_id": int(parent_least[j]) if depth and not has_open_parent else None,
                    "n_convs": int(n[j]), "n_children": int(children[j]), "n_leaves": int(leaves[j]), "saved_tokens": int(sums[j]), "size": int(size[j]),
                    "ends_sha256": self.ends[row] if self.lens[row] == depth else (None if is_open[j] else NOTHING),
                }
            deeper = np.zeros(m, np.int64)
            deeper[bounds[complete]] = 1


def block_nodes(found: DataFrame, cells: int = CELLS, edge: int = EDGE) -> DataFrame:
    """Complete nodes and boundary parts of the range-sorted distinct sequences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, longest = [], 0
        for batch in batches:
            turns, n, least, ends = batch.columns
            for k in range(batch.num_rows):
                own = turns[k].values
                row = (*(own.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi", "size")), n[k].as_py(), least[k].as_py(), ends[k].as_py())
                longest = max(longest, len(row[0]))
                if held and (len(held) + 1) * (longest + 1) > cells:
                    yield held
                    held, longest = [], len(row[0])
                held.append(row)
        if held:
            yield held

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for rows in cut(batches):
            for node in Block(rows, edge).nodes():
                out.append(node)
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_pylist(out, schema=NODES)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=NODES)

    prefix = F.transform(F.slice("turns", 1, edge), lambda t: t["lo"])
    ranged = found.withColumn("__prefix", prefix).repartitionByRange("__prefix", "d1", "d2").sortWithinPartitions("__prefix", "d1", "d2")
    return ranged.select("turns", "n", "least", "ends").mapInArrow(emitted, NODES_DDL)


def recombined(parts: DataFrame, folder: str) -> DataFrame:
    """Boundary nodes from their parts, with the sums of their subtrees: (key, parent, and the columns of a node)."""
    total = lambda c: F.sum(c).alias(c)
    whole = stored(
        parts.groupBy("key").agg(
            F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), total("n_convs"), total("n_children"),
            total("n_leaves"), total("saved_tokens"), F.max("size").alias("size"), F.max("ends_sha256").alias("ends_sha256"),
        ), folder, "boundary",
    )
    inner = whole.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("__more"))
    whole = whole.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("__more", F.lit(0))).drop("__more")
    # What lies in complete nodes is in every part above it already; what boundary nodes bring themselves is summed up here.
    whole = whole.withColumn("__leaves", (F.col("n_children") == 0).cast("long")).withColumn("__saved", (F.col("n_convs") - 1) * F.col("size"))
    whole = stored(whole.withColumn("__up", F.col("parent")), folder, "jump-0")
    deepest = whole.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for turn in range(1, int(deepest).bit_length() + 1):
        brought = whole.filter("__up IS NOT NULL").groupBy(F.col("__up").alias("key")).agg(F.sum("__leaves").alias("__l"), F.sum("__saved").alias("__s"))
        further = whole.select(F.col("key").alias("__up"), F.col("__up").alias("__next"))
        whole = whole.join(brought, "key", "left").join(further, "__up", "left")
        whole = whole.withColumn("__leaves", F.col("__leaves") + F.coalesce("__l", F.lit(0))).withColumn("__saved", F.col("__saved") + F.coalesce("__s", F.lit(0)))
        whole = stored(whole.drop("__up", "__l", "__s").withColumnRenamed("__next", "__up"), folder, f"jump-{turn}")
    whole = whole.withColumn("n_leaves", F.col("n_leaves") + F.col("__leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("__saved"))
    return whole.drop("__up", "__leaves", "__saved").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def trie(conversations: DataFrame, cells: int = CELLS, edge: int = EDGE) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    folder = shared_folder(conversations.sparkSession)
    nodes = stored(block_nodes(stored(sequences(conversations, folder), folder, "sequences"), cells, edge), folder, "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    boundary = recombined(nodes.filter("key IS NOT NULL").drop("parent_conv_id"), folder)
    named = boundary.select(F.col("key").alias("parent"), F.col("conv_id").alias("__above"))
    inside = nodes.filter("key IS NULL")
    below: Column = F.coalesce("parent_conv_id", "__above").alias("parent_conv_id")
    pick = [below if c == "parent_conv_id" else F.col(c) for c in columns]
    first = inside.filter("parent IS NULL").select(*columns)
    return first.unionByName(inside.filter("parent IS NOT NULL").join(named, "parent").select(*pick)).unionByName(
        boundary.join(named, "parent", "left").select(*[F.col("__above").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns])
    )
