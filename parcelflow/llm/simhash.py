"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits.  Table ``v`` (each non-zero vector is
a table) looks at the positions whose vector has an odd product with ``v``.  Two fingerprints that
differ in at most ``radius`` positions agree on all positions of some table, because that many vectors
cannot span the space: no pair within the radius is missed.

Distinct fingerprints, not documents, are linked, so exact copies cost nothing.  A bucket that many
fingerprints share is divided again by the same masks over the positions its table left out; as
distinct fingerprints of one bucket differ in those positions alone, a third division leaves at
most 512.  Buckets of bounded size give one link per member to the least member it reaches, and
components come from alternating stars over the links.

Cases: a text without words has fingerprint zero and is linked like any other; null texts count as
empty; null ids come last when a component is named; repeated rows share their component; an empty
table gives an empty result; very long texts are read whole, their hashes counted in blocks; a bit set in
exactly half of the hashes is 0; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, keyed_text, rows_of, shared_folder, stored

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one bucket that a task compares with one another.
BUCKET = 1024
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the shingles; lower case is for A-Z alone."""
    words = text.lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, last, BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, min(last, start + BLOCK))], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((i, fingerprint(t, shingle)) for i, t in rows_of(batches)), schema)

    return keyed_text(docs, id_column, text_column).mapInArrow(hashed, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over some positions, one per table."""
    tables = (1 << (radius + 1)) - 1
    vectors = [1 + k * tables // max(1, len(positions)) for k in range(len(positions))]
    return [sum(1 << p for p, x in zip(positions, vectors, strict=True) if (x & v).bit_count() % 2) for v in range(1, tables + 1)]


def divisions(radius: int, depth: int) -> list[tuple[int, int, int]]:
    """(parent, table, mask) of the given depth.  A table is numbered along its path; the mask holds the
    positions of the whole path.  There are at most ``(2**(radius + 1) - 1) ** depth`` rows."""
    paths = [(0, 0)]
    rows: list[tuple[int, int, int]] = []
    for _ in range(depth):
        rows = []
        for table, seen in paths:
            free = [p for p in range(BITS) if not seen >> p & 1]
            rows += [(table, (table << (radius + 1)) + v, seen | mask) for v, mask in enumerate(masks(free, radius), 1)]
        paths = [(table, mask) for _, table, mask in rows]
    return rows


def bucketed(rows: DataFrame, radius: int, depth: int) -> DataFrame:
    """Rows (table, fp) under every mask that divides their table further: (table, key, fp)."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(p, t, signed(m)) for p, t, m in divisions(radius, depth)], "table int, __table int, __mask long")
    if depth == 1:  # all rows meet all masks of the first division
        ways = F.array(*[F.struct(F.lit(r["__table"]).alias("t"), F.lit(r["__mask"]).alias("m")) for r in table.collect()])
        return rows.withColumn("w", F.explode(ways)).select(F.col("w.t").alias("table"), F.col("fp").bitwiseAND(F.col("w.m")).alias("key"), "fp")
    return rows.join(F.broadcast(table), "table").select(F.col("__table").alias("table"), F.col("fp").bitwiseAND(F.col("__mask")).alias("key"), "fp").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, near: bool = False) -> DataFrame:
    """(a, b) with a < b: links that connect exactly what pairs within the radius connect; with ``near`` each link is
    itself a pair within the radius."""
    spark, found = nodes.sparkSession, None
    rows = nodes.select(F.lit(0).alias("table"), "fp")
    for depth in (1, 2, 3):
        folder = shared_folder(spark)
        placed = bucketed(rows, radius, depth)
        sizes = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = stored(placed.join(sizes, ["table", "key"]), folder, "shared")
        fits = shared if depth == 3 else shared.filter(F.col("n") <= bucket)
        part = compared(fits.select("table", "key", "fp"), radius, near)
        found = part if found is None else found.unionByName(part)
        rows = shared.filter(F.col("n") > bucket).select("table", "fp").distinct()
        if depth == 3 or rows.isEmpty():
            return found.distinct()
    return found


def compared(rows: DataFrame, radius: int, near: bool = False) -> DataFrame:
    """Stars inside buckets: each fingerprint with the least one that links of the bucket lead to; with ``near``, with the
    one that the search reached it from."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((pair for members in runs(batches) for pair in (tree if near else star)(members, radius)), schema, 1 << 14)

    return rows.repartition("table", "key").sortWithinPartitions("table", "key", "fp").mapInArrow(stars, "a long, b long")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of each (table, key) run of sorted rows."""
    held, name = [], None
    for batch in batches:
        table, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(fp):
            continue
        edges = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
        for part, at in zip(np.split(fp, edges), [0, *edges], strict=True):
            if (table[at], key[at]) != name:
                if held:
                    yield np.concatenate(held)
                held, name = [], (table[at], key[at])
            held.append(part)
    if held:
        yield np.concatenate(held)


def star(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Breadth-first over one bucket: (least member, other member) of each connected part."""
    left = members.view(np.uint64)
    while len(left) > 1:
        reached, todo, left = [left[:1]], left[:1], left[1:]
        while len(todo) and len(left):
            near = np.zeros(len(left), bool)
            for fp in todo:
                near |= np.bitwise_count(left ^ fp) <= radius
            todo, left = left[near], left[~near]
            reached.append(todo)
        whole = np.concatenate(reached).view(np.int64)
        least = int(whole.min())
        yield from ((least, int(x)) for x in whole if x != least)


def tree(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Breadth-first over one bucket: pairs within the radius that connect what ``star`` connects."""
    left = members.view(np.uint64)
    while len(left) > 1:
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            found = np.zeros(len(left), bool)
            for fp in todo:
                fresh = ~found & (np.bitwise_count(left ^ fp) <= radius)
                found |= fresh
                own = int(fp.view(np.int64))
                yield from ((min(own, x), max(own, x)) for x in left[fresh].view(np.int64).tolist())
            todo, left = left[found], left[~found]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars; ends when the links no longer
    change.  Degrees are met by partial minima and joins that Spark may split."""
    folder, turn, before = shared_folder(edges.sparkSession), 0, None
    edges = stored(edges, folder, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y")
        turn += 1
        edges = stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), folder, f"turn-{turn}")
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links lead to)."""
    folder = shared_folder(docs.sparkSession)
    rows = stored(fingerprints(docs, shingle, id_column, text_column), folder, "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "nodes")
    by_fp = led(nodes, radius, bucket).select("fp", F.col("first").alias("component_id"))
    return rows.join(by_fp, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def led(nodes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Adds to (fp, least) the least of its whole component, ``first``."""
    roots = components(links(nodes, radius, bucket))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")


def representatives(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, text_hash (xxhash64, a null text as empty) and kept of each row.  Kept is one document, an id
    and a text, of each component: the smallest id, null ids last, then the smallest hash."""
    folder = shared_folder(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((i, h, fingerprint(t, shingle)) for b in batches for (i, t), h in zip(rows_of([b]), b.column(2).to_pylist(), strict=True)), schema)

    texts = keyed_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    rows = stored(texts.mapInArrow(hashed, "doc_id long, text_hash long, fp long"), folder, "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(rows.groupBy("fp").agg(F.min(own).alias("least")), folder, "nodes")
    return rows.join(led(nodes, radius, bucket), "fp").select("doc_id", "text_hash", own.eqNullSafe(F.col("first")).alias("kept"))
