"""Exact dedup with an extendible-hash index on shared files, in DataFrame operations only.

The key of a text is the 64-bit hash of its normalised form.  A bucket holds the keys that start with
its prefix of ``depth`` bits.  A bucket with more distinct keys than the capacity is split by one more
bit, and the directory, which has a slot for every prefix as long as the deepest bucket's, doubles
when a split needs another bit.  Buckets are Parquet folders below a shared path; the directory
names the generation that holds a bucket's files, so an insertion rewrites only buckets it touches.

Tasks own ranges of keys.  Within a key, texts are chained: equal bytes share an entry, different
bytes under one key get entries of their own.  Copies are combined before the shuffle, so a text
that fills a third of the corpus reaches its owner once per input task.

Cases: null texts count as empty, and all empty texts are copies; a null id comes after all others when
the row that stays is chosen; rows repeated with one id are copies, all marked kept if their id stays;
an empty table gives an empty result; texts of any length are compared whole; ties in the id go to one row
for all equal rows; further columns of any name are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, shared_folder, stored

#: Distinct keys a bucket may hold; leading bits the directory may use (2**16 slots, under 1 MB).
CAPACITY = 100_000
MOST_BITS = 16


def normalised(text: Column) -> Column:
    """Each run of white space as one space; texts without any such run are left alone."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(whole.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(whole, SPACE + "++", " ")).otherwise(whole)


def leading(key: Column) -> Column:
    """The first MOST_BITS bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - MOST_BITS).cast("int")


@dataclass
class Index:
    """An extendible-hash index below ``path``.  ``buckets``: (depth, prefix) to generation."""

    spark: SparkSession
    path: str
    capacity: int = CAPACITY
    buckets: dict[tuple[int, int], int] = field(default_factory=lambda: {(0, 0): 0})
    generation: int = 0

    @property
    def depth(self) -> int:
        return max(depth for depth, _ in self.buckets)

    def slots(self) -> list[tuple[int, int, int]]:
        """(first, last, bucket) of MOST_BITS-bit prefixes; a bucket is named by its first slot."""
        spans = ((prefix << (MOST_BITS - depth), (prefix + 1) << (MOST_BITS - depth)) for depth, prefix in self.buckets)
        return sorted((low, high - 1, low) for low, high in spans)

    def routed(self, rows: DataFrame) -> DataFrame:
        """Adds ``bucket``: a join with one row per slot of the directory, whose size is bounded."""
        low, bits = MOST_BITS - self.depth, self.depth
        table = [(slot, bucket) for first, last, bucket in self.slots() for slot in range(first >> low, (last >> low) + 1)]
        directory = self.spark.createDataFrame(table, "__slot int, bucket int")
        slot = F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int") if bits else F.lit(0)
        return rows.withColumn("__slot", slot).join(F.broadcast(directory), "__slot").drop("__slot")

    def entries(self, buckets: list[tuple[int, int]] | None = None) -> DataFrame | None:
        """The chain entries of some buckets, or of all: key, text_sha256, n_bytes, keep_id, group_size."""
        wanted: dict[int, list[int]] = {}
        for depth, prefix in buckets if buckets is not None else self.buckets:
            if self.buckets[depth, prefix]:
                wanted.setdefault(self.buckets[depth, prefix], []).append(prefix << (MOST_BITS - depth))
        found = None
        for generation, names in sorted(wanted.items()):
            part = self.spark.read.schema("key long, text_sha256 string, n_bytes long, keep_id long, group_size long, bucket int").parquet(
                f"{self.path}/generation-{generation}"
            ).filter(F.col("bucket").isin(names)).drop("bucket")
            found = part if found is None else found.unionByName(part)
        return found

    def insert(self, chained: DataFrame) -> None:
        """Add chain entries (columns of ``entries``), then split what is overfull."""
        counts = {r["p"]: r["n"] for r in chained.groupBy(leading(F.col("key")).alias("p")).agg(F.count_distinct("key").alias("n")).collect()}
        lows = sorted((prefix << (MOST_BITS - depth), (depth, prefix)) for depth, prefix in self.buckets)
        firsts = [low for low, _ in lows]
        touched = sorted({lows[bisect_right(firsts, p) - 1][1] for p in counts} or {lows[0][1]})
        held = self.entries(touched)
        if held is not None:
            chained = stored(
                chained.unionByName(held).groupBy("key", "text_sha256", "n_bytes").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
                self.path, f"merged-{self.generation + 1}",
            )
            counts = {r["p"]: r["n"] for r in chained.groupBy(leading(F.col("key")).alias("p")).agg(F.count_distinct("key").alias("n")).collect()}
        self.generation += 1
        for bucket in touched:
            del self.buckets[bucket]
            self.split(bucket, counts)
        self.routed(chained).repartitionByRange("key").write.partitionBy("bucket").parquet(f"{self.path}/generation-{self.generation}")

    def split(self, bucket: tuple[int, int], counts: dict[int, int]) -> None:
        """Split a bucket, one bit at a time, until each part is within the capacity."""
        depth, prefix = bucket
        width = MOST_BITS - depth
        inside = {p: n for p, n in counts.items() if p >> width == prefix}
        if sum(inside.values()) <= self.capacity or depth == MOST_BITS:
            self.buckets[bucket] = self.generation
            return
        for bit in (0, 1):
            self.split((depth + 1, 2 * prefix + bit), inside)


def chains(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One entry per distinct normalised text: grouping by key and text compares bytes wherever keys agree."""
    text = docs.select(F.col(id_column).cast("long").alias("id"), normalised(F.col(text_column)).alias("norm"))
    grouped = text.groupBy(F.xxhash64("norm").alias("key"), "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select("key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size")


def build(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> Index:
    index = Index(docs.sparkSession, shared_folder(docs.sparkSession), capacity)
    index.insert(stored(chains(docs, id_column, text_column), index.path, "chained"))
    return index


def dedup(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key, bucket: one row per row of ``docs``."""
    index = build(docs, capacity, id_column, text_column)
    entries = index.entries().select("key", "text_sha256", "keep_id", "group_size")
    norm = normalised(F.col(text_column))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"))
    return index.routed(rows.join(entries, ["key", "text_sha256"])).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key", "bucket"
    )
