"""Sharding by sampled splitters.

Every row gets a 64-bit sort key: the high bits come from the hash of its text, so equal texts
lie side by side, the low bits from the hash of its id, so even one text that fills a third of
the corpus can be cut.  A size-weighted sample of keys gives quantile boundaries, rows are
range-partitioned by them, ranges that hold too much are cut again from a sample of their own,
and shards are consecutive ranges cut at equal shares of the bytes.

Cases: a null or empty text has size 1; null ids sort first within a key; an empty table gives
an empty result; rows that agree in id and text are interchangeable and lie side by side; equal texts under different ids lie
side by side as well, and a group of them that straddles a cut goes to two shards, however small it is; a
very long text is one row of its size and may fill a shard alone; further columns of any name are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, unit_hash

ID_BITS = 24
#: Keys drawn per range; the driver holds this many keys per range and one number per range.
SAMPLES_PER_RANGE = 32
RANGE_ROWS = 250_000
ROUNDS = 6


def sort_key(text: Column, identity: Column) -> Column:
    """High bits of the text's hash, low bits of the id's hash."""
    low = (1 << ID_BITS) - 1
    return F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.lit(7), identity).bitwiseAND(F.lit(low)))


def draw_splitters(rows: DataFrame, weight: Column, ranges: int, seed: int) -> np.ndarray:
    """Quantile boundaries of a weighted key sample.  ``weight`` sums to 1 over ``rows``; a row is
    drawn with probability ``draws * weight``, so at most twice ``draws`` keys are expected."""
    draws = ranges * SAMPLES_PER_RANGE
    share = weight * draws
    sample = (
        rows.withColumn("__share", share)
        .filter(unit_hash("key", "doc_id", seed=seed) < F.col("__share"))
        .select("key", F.greatest(F.lit(1.0), F.col("__share")).alias("w")).toPandas().sort_values("key")
    )
    if sample.empty:
        return np.empty(0, np.int64)
    reached = sample["w"].cumsum().to_numpy()
    at = np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["key"].to_numpy()[at])


def ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Add ``range``: the number of splitters at or below the key."""
    cuts = np.array(splitters, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    return rows.withColumn("range", place("key"))


def split_ranges(rows: DataFrame, n_rows: int, n_bytes: int, ranges: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Splitters under which no range that more than one key makes up holds over twice its share,
    and the rows and bytes of each range."""
    weight = (F.col("size") / n_bytes + F.lit(1.0) / n_rows) / 2
    splitters = draw_splitters(rows, weight, ranges, seed=1)
    for turn in range(ROUNDS):
        sizes = (
            ranged(rows, splitters).groupBy("range")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
            .toPandas().sort_values("range", ignore_index=True)
        )
        share = (sizes["bytes"] / n_bytes + sizes["rows"] / n_rows) / 2
        full = sizes[(share > 2 / ranges) & (sizes["low"] < sizes["high"])]
        if full.empty or turn == ROUNDS - 1:
            break
        inside = ranged(rows, splitters).filter(F.col("range").isin(full["range"].tolist()))
        total = float(share[full.index].sum())
        finer = draw_splitters(inside, weight / total, 4 * int(np.ceil(total * ranges)) + 1, seed=2 + turn)
        splitters = np.unique(np.concatenate([splitters, finer]))
    return splitters, sizes


def shard(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Shards of near equal bytes (no further apart than the rows at their ends), and a gapless slot
    within each shard.  Returns doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    identity = F.col(id_column).cast("long")
    rows = stored(
        docs.select(
            identity.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(text, identity).alias("key"),
        ),
        shared_folder(spark), "keys",
    )
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters, offsets = np.empty(0, np.int64), pd.DataFrame({"range": [0], "rows": [0], "bytes": [0]})
    if n_rows:
        splitters, offsets = split_ranges(rows, n_rows, n_bytes, max(16 * shards, -(-n_rows // range_rows)))
    before = offsets[["range"]].astype("int32").assign(
        rows_before=offsets["rows"].cumsum() - offsets["rows"], bytes_before=offsets["bytes"].cumsum() - offsets["bytes"]
    )
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged(rows, splitters)
        .withColumns({"__row": F.count(F.lit(1)).over(inside), "__bytes": F.sum("size").over(inside)})
        .join(spark.createDataFrame(before, "range int, rows_before long, bytes_before long"), "range")
        .withColumns({
            "__at": F.col("rows_before") + F.col("__row") - 1,
            "__middle": 2 * (F.col("bytes_before") + F.col("__bytes")) - F.col("size"),
        })
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("__middle") * shards / F.lit(2.0 * max(n_bytes, 1)))).cast("int"))
    )
    placed = stored(placed.select("doc_id", "size", "text_crc32", "shard", "__at"), shared_folder(spark), "placed")
    first = placed.groupBy("shard").agg(F.min("__at").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__at") - F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
