"""Hash-chained logs and content integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import keyed

BLOCK = 16384


def event_digest(payload: list[str], previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in payload], F.coalesce(previous, F.lit("~"))), 256)


def verify_chain(log: DataFrame, owner: str, sequence: str, digest: Column, stored: str = "event_hash", previous: str = "previous_hash") -> DataFrame:
    """CHN-01: per owner whether every link holds, and the first broken sequence.

    ``digest`` is the rule that made the stored hash (``event_digest`` for the standard logs).
    A link only needs the hash stored one step earlier, so a long log is checked in blocks of
    its position and never gathered by owner.
    """
    placed = keyed.dense_positions(log, [owner], [sequence], F.floor(F.col(sequence).cast("double") / BLOCK))
    linked = keyed.lag_positions(placed, [owner], "position", {"__before": (stored, 1)})
    sound = F.col(previous).eqNullSafe(F.col("__before")) & F.coalesce(F.col(stored) == digest, F.lit(False))
    return linked.groupBy(owner).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(~sound).alias("broken_links"), F.min(F.when(~sound, F.col(sequence))).alias("first_break"),
    ).withColumn("valid", F.col("broken_links") == 0)


def content_integrity(rows: DataFrame, content: str, recorded: str, keys: list[str]) -> DataFrame:
    """CHN-02: recorded digests against recomputed ones."""
    changed = ~F.coalesce(F.sha2(F.col(content).cast("string"), 256) == F.col(recorded), F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("hash_mismatches"))


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """CHN-02: members without their owner."""
    return child.join(parent.select(*on).distinct(), on, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
