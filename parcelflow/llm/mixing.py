"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a fixed shuffled order and are offered up to ``repeats`` times.
Each offer has a virtual finish time: the tokens of its source up to and including it, divided by
the source's target.  Offers are range-sorted by finish time over all sources and cut where their
tokens reach the total budget.  Every source therefore advances at the rate of its target.

The running sum of one source is split into chunks of the shuffled order, and the cut is found
from sums of range partitions, so no source and no sort order is held by one task.

Documents whose ids are null or repeated are shuffled by their text as well, so that no chunk holds them all.

Cases: null or empty texts have size 0 and are never taken; a null source is a source of its own,
last; an empty table gives an empty result; repeated rows are offered each for itself; equal finish times
go by source, place in the shuffled order and id, and rows equal in these are taken together; very long
texts are counted whole; further columns of any name are not read, but for those asked for by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, shared_folder, stored, unit_hash

WEIGHTS = (1, 2, 3)
REPEATS = 3
CHUNK_ROWS = 5_000
SEED = 42


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^") + "++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: int, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``rank`` and ``target`` to one row per source (``source``, ``source_size``).

    A target is ``level * weight`` or, where that is lower, ``repeats`` times the source's size; the
    level that makes all targets add up to the budget follows from sums over the sources in the order
    in which they reach their ceiling.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("__w", cycle[F.col("rank") % len(weights)])
    ceiling = F.col("source_size") * float(repeats)
    ranked = ranked.withColumn("__fills", ceiling / F.col("__w"))
    earlier = Window.orderBy("__fills", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(budget)) - F.coalesce(F.sum(ceiling).over(earlier), F.lit(0.0))
    sharing = F.sum("__w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(
        F.sum("__w").over(earlier), F.lit(0.0)
    )
    level = ranked.withColumn("__level", left / sharing)
    found = level.agg(F.max(F.when(F.col("__level") <= F.col("__fills"), F.col("__level"))).alias("__top"))
    top = found.first()["__top"]
    level = F.lit(float(top) if top is not None else 0.0)
    return ranked.select("source", "source_size", F.col("rank").cast("int").alias("rank"), F.least(ceiling, level * F.col("__w")).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...], repeats: int, chunk_rows: int, seed: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Documents with size, source_size, target, rank and ``cumulative``, the tokens of their source up to
    and including them in shuffled order; and the budget."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"),
            unit_hash("doc_id", F.xxhash64(F.col("text").cast("string")), seed=seed).alias("__u"), *keep,
        ),
        folder, "sized",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    n_rows, budget = per_source.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    wanted = stored(targets(per_source.drop("__n"), budget, weights, repeats), folder, "targets")
    chunks = max(1, -(-n_rows // chunk_rows))
    chunked = (
        sized.join(wanted.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        .withColumn("__chunk", F.floor(F.col("__u") * chunks).cast("int"))
    )
    inside = Window.partitionBy("rank", "__chunk").orderBy("__u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = chunked.groupBy("rank", "__chunk").agg(F.sum("size").alias("__sum")).withColumn(
        "__before", F.coalesce(F.sum("__sum").over(Window.partitionBy("rank").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("__sum")
    out = chunked.withColumn("__in", F.sum("size").over(inside)).join(before, ["rank", "__chunk"])
    out = out.withColumn("cumulative", F.col("__before") + F.col("__in")).drop("__before", "__in", "__chunk")
    return stored(out, folder, "queue"), budget


def offer(turn: int) -> Column:
    """(virtual finish time, rank, place in the shuffled order, doc_id) of the document's offer number ``turn``."""
    finish = (F.lit(turn) * F.col("source_size") + F.col("cumulative")) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("rank"), F.col("__u").alias("u"), F.col("doc_id").alias("id"))


def last_taken(queue: DataFrame, budget: int, repeats: int):
    """The last offer of the global order whose cumulative tokens stay within the budget."""
    offers = queue.filter("size > 0 AND target > 0").select("size", F.explode(F.array(*[offer(t) for t in range(repeats)])).alias("o"))
    parts = max(1, int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = stored(
        offers.repartitionByRange(parts, "o").withColumn("__part", F.spark_partition_id()), shared_folder(queue.sparkSession), "offers"
    )
    sums = ordered.groupBy("__part").agg(F.sum("size").alias("__sum")).withColumn(
        "__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    crossing = sums.filter(F.col("__before") <= budget).agg(F.max(F.struct("__before", "__part")).alias("c")).first()["c"]
    if crossing is None:
        return None
    inside = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)  # one range partition
    within = ordered.filter(F.col("__part") == crossing["__part"]).withColumn("__at", F.sum("size").over(inside) + crossing["__before"])
    earlier = ordered.filter(F.col("__part") < crossing["__part"]).agg(F.max("o").alias("o"))
    return earlier.unionByName(within.filter(F.col("__at") <= budget).agg(F.max("o").alias("o"))).agg(F.max("o").alias("o")).first()["o"]


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, chunk_rows: int = CHUNK_ROWS, seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (tokens taken, repeats counted), and the
    columns of ``docs`` that ``keep`` names."""
    queue, budget = queued(docs, weights, repeats, chunk_rows, seed, keep)
    cut = last_taken(queue, budget, repeats)
    times = F.lit(0)
    if cut is not None:
        limit = F.struct(F.lit(cut["finish"]), F.lit(cut["rank"]), F.lit(cut["u"]), F.lit(cut["id"]).cast("long"))
        for turn in range(repeats):
            times = times + (offer(turn) <= limit).cast("int")
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * times).otherwise(F.lit(0)).cast("long")
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)
