"""Streaming and store queries run to completion over the driver tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from parcelflow.functions import hashing, keyed
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query
from parcelflow.sources import store
from parcelflow.streaming import refresh


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location; a local scratch folder only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def events_stream(spark, sf_dir):
    batch = b.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windowed", """
select date_trunc('hour', ts) as period_start, event_type, count(*) as observations, round(sum(value), 4) as total, max(ts) as available_at from events group by 1, 2""")
def stream_windowed(spark, sf_dir):
    root = scratch(spark, "rollup")
    rolled = refresh.period_rollup(events_stream(spark, sf_dir), ["event_type"], "ts", "value", "1 day", "1 hour")
    closing = refresh.run_to_table(rolled, f"{root}/out", f"{root}/checkpoint")
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return closing.select(plain("period_start"), "event_type", "observations", F.round("total", 4).alias("total"), plain("available_at"))


@query("stream_deduplicated", "select event_id, event_type, value from events")
def stream_deduplicated(spark, sf_dir):
    """Every event delivered twice; one row per id survives."""
    root = scratch(spark, "dedupe")
    stream = events_stream(spark, sf_dir)
    unique = refresh.deduplicated(stream.union(events_stream(spark, sf_dir)), "event_id", "ts", "400 days")
    refresh.run_available(unique.select("event_id", "event_type", "value"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("stream_refresh", """
select event_type as metric, count(*) as observations, min(cast(ts as date)) as earliest, max(cast(ts as date)) as latest from events group by 1""")
def stream_refresh(spark, sf_dir):
    """Raw events in three micro-batches of several files, published as batches of one version, replayed, then read back."""
    root = scratch(spark, "refresh")
    events = b.table(spark, sf_dir, "events")
    files = spark.sparkContext.defaultParallelism
    events.repartition(3 * files, "event_id").write.parquet(f"{root}/raw")

    def normalize(batch):
        return batch.select(
            F.col("event_id").cast("string").alias("observation_id"), F.to_date("ts").alias("observation_date"), F.col("event_type").alias("metric"), F.col("value").cast("decimal(38,12)").alias("value"))

    for attempt in ("first", "replay"):
        stream = refresh.file_stream(spark, f"{root}/raw", events.schema, max_files=files)
        refresh.incremental_refresh(stream, normalize, f"{root}/store", f"{root}/checkpoint-{attempt}", source_id="events", dataset_id="daily").awaitTermination()
    facts = store.scan_versions(spark, f"{root}/store")
    return facts.groupBy("metric").agg(F.count(F.lit(1)).alias("observations"), F.min("observation_date").alias("earliest"), F.max("observation_date").alias("latest"))


@query("publish_and_scan", """
select o_orderpriority as source, count(*) as rows, round(sum(o_totalprice), 2) as total, true as verified from orders group by 1""")
def publish_and_scan(spark, sf_dir):
    """Two published versions of orders; the newest is scanned and its content verified."""
    root = scratch(spark, "store")
    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("observation_id"), F.to_date("o_orderdate").alias("observation_date"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("value"))
    store.publish_version(orders.filter("value > 1000"), root, source_id="orders", dataset_id="all", version="1")
    store.publish_version(orders, root, source_id="orders", dataset_id="all", version="2")
    bad = store.verify_store(spark, root).filter("problem IS NOT NULL").select(F.lit(1).alias("__one")).groupBy("__one").count()
    facts = store.scan_versions(spark, root).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total")).withColumn("__one", F.lit(1))
    return facts.join(bad, "__one", "left").select("source", "rows", "total", F.col("count").isNull().alias("verified"))


@query("raw_snapshots", "select 'page-' || page_id as path, sha256(html) as sha256, 'stored' as outcome from pages")
def raw_snapshots(spark, sf_dir):
    root = scratch(spark, "raw")
    files = b.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return store.snapshot_raw(files, root)


@query("refresh_latest", """
select event_type as source_id, max(ts) as started_at from events group by 1""")
def refresh_latest(spark, sf_dir):
    log = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"))
    return store.latest_runs(log).select("source_id", "started_at")


@query("research_manifest", """
select count(distinct o_orderpriority) as snapshots, count(*) as observations from orders""")
def research_manifest(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("snapshot_id"), "o_orderkey", "o_totalprice")
    snapshots = orders.select("snapshot_id").distinct().withColumn("content_sha256", F.sha2("snapshot_id", 256))
    return store.research_manifest(orders, snapshots).select("snapshots", "observations")


@query("content_hashes", "select l_returnflag, count(*) as rows from lineitem group by 1")
def content_hashes(spark, sf_dir):
    """Order-free content hash per flag: equal for a shuffled copy."""
    lines = b.table(spark, sf_dir, "lineitem")
    first = hashing.dataset_hash(lines, ["l_returnflag"])
    again = hashing.dataset_hash(lines.repartition("l_partkey"), ["l_returnflag"]).select("l_returnflag", F.col("content_hash").alias("other"))
    return keyed.null_safe_join(first, again, ["l_returnflag"]).filter("content_hash = other").select("l_returnflag", "rows")
