"""Immutable versioned Parquet: data first, ledger row last; the ledger append is the commit."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import hashing, keyed
from parcelflow.schemas import LEDGER
from parcelflow.session import checkpointed


class StoreError(ValueError):
    """A version that must not be published or read."""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/ledger"
    return spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def _matches(spark: SparkSession, pattern: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


MANIFEST_FIELDS = ("source_id", "dataset_id", "source_version", "batch", "path", "rows", "earliest", "latest", "content_hash", "predecessor_hash", "status")
_MISSING, _BETWEEN = "-", "\x1f"


def manifest_digest(entry: dict) -> str:
    """SNK-02: digest of the manifest fields as text, in a fixed order."""
    return hashlib.sha256(_BETWEEN.join(_MISSING if entry[k] is None else str(entry[k]) for k in MANIFEST_FIELDS).encode()).hexdigest()


def manifest_digest_column() -> Column:
    """The same digest over the columns of the ledger."""
    return F.sha2(F.concat_ws(_BETWEEN, *[F.coalesce(F.col(k).cast("string"), F.lit(_MISSING)) for k in MANIFEST_FIELDS]), 256)


def _short(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def _dataset_folder(root: str, source_id: str, dataset_id: str) -> str:
    return f"{root}/data/source_id={source_id}/dataset_id={dataset_id}"


def publish_version(
    df: DataFrame, root: str, *, source_id: str, dataset_id: str, version: str, batch: str = "", id_column: str = "observation_id", date_column: str = "observation_date"
) -> dict:
    """SNK-01/02: reject duplicates and emptiness, write zstd Parquet, recount, then append the ledger row.

    A version is one batch or, where ``batch`` is named, a set of batches that are published one by one and
    read together.  The same batch with the same content is ``unchanged``; with other content it is an
    error.  One aggregate over the written files yields counts, range, uniqueness and content hash; ids
    are also checked against the earlier batches of the version.
    """
    spark = df.sparkSession
    known = ledger(spark, root).filter((F.col("source_id") == source_id) & (F.col("dataset_id") == dataset_id))
    same = known.filter(F.col("source_version") == version)
    current = same.filter(F.col("batch") == batch).limit(1).collect()
    if current:
        incoming = hashing.dataset_hash(df).first()["content_hash"]
        if current[0]["content_hash"] != incoming:
            raise StoreError("a published version is immutable and its content differs")
        return {**current[0].asDict(), "outcome": "unchanged"}
    # An abandoned attempt has no ledger row, so each attempt writes its own folder.
    attempt = f"{_short(source_id, dataset_id, version, batch)}-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}"
    folder = f"{_dataset_folder(root, source_id, dataset_id)}/version={_short(version)}"
    path = f"{folder}/columns={_short(*sorted(df.columns))}/{attempt}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    stats = written.select(
        F.col(id_column).alias("id"), F.col(date_column).cast("date").alias("day"), hashing.row_digest(written.columns).alias("digest")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.min("day").alias("earliest"), F.max("day").alias("latest"),
        F.count_if(F.col("id").isNull()).alias("missing_ids"), hashing.order_free_digest(F.col("digest")).alias("content_hash"),
    ).first()
    if stats["rows"] == 0:
        raise StoreError("a version cannot be empty")
    if stats["ids"] != stats["rows"] or stats["missing_ids"]:
        raise StoreError("observation ids must be present and unique within a version")
    if not same.isEmpty():
        held = _facts(spark, folder).join(same.select(_attempt_of(F.col("path")).alias("__folder")), "__folder").select(F.col(id_column).alias("__held"))
        if not written.join(held, written[id_column] == F.col("__held"), "left_semi").isEmpty():
            raise StoreError("observation ids must be unique over the batches of a version")
    newest = known.orderBy(F.col("created_at").desc()).limit(1).collect()
    entry = {
        "source_id": source_id, "dataset_id": dataset_id, "source_version": version, "batch": batch, "created_at": datetime.now(timezone.utc).replace(tzinfo=None), "path": path, "rows": stats["rows"],
        "earliest": stats["earliest"], "latest": stats["latest"], "content_hash": stats["content_hash"], "predecessor_hash": newest[0]["manifest_hash"] if newest else None, "status": "validated",
    }
    entry["manifest_hash"] = manifest_digest(entry)
    spark.createDataFrame([entry], LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return {**entry, "outcome": "published"}


def active_ledger(spark: SparkSession, root: str) -> DataFrame:
    """WIN-02: the newest validated version of each dataset, with all of its batches."""
    entries = ledger(spark, root).filter("status = 'validated'")
    keys = ["source_id", "dataset_id"]
    newest = keyed.newest(entries, keys, [F.col("created_at").desc(), F.col("source_version").desc()]).select(*keys, "source_version")
    return entries.join(newest, [*keys, "source_version"], "left_semi").select(*LEDGER.fieldNames())


def _attempt_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _facts(spark: SparkSession, *folders: str) -> DataFrame:
    """Rows of all files below some folders, with the folder of the attempt that wrote them."""
    facts = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*folders)
    return facts.withColumn("__folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def scan_versions(spark: SparkSession, root: str, *, active: bool = True, sources: list[str] | None = None) -> DataFrame:
    """SRC-21, JN-01: facts of the chosen versions with their manifest hash.

    The names of the chosen versions reach the driver, one per dataset for an active scan, however many
    batches they have; batches, and attempts without a ledger row, are told apart by a join.
    """
    entries = active_ledger(spark, root) if active else ledger(spark, root)
    if sources:
        entries = entries.filter(F.col("source_id").isin(list(sources)))
    versions = entries.select("source_id", "dataset_id", "source_version").distinct().collect()
    if not versions:
        raise StoreError("no published version matches")
    folders = [f"{_dataset_folder(root, r['source_id'], r['dataset_id'])}/version={_short(r['source_version'])}" for r in versions]
    named = entries.select(_attempt_of(F.col("path")).alias("__folder"), F.col("manifest_hash").alias("source_manifest_hash"))
    return _facts(spark, *folders).join(named, "__folder").drop("__folder")


def verify_store(spark: SparkSession, root: str) -> DataFrame:
    """VAL-06/07: stored content against the ledger; one row per batch with its problems.

    One aggregate per dataset and set of columns recounts all of its batches by folder, so the number of
    jobs and of plan branches does not grow with the number of batches.
    """
    entries = ledger(spark, root)
    below = F.regexp_replace("path", "/[^/]+$", "")
    groups = entries.select(below.alias("below")).filter(F.col("below").contains("/columns=")).select(
        F.regexp_extract("below", "^(.*)/version=", 1).alias("dataset"), F.regexp_extract("below", "(columns=.*)$", 1).alias("columns")
    ).distinct().collect()
    if not groups:
        raise StoreError("the ledger is empty")
    found = None
    for r in groups:
        pattern = f"{r['dataset']}/version=*/{r['columns']}"
        if not _matches(spark, pattern):
            continue
        facts = spark.read.option("recursiveFileLookup", "true").parquet(pattern)
        columns = facts.columns
        part = facts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("__folder"), hashing.row_digest(columns).alias("__digest")).groupBy("__folder").agg(
            hashing.order_free_digest(F.col("__digest")).alias("found"), F.count(F.lit(1)).alias("found_rows")
        )
        found = part if found is None else found.unionByName(part)
    base = entries.withColumns({"__folder": _attempt_of(F.col("path")), "manifest_ok": manifest_digest_column() == F.col("manifest_hash")})
    if found is None:
        found = spark.createDataFrame([], "__folder string, found string, found_rows long")
    ok = (F.col("found") == F.col("content_hash")) & (F.col("found_rows") == F.col("rows"))
    return base.join(found, "__folder", "left").select(
        "manifest_hash", "manifest_ok", F.coalesce(ok, F.lit(False)).alias("content_ok"),
        F.when(F.col("found").isNull(), "files_missing").when(~F.col("manifest_ok"), "manifest_tampered").when(~ok, "content_changed").alias("problem"),
    )


def publish_tables(tables: dict[str, DataFrame], root: str, identity: dict) -> dict:
    """SNK-03/04: several tables under one content-addressed version; the manifest row is written last."""
    spark = next(iter(tables.values())).sparkSession
    version = hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:24]
    base = f"{root}/version={version}"
    if _exists(spark, f"{base}/manifest"):
        return {"version": version, "outcome": "unchanged", "path": base}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}")
    rows = [(version, name, spark.read.parquet(f"{base}/{name}").count(), hashing.dataset_hash(spark.read.parquet(f"{base}/{name}")).first()["content_hash"]) for name in tables]
    if any(r[2] == 0 for r in rows):
        raise StoreError("a published table cannot be empty")
    spark.createDataFrame(rows, "version string, table string, rows long, content_hash string").coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest")
    return {"version": version, "outcome": "published", "path": base}


def open_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """VAL-07: the tables of one version of ``publish_tables``, after a recount of each against the manifest."""
    if not _exists(spark, f"{path}/manifest"):
        raise StoreError("the version has no manifest: it was not published")
    tables = {}
    for r in spark.read.parquet(f"{path}/manifest").collect():  # one row per table
        tables[r["table"]] = spark.read.parquet(f"{path}/{r['table']}")
        found = hashing.dataset_hash(tables[r["table"]]).first()
        if found is None or (found["rows"], found["content_hash"]) != (r["rows"], r["content_hash"]):
            raise StoreError(f"table {r['table']} differs from the manifest")
    return tables


def snapshot_raw(files: DataFrame, root: str) -> DataFrame:
    """SNK-05: content-addressed copies of (path, content); known digests are skipped, a changed id is reported."""
    spark = files.sparkSession
    incoming = files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), "content")
    target = f"{root}/raw"
    digests = incoming.select("path", "sha256").distinct()
    # of several contents under one new path, the one with the least digest is stored and the others conflict
    judged = digests.join(digests.groupBy("path").agg(F.min("sha256").alias("__first")), "path")
    outcome = F.when(F.col("sha256") == F.col("__first"), "stored").otherwise("conflict")
    if _exists(spark, target):
        held = spark.read.parquet(target).select(F.col("path").alias("__p"), F.col("sha256").alias("__s")).distinct()
        judged = judged.join(held, F.col("path") == F.col("__p"), "left")
        outcome = F.when(F.col("__s") == F.col("sha256"), "unchanged").when(F.col("__s").isNotNull(), "conflict").otherwise(outcome)
    judged = checkpointed(judged.select("path", "sha256", outcome.alias("outcome")))
    new = judged.filter("outcome = 'stored'").drop("outcome")
    incoming.join(new, ["path", "sha256"], "left_semi").dropDuplicates(["path", "sha256"]).write.mode("append").parquet(target)
    return incoming.select("path", "sha256").join(judged, ["path", "sha256"])


def latest_runs(log: DataFrame) -> DataFrame:
    """SNK-06: newest refresh run per source."""
    return keyed.newest(log, ["source_id"], [F.col("started_at").desc(), F.col("run_id").desc()])


def research_manifest(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """SNK-07: per-snapshot digests and one digest over all of them, independent of row order."""
    per = hashing.dataset_hash(observations, ["snapshot_id"], "observations_hash")
    joined = snapshots.join(per, "snapshot_id", "left").fillna(0, ["rows"])
    entry = F.sha2(F.concat_ws("|", "snapshot_id", "content_sha256", F.coalesce("observations_hash", F.lit(""))), 256)
    return joined.select(entry.alias("d"), "rows").agg(F.count(F.lit(1)).alias("snapshots"), F.sum("rows").alias("observations"), hashing.order_free_digest(F.col("d")).alias("manifest_hash"))


def write_review_extract(df: DataFrame, path: str, note_columns: list[str]) -> None:
    """SNK-08: selected rows with empty note columns as CSV; text that a spreadsheet would run is quoted."""
    safe = [F.when(F.col(c).rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe, *[F.lit("").alias(n) for n in note_columns]).write.mode("errorifexists").option("header", True).csv(path)
