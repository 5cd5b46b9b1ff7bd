"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.showConsoleProgress": "false",
}


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PIECES = 512
LONGEST = "spark.sql.codegen.hugeMethodLimit"


def local_session(app: str = "parcelflow", cores: int | str = 8, **extra) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PARCELFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def roomy(spark: SparkSession) -> SparkSession:
    """Shuffles start in ``PIECES`` and adaptive execution joins small neighbours, so what one task holds is bounded by
    bytes and does not grow with the input over a fixed number of partitions.  Stages whose code the JVM would refuse to
    compile (over 8,000 bytes in one method) run as single compiled operators.  A cluster's own settings win."""
    if spark.conf.get(INITIAL, None) is None:
        spark.conf.set(INITIAL, str(max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if not spark.sparkContext.getConf().contains(LONGEST):
        spark.conf.set(LONGEST, "8000")
    return spark


def spread_rows(df: DataFrame) -> DataFrame:
    """The rows dealt evenly, for work that is large beside its bytes: a file of a few MB is else read in one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed`` as Parquet files in the same folder: repeated texts take little room, a reader takes only the
    columns it needs, and the planner knows the size of what it joins."""
    path = f"{_checkpoint_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's own setting wins.  Only a local master gets a scratch folder, because a
    machine-local path does not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return context.getCheckpointDir()
