"""Helpers shared by the operators: staging in the shared folder and Arrow row access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character class of regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets the
    checkpoint folder of its own context, and a cluster without it is refused."""
    from parcelflow.session import checkpointed

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.getCheckpointDir() is None:
            checkpointed(spark.range(1))  # sets the folder, or refuses
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only id and text, a null text as the empty text."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )


def unit_hash(*columns: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed."""
    return zstandard.compress(numbers.astype(np.int32).tobytes(), 1)


def unpacked(content: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content), np.int32)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, UTF-8 bytes) of each row of (doc_id, text) batches."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (tuples in the order of ``schema``) as record batches of at most ``size`` rows."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()
