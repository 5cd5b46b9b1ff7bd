"""Steps whose work sat in few tasks: the digest's sums, files of a stream, rows that cite nothing."""

import glob

from pyspark.sql import functions as F

from parcelflow.functions import hashing
from parcelflow.operators import verification as v
from parcelflow.plans import registry, stream_queries

SF = "/root/testdata/sf0.001"


def test_digest_sums_are_longs_and_keep_their_value(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    got = rows.agg(hashing.order_free_digest(F.col("d")).alias("h"))
    parts = [F.sum(F.conv(F.substring("d", start, 12), 16, 10).cast("decimal(38,0)")).cast("string") for start in (1, 13, 25, 37)]
    want = rows.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("h"))
    assert got.first() == want.first()
    assert "decimal(38,0)" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_content_is_spread_beyond_seven_tasks(spark):
    registry.load()
    plan = registry.QUERIES["content_hashes"](spark, SF)._jdf.queryExecution().logical().toString()
    assert "l_partkey" in plan and "], 7" not in plan


def test_a_micro_batch_holds_several_files(spark, tmp_path, monkeypatch):
    registry.load()
    monkeypatch.setattr(stream_queries, "scratch", lambda spark, name: str(tmp_path / name))
    assert registry.QUERIES["stream_refresh"](spark, SF).agg(F.sum("observations")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert len(glob.glob(str(tmp_path / "refresh/raw/*.parquet"))) > 3 and len(glob.glob(str(tmp_path / "refresh/checkpoint-first/offsets/[0-9]*"))) == 3


def test_rows_that_cite_nothing_stay_out_of_the_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(v, "checkpointed", lambda df: seen.append(df) or df.localCheckpoint())
    rows = spark.createDataFrame([("a", "doc#1"), ("b", "derived:a"), ("c", "derived:x")], "observation_id string, source_identifier string")
    got = {tuple(r) for r in v.evidence_roots(rows).collect()}
    assert got == {("a", "doc", 0), ("b", "doc", 1), ("c", "derived:x", 0)}
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
