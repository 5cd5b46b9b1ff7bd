"""What one task of a shuffle holds does not follow the number of partitions that the session starts with."""

from pyspark.sql import functions as F

from parcelflow import session
from parcelflow.plans import bindings


def test_shuffles_start_in_many_pieces(spark, tmp_path):
    """with few partitions set, a shuffle still splits by bytes."""
    own = {k: spark.conf.get(k, None) for k in (session.INITIAL, "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.unset(session.INITIAL)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1048576")
        spark.range(1200000).withColumn("v", F.sha2(F.col("id").cast("string"), 256)).write.parquet(f"{tmp_path}/part.parquet")
        counts = bindings.table(spark, str(tmp_path), "part").groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
        assert counts.rdd.getNumPartitions() > 8
        spark.conf.set(session.INITIAL, "3")
        assert session.roomy(spark).conf.get(session.INITIAL) == "3"
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
