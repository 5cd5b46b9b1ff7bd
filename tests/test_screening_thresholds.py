"""Shares of double columns that lie on a threshold go the way of the query's SQL; decimals stay exact."""

from pyspark.sql import functions as F

from parcelflow.operators import screening
from parcelflow.plans import registry


def test_doubles_on_a_threshold_match_the_sql(spark, tmp_path):
    import duckdb

    registry.load()
    con = duckdb.connect()
    con.execute("""create table part as select range as p_partkey, 'P' as p_name, 'B' as p_brand, 'T' as p_type, 1 as p_size, round((range + 1) * 0.95, 2) as p_retailprice from range(3000)""")
    con.execute("""create table lineitem as select p_partkey as l_orderkey, p_partkey as l_partkey, 1::bigint as l_suppkey, 1 as l_linenumber, 1.0::double as l_quantity,
      2.0::double * (p_partkey + 1) as l_extendedprice, 0.01::double as l_discount, 0.01::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '1996-09-13' as l_shipdate from part""")
    for table in ("part", "lineitem"):
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet'")
    want = con.execute(f"select candidate_id, screening_tier, signals, high_signals_found from ({registry.ORACLES['screening_tiers']}) order by 1").fetchall()
    got = registry.QUERIES["screening_tiers"](spark, str(tmp_path)).select("candidate_id", "screening_tier", "signals", "high_signals_found").orderBy("candidate_id")
    assert [tuple(r) for r in got.collect()] == want


def test_decimals_on_a_threshold_stay_exact(spark):
    names = ("market_rent", "subject_rent", "comparable_sale_basis", "acquisition_basis", "stabilized_noi", "current_noi", "subject_cap_rate", "market_cap_rate", "subject_vacancy", "market_vacancy")
    prices = {"market_rent": "1.80", "subject_rent": "1.71"}
    row = spark.range(1).select(
        F.lit("a").alias("candidate_id"), *[F.lit(prices.get(n)).cast("decimal(20,8)").alias(n) for n in names], F.lit(1).alias("rent_comp_count"), F.lit(1).alias("sale_comp_count"),
        F.lit(True).alias("location_evidence_complete"), F.lit(True).alias("renovation_budget_verified"), F.lit("2024-01-01").cast("date").alias("insurance_evidence_date"),
        F.lit("2024-01-01").cast("date").alias("analysis_as_of"), F.create_map(F.lit("rent"), F.array(F.lit("h"))).alias("evidence_hashes"),
        F.create_map(F.lit("rent"), F.lit("2024-01-01").cast("date")).alias("evidence_dates"),
    )
    assert screening.screen(row).first()["signals"] == 1
