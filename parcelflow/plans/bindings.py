"""Evidence-shaped views over the driver tables, with the same views as DuckDB text.

Nations stand for counties, regions for metropolitan areas, market segments for property
types, order priorities for sources and return flags for vintages.  Money is summed as
decimals, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import periods
from parcelflow.session import roomy

OBSERVATION_METRICS = ("effective_rent", "inventory", "rent_growth_12m", "revenue", "vacancy_rate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return roomy(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the date, priority, nation and segment of their order; the lines move once."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_date"), "o_orderpriority", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    lines = table(spark, sf_dir, "lineitem")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(placed, lines.l_orderkey == placed.o_orderkey)
        .withColumn("geography_id", F.lpad(F.col("c_nationkey").cast("string"), 5, "0"))
        .withColumn("property_type", F.lower("c_mktsegment"))
    )


SQL_LINES = """lines as (
  select l.*, cast(o_orderdate as date) as o_date, o_orderkey, o_custkey, o_orderpriority, o_orderstatus, c_nationkey,
         lpad(cast(c_nationkey as varchar), 5, '0') as geography_id, lower(c_mktsegment) as property_type
  from lineitem l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""


def market_sums(spark: SparkSession, sf_dir: str, *keys: str, frequency: str = "quarter") -> DataFrame:
    lines = order_lines(spark, sf_dir).withColumn("period_start", F.to_date(F.date_trunc(frequency, "o_date")))
    return lines.groupBy(*keys, "period_start").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price_sum"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity_sum"),
        F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("discount_sum"),
        F.sum(F.col("l_tax").cast("decimal(18,2)")).alias("tax_sum"),
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("revenue_sum"),
        F.count(F.lit(1)).alias("line_count"),
        F.max(F.to_date("l_shipdate")).alias("available_at"),
    )


def sql_market_sums(name: str, keys: str, frequency: str = "quarter") -> str:
    return f"""{name} as (
  select {keys}, cast(date_trunc('{frequency}', o_date) as date) as period_start,
         sum(cast(l_extendedprice as decimal(18,2))) as price_sum, sum(cast(l_quantity as decimal(18,2))) as quantity_sum,
         sum(cast(l_discount as decimal(18,2))) as discount_sum, sum(cast(l_tax as decimal(18,2))) as tax_sum,
         sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as revenue_sum, count(*) as line_count,
         max(cast(l_shipdate as date)) as available_at
  from lines group by all)"""


def _measures() -> dict:
    d = lambda c: F.col(c).cast("double")
    n = F.col("line_count").cast("double")
    return {
        "effective_rent": d("price_sum") / d("quantity_sum"),
        "inventory": d("quantity_sum"),
        "rent_growth_12m": d("tax_sum") / n - F.lit(0.04),
        "revenue": d("revenue_sum"),
        "vacancy_rate": d("discount_sum") / n,
    }


def market_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: metric by segment, nation and quarter (one row per key)."""
    measures = _measures()
    wide = market_sums(spark, sf_dir, "geography_id", "property_type").select(
        "geography_id", "property_type", F.col("period_start").alias("observation_date"), "line_count", "available_at",
        *[expr.alias(name) for name, expr in measures.items()],
    )
    return wide.unpivot(
        ["geography_id", "property_type", "observation_date", "line_count", "available_at"], list(measures), "metric", "value"
    ).select(
        "metric", "property_type", F.lit("market").alias("geography_type"), "geography_id", "observation_date", "value",
        F.col("line_count").alias("sample_count"), "available_at",
    )


SQL_OBSERVATIONS = (
    SQL_LINES + ",\n" + sql_market_sums("sums", "geography_id, property_type") + """,
wide as (
  select geography_id, property_type, period_start as observation_date, line_count as sample_count, available_at,
         cast(price_sum as double) / cast(quantity_sum as double) as effective_rent, cast(quantity_sum as double) as inventory,
         cast(tax_sum as double) / line_count - 0.04::double as rent_growth_12m, cast(revenue_sum as double) as revenue,
         cast(discount_sum as double) / line_count as vacancy_rate
  from sums),
obs as (
  select metric, property_type, 'market' as geography_type, geography_id, observation_date, value, sample_count, available_at
  from wide unpivot (value for metric in (effective_rent, inventory, rent_growth_12m, revenue, vacancy_rate)))"""
)


def cre_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target record per order line and metric; sources and vintages disagree by construction."""
    lines = order_lines(spark, sf_dir)
    base = lines.select(
        F.lit("market").alias("geography_type"), "geography_id",
        periods.quarter_label("o_date").alias("period"), F.lit("quarterly").alias("frequency"),
        "property_type", F.lit(None).cast("string").alias("property_subtype"),
        F.col("o_orderpriority").alias("source_name"), F.col("l_returnflag").alias("vintage"),
        F.col("l_linestatus").alias("methodology"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("evidence"),
        F.to_date("l_shipdate").alias("release_date"),
        F.date_add(F.to_date("l_shipdate"), (F.col("l_suppkey") % 900).cast("int")).alias("retrieved_on"),
        F.when(F.col("l_tax") < 0.06, "analyst_verified").when(F.col("l_tax") < 0.08, "unverified").otherwise("rejected").alias("verification_status"),
        F.when(F.col("l_quantity") > 45, "context_proxy").otherwise("institutional_target").alias("target_classification"),
        F.col("l_quantity").cast("long").alias("sample_count"),
        F.col("l_discount").alias("vacancy_rate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("asking_rent"),
    )
    keys = [c for c in base.columns if c not in ("vacancy_rate", "asking_rent")]
    long = base.unpivot(keys, ["vacancy_rate", "asking_rent"], "metric", "value")
    return long.withColumns({
        "observation_id": F.concat_ws("-", "evidence", "metric"),
        "is_rate": F.col("metric") == "vacancy_rate",
        "jump_threshold": F.when(F.col("metric") == "vacancy_rate", F.lit(0.10)).otherwise(F.lit(0.35)),
        "unit": F.when(F.col("metric") == "vacancy_rate", "decimal_fraction").otherwise("USD_per_unit_month"),
        "source_class": F.when(F.col("source_name") == "1-URGENT", "federal_public")
        .when(F.col("source_name") == "2-HIGH", "state_local_public").otherwise("manual_research"),
        "notes": F.lit(None).cast("string"),
        "redistribution_permitted": F.when(F.col("vintage") == "A", "yes").otherwise("unknown"),
        "licensing_notes": F.when(F.col("vintage") == "N", F.lit(None).cast("string")).otherwise(F.lit("documented")),
    })


SQL_RECORDS = SQL_LINES + """,
base as (
  select 'market' as geography_type, geography_id,
         cast(year(o_date) as varchar) || '-Q' || cast(quarter(o_date) as varchar) as period, 'quarterly' as frequency,
         property_type, cast(null as varchar) as property_subtype, o_orderpriority as source_name, l_returnflag as vintage,
         l_linestatus as methodology, concat_ws('-', l_orderkey, l_linenumber, l_partkey) as evidence,
         cast(l_shipdate as date) as release_date,
         cast(l_shipdate as date) + cast(l_suppkey % 900 as integer) as retrieved_on,
         case when l_tax < 0.06::double then 'analyst_verified' when l_tax < 0.08::double then 'unverified' else 'rejected' end as verification_status,
         case when l_quantity > 45 then 'context_proxy' else 'institutional_target' end as target_classification,
         cast(l_quantity as bigint) as sample_count, l_discount as vacancy_rate, l_extendedprice / l_quantity as asking_rent
  from lines),
records as (
  select u.*, concat_ws('-', evidence, metric) as observation_id, metric = 'vacancy_rate' as is_rate,
         case when metric = 'vacancy_rate' then 0.10::double else 0.35::double end as jump_threshold,
         case when metric = 'vacancy_rate' then 'decimal_fraction' else 'USD_per_unit_month' end as unit,
         case source_name when '1-URGENT' then 'federal_public' when '2-HIGH' then 'state_local_public' else 'manual_research' end as source_class,
         case when vintage = 'A' then 'yes' else 'unknown' end as redistribution_permitted,
         case when vintage = 'N' then null else 'documented' end as licensing_notes
  from (from base unpivot (value for metric in (vacancy_rate, asking_rent))) u)"""


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical long observations: price and quantity of every order line, dated by its order."""
    lines = order_lines(spark, sf_dir)
    base = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("evidence"),
        F.col("o_orderpriority").alias("source_id"), F.col("l_returnflag").alias("source_dataset"),
        F.col("l_linestatus").alias("source_version"), F.to_date("l_shipdate").alias("as_of_date"),
        F.lit("county").alias("geography_type"), "geography_id", F.col("o_date").alias("observation_date"),
        F.lit("daily").alias("period_type"),
        F.when(F.col("l_tax") < 0.03, "high").when(F.col("l_tax") < 0.06, "moderate").when(F.col("l_tax") < 0.08, "low")
        .otherwise("unknown").alias("quality_level"),
        F.col("l_extendedprice").cast("decimal(38,12)").alias("line_price"),
        F.col("l_quantity").cast("decimal(38,12)").alias("line_quantity"),
    )
    keys = [c for c in base.columns if not c.startswith("line_")]
    long = base.unpivot(keys, ["line_price", "line_quantity"], "metric", "value")
    return long.withColumns({
        "observation_id": F.concat_ws("-", "evidence", "metric"),
        "unit": F.when(F.col("metric") == "line_price", "USD").otherwise("units"),
        "source_series": F.col("metric"),
    })


SQL_CANONICAL = SQL_LINES + """,
evidence_rows as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey) as evidence, o_orderpriority as source_id,
         l_returnflag as source_dataset, l_linestatus as source_version, cast(l_shipdate as date) as as_of_date,
         'county' as geography_type, geography_id, o_date as observation_date, 'daily' as period_type,
         case when l_tax < 0.03::double then 'high' when l_tax < 0.06::double then 'moderate' when l_tax < 0.08::double then 'low' else 'unknown' end as quality_level,
         cast(l_extendedprice as decimal(38,12)) as line_price, cast(l_quantity as decimal(38,12)) as line_quantity
  from lines),
canonical as (
  select u.*, concat_ws('-', evidence, metric) as observation_id,
         case when metric = 'line_price' then 'USD' else 'units' end as unit, metric as source_series
  from (from evidence_rows unpivot (value for metric in (line_price, line_quantity))) u)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (source, dataset, version): when its newest line shipped."""
    return canonical(spark, sf_dir).groupBy("source_id", "source_dataset", "source_version").agg(
        F.max("as_of_date").alias("created_at"), F.count(F.lit(1)).alias("rows")
    )


SQL_LEDGER = SQL_CANONICAL + """,
ledger as (
  select source_id, source_dataset, source_version, max(as_of_date) as created_at, count(*) as rows
  from canonical group by all),
active as (
  select * from ledger qualify row_number() over (partition by source_id, source_dataset order by created_at desc, source_version desc) = 1)"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County membership vintages: each order date of a nation re-delineates it to a region."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("o_date"), "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return rows.groupBy(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"), F.to_date(F.date_trunc("year", "o_date")).alias("observation_date")
    ).agg(F.min("o_orderpriority").alias("source_version"), F.count(F.lit(1)).alias("evidence_rows")).withColumns({
        "metric": F.lit("county_cbsa_membership"), "as_of_date": F.last_day(F.col("observation_date")),
        "cbsa": F.lpad(((F.col("county_fips").cast("int") + F.year("observation_date")) % 5).cast("string"), 5, "1"),
    })


SQL_CROSSWALK = """crosswalk as (
  select lpad(cast(c_nationkey as varchar), 5, '0') as county_fips, cast(date_trunc('year', o_orderdate) as date) as observation_date,
         min(o_orderpriority) as source_version, count(*) as evidence_rows, 'county_cbsa_membership' as metric,
         last_day(cast(date_trunc('year', o_orderdate) as date)) as as_of_date,
         lpad(cast((c_nationkey + year(cast(date_trunc('year', o_orderdate) as date))) % 5 as varchar), 5, '1') as cbsa
  from orders join customer on o_custkey = c_custkey group by all)"""
