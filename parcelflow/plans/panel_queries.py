"""Target eligibility, market definitions and target panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import periods
from parcelflow.operators import target_panel as t, verification as v
from parcelflow.plans import bindings as b
from parcelflow.plans import target_queries as tq
from parcelflow.plans.registry import query
from parcelflow.session import stored

SQL_JUDGED = tq.SQL_SCORED + """,
firsts as (select *, release_date as target_available_at, case when not model_eligible then 'not_model_eligible' end as r1 from scored),
cand as (select *, min(methodology) over w <> max(methodology) over w as changed from firsts where r1 is null window w as (partition by geography_id, frequency, property_type, metric, source_name)),
cells as (select *, bool_or(changed) over w as cell_changed, count(*) over w as cell_rows from cand window w as (partition by geography_id, period, frequency, property_type, metric)),
gated as (
  select observation_id, geography_id, period, property_type, metric, verification_status, value, source_name, release_date,
    case when cell_changed then 'longitudinal_methodology_change' when cell_rows <> 1 then 'unresolved_multiple_sources' end as reason from cells
  union all select observation_id, geography_id, period, property_type, metric, verification_status, value, source_name, release_date, r1 from firsts where r1 is not null)"""


def judged(spark, sf_dir):
    return t.eligibility(stored(tq.judged(spark, sf_dir)))


@query("target_exclusions", "with " + SQL_JUDGED + " select property_type, metric, coalesce(reason, 'eligible') as reason, count(*) as rows from gated group by all")
def target_exclusions(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.groupBy("property_type", "metric", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query("target_readiness", "with " + SQL_JUDGED + """,
d as (select property_type, metric, geography_id, count(distinct period) as p from gated where reason is null group by all),
dd as (select property_type, metric, count(*) as markets, count(*) filter (where p >= 2) as deep_markets from d group by all),
x as (select property_type, metric, count(*) as observations, count(*) filter (where verification_status = 'analyst_verified') as verified, count(*) filter (where reason is null) as eligible,
  count(distinct period) filter (where reason is null) as periods, min(period) filter (where reason is null) as earliest, max(period) filter (where reason is null) as latest from gated group by all)
select property_type, metric, observations, verified, eligible, periods, earliest, latest, coalesce(markets, 0) as markets, coalesce(deep_markets, 0) as deep_markets,
  round(case when coalesce(markets, 0) * periods > 0 then 1.0::double - eligible / (markets * periods) end, 6) as missingness,
  case when coalesce(markets, 0) >= 5 and periods >= 2 and coalesce(deep_markets, 0) >= 5 and eligible >= 10 then 'ready' else 'not_ready' end as status
from x left join dd using (property_type, metric)""")
def target_readiness(spark, sf_dir):
    available = F.coalesce(F.col("release_date"), F.col("retrieved_on"))
    by = ["codes", "model_eligible", "verification_status", available.isNull().alias("undated")]
    rows = tq.counted(spark, sf_dir, by, F.max(available).alias("target_available_at")).withColumn("verification_findings", v.code_names(F.col("codes")))
    out = t.target_readiness(t.eligibility(stored(rows)), markets=5, periods_minimum=2, observations=10)
    return out.withColumn("missingness", F.round("missingness", 6)).drop("reasons")


def definitions(spark, sf_dir):
    """Effective-dated definitions: each nation and segment, split by year of its customers' orders."""
    years = b.order_lines(spark, sf_dir).select("geography_id", "property_type", F.year("o_date").alias("y")).distinct()
    key = F.col("geography_id").cast("int")
    start = F.make_date("y", F.lit(1), F.lit(1))
    return years.select(
        F.concat_ws(":", "geography_id", "property_type", "y").alias("definition_id"), F.col("geography_id").alias("market_id"), "property_type", start.alias("effective_from"),
        F.when(key % 5 == 0, F.add_months(start, 18)).when(key % 5 == 1, F.add_months(start, 6)).otherwise(F.date_sub(F.add_months(start, 12), 1)).alias("effective_to"),
        F.when(key % 7 == 0, "draft").otherwise("analyst_approved").alias("review_status"),
    )


SQL_DEFINITIONS = b.SQL_RECORDS + """,
dy as (select distinct geography_id, property_type, year(o_date) as y from lines),
defs as (
  select geography_id || ':' || property_type || ':' || y as definition_id, geography_id as market_id, property_type, make_date(y, 1, 1) as effective_from,
    cast(case cast(geography_id as integer) % 5 when 0 then make_date(y, 1, 1) + interval 18 month when 1 then make_date(y, 1, 1) + interval 6 month else make_date(y, 12, 31) end as date) as effective_to,
    case when cast(geography_id as integer) % 7 = 0 then 'draft' else 'analyst_approved' end as review_status from dy)"""


@query("market_definition_interval", "with " + SQL_DEFINITIONS + """,
c as (select distinct geography_id, property_type, period, last_day(make_date(cast(substr(period, 1, 4) as integer), cast(substr(period, 7, 1) as integer) * 3, 1)) as pe from records),
m as (select c.geography_id, c.property_type, c.period, count(d.definition_id) as n, min(d.definition_id) as definition_id from c
  left join defs d on d.market_id = c.geography_id and d.property_type = c.property_type and d.review_status = 'analyst_approved' and d.effective_from <= c.pe and c.pe <= d.effective_to group by all)
select r.observation_id, case when n = 1 then definition_id end as definition_id, case when n = 0 then 'missing_market_definition' when n > 1 then 'ambiguous_market_definition' end as problem
from records r join m using (geography_id, property_type, period)""")
def market_definition_interval(spark, sf_dir):
    return t.match_definitions(tq.records(spark, sf_dir), definitions(spark, sf_dir)).select("observation_id", "definition_id", "problem")


@query("overlapping_definitions", "with " + SQL_DEFINITIONS + """
select d.market_id, d.property_type, d.definition_id from defs d
where d.review_status = 'analyst_approved' and exists (select 1 from defs e where e.market_id = d.market_id and e.property_type = d.property_type and e.review_status = 'analyst_approved'
  and (e.effective_from, e.definition_id) < (d.effective_from, d.definition_id) and greatest(e.effective_from, d.effective_from) <= least(e.effective_to, d.effective_to))""")
def overlapping_definitions(spark, sf_dir):
    return t.overlapping_definitions(definitions(spark, sf_dir)).select("market_id", "property_type", "definition_id")


@query("definition_coverage", "with " + SQL_DEFINITIONS + """
select market_id, count(*) as definitions, count(*) filter (where review_status = 'analyst_approved') as approved,
  case when count(*) filter (where review_status = 'analyst_approved') = 0 then 'not_approved' when count(*) filter (where review_status = 'analyst_approved') > 1 then 'multiple_approved' end as reason, false as feature_eligible
from defs group by market_id""")
def definition_coverage(spark, sf_dir):
    rows = definitions(spark, sf_dir).withColumn("weight_sum", F.lit(1).cast("decimal(28,12)"))
    return t.definition_coverage(tq.records(spark, sf_dir), rows)


def inventory(spark, sf_dir):
    """Customers as properties: market = segment, county = nation, units = account balance in whole units."""
    return b.table(spark, sf_dir, "customer").select(
        F.lower("c_mktsegment").alias("market_id"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"), (F.floor(F.abs("c_acctbal")) + 1).cast("long").alias("units")
    )


SQL_WEIGHTS = """inv as (select lower(c_mktsegment) as market_id, lpad(cast(c_nationkey as varchar), 5, '0') as county_fips, cast(floor(abs(c_acctbal)) as bigint) + 1 as units from customer),
per as (select market_id, county_fips, sum(units) as u from inv group by all),
tot as (select market_id, sum(u) as total, max(county_fips) as last from per group by 1),
fl as (select market_id, county_fips, last, cast((cast(u as hugeint) * 1000000000000) // cast(total as hugeint) as hugeint) as f from per join tot using (market_id)),
weights as (select market_id, county_fips, case when county_fips = last then 1000000000000 - coalesce(sum(case when county_fips <> last then f end) over (partition by market_id), 0) else f end / 1e12::double as weight from fl)"""


@query("county_weights", "with " + SQL_WEIGHTS + " select market_id, county_fips, weight, 'units' as basis from weights")
def county_weights(spark, sf_dir):
    return t.county_weights(inventory(spark, sf_dir)).withColumn("weight", F.col("weight").cast("double"))


@query("market_definition_check", "with " + SQL_WEIGHTS + " select market_id as definition_id, count(*) as components, 0 as problems, true as sums_to_one from weights group by 1")
def market_definition_check(spark, sf_dir):
    from parcelflow.operators import validate

    weights = t.county_weights(inventory(spark, sf_dir))
    nested = weights.groupBy(F.col("market_id").alias("definition_id")).agg(F.collect_list(F.struct("county_fips", "weight")).alias("counties"))
    out = validate.market_definition_errors(nested)
    return out.select("definition_id", "components", F.size("errors").alias("problems"), (F.col("total") == 1).alias("sums_to_one"))


def county_values(spark, sf_dir):
    rows = b.market_sums(spark, sf_dir, "geography_id")
    wide = rows.select("geography_id", "period_start", "available_at", F.col("revenue_sum").cast("double").alias("revenue"), F.lit(4.5).alias("national_rate"))
    return wide.unpivot(["geography_id", "period_start", "available_at"], ["revenue", "national_rate"], "feature_name", "value")


RULES = [("revenue", "portfolio_weighted_mean"), ("national_rate", "broadcast")]


@query("market_weighted_features", "with " + b.SQL_LINES + ", " + b.sql_market_sums("sums", "geography_id") + ", " + SQL_WEIGHTS + """,
j as (select w.market_id as definition_id, period_start, count(*) as n, sum(cast(revenue_sum as double) * weight) as v, max(available_at) as available_at
  from weights w join sums s on s.geography_id = w.county_fips group by all),
z as (select market_id, count(*) as counties from weights group by 1)
select definition_id, feature_name, period_start, round(case when n = counties then case feature_name when 'revenue' then v else 4.5::double end end, 4) as value,
  case when n = counties then available_at end as available_at, false as broadcast_conflict
from j join z on z.market_id = definition_id, (select unnest(['revenue', 'national_rate']) as feature_name)""")
def market_weighted_features(spark, sf_dir):
    weights = t.county_weights(inventory(spark, sf_dir)).withColumnRenamed("market_id", "definition_id").drop("basis")
    rules = spark.createDataFrame(RULES, "feature_name string, rule string")
    out = t.weighted_features(weights, county_values(spark, sf_dir), rules)
    return out.withColumn("value", F.round("value", 4))


@query("target_panel", "with " + b.SQL_OBSERVATIONS + ", nation_sums as (select geography_id, cast(date_trunc('quarter', o_date) as date) as period_start, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue, max(cast(l_shipdate as date)) as available_at from lines group by all), " + SQL_WEIGHTS + """,
area_sums as (select lpad(cast(n_regionkey as varchar), 5, '9') as cbsa, period_start, sum(revenue) as revenue, max(available_at) as available_at from nation_sums join nation on lpad(cast(n_nationkey as varchar), 5, '0') = geography_id group by all),
z as (select market_id, count(*) as counties from weights group by 1),
mk as (select w.market_id as definition_id, period_start, case when count(*) = any_value(counties) then sum(revenue * weight) end as revenue, case when count(*) = any_value(counties) then max(available_at) end as available_at
  from weights w join nation_sums s on s.geography_id = w.county_fips join z on z.market_id = w.market_id group by all),
tg as (select *, cast(geography_id as integer) % 3 as k from obs where metric = 'vacancy_rate')
select tg.geography_id as market_id, tg.property_type, observation_date as period_start, round(tg.value, 6) as vacancy_rate,
  case k when 0 then 'cbsa' when 1 then 'county' else 'market_weighted_counties' end as feature_geography_type, round(coalesce(a.revenue, c.revenue, m.revenue), 4) as revenue,
  coalesce(a.available_at, c.available_at, m.available_at) as revenue__available_at
from tg join nation on lpad(cast(n_nationkey as varchar), 5, '0') = tg.geography_id
left join area_sums a on k = 0 and a.cbsa = lpad(cast(n_regionkey as varchar), 5, '9') and a.period_start = observation_date
left join nation_sums c on k = 1 and c.geography_id = tg.geography_id and c.period_start = observation_date
left join mk m on k = 2 and m.definition_id = tg.property_type and m.period_start = observation_date
where a.cbsa is not null or c.geography_id is not null or m.definition_id is not null""")
def target_panel(spark, sf_dir):
    """Vacancy per nation and segment joined to revenue by area, county or weighted counties."""
    nations = b.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geography_id"), F.lpad(F.col("n_regionkey").cast("string"), 5, "9").alias("area"))
    key = F.col("geography_id").cast("int") % 3
    targets = b.market_observations(spark, sf_dir).filter("metric = 'vacancy_rate'").join(nations, "geography_id").withColumns({
        "cbsa": F.when(key == 0, F.col("area")), "county_fips": F.when(key == 1, F.col("geography_id")), "definition_id": F.when(key == 2, F.col("property_type")),
        "period": periods.quarter_label("observation_date"),
    })
    values = county_values(spark, sf_dir).filter("feature_name = 'revenue'")
    county = values.select("geography_id", periods.quarter_label("period_start").alias("period"), F.col("value").alias("revenue"), F.col("available_at").alias("revenue__available_at"))
    cbsa = values.join(nations, "geography_id").groupBy(F.col("area").alias("geography_id"), periods.quarter_label("period_start").alias("period")).agg(
        F.sum("value").alias("revenue"), F.max("available_at").alias("revenue__available_at"))
    weights = t.county_weights(inventory(spark, sf_dir)).withColumnRenamed("market_id", "definition_id").drop("basis")
    market = t.weighted_features(weights, values, spark.createDataFrame(RULES[:1], "feature_name string, rule string")).select(
        "definition_id", periods.quarter_label("period_start").alias("period"), F.col("value").alias("revenue"), F.col("available_at").alias("revenue__available_at"))
    joined = t.join_features(targets, cbsa, county, market, ["revenue"]).filter("problem IS NULL")
    return joined.select(
        F.col("geography_id").alias("market_id"), "property_type", F.col("observation_date").alias("period_start"), F.round("value", 6).alias("vacancy_rate"), "feature_geography_type",
        F.round("revenue", 4).alias("revenue"), "revenue__available_at",
    )


def simple_panel(spark, sf_dir):
    rows = b.market_sums(spark, sf_dir, "geography_id")
    return rows.select(
        F.col("geography_id").alias("market_id"), periods.quarter_label("period_start").alias("period"), (F.col("discount_sum").cast("double") / F.col("line_count")).alias("target"),
        F.when(F.col("line_count") > 80, F.col("line_count").cast("double")).alias("activity"), F.date_sub("period_start", (F.col("geography_id").cast("int") % 4) - 1).alias("activity__available_at"),
    )


@query("specification_readiness", "with " + b.SQL_LINES + ", " + b.sql_market_sums("sums", "geography_id") + """,
p as (select geography_id, period_start, case when line_count > 80 then line_count end as activity, period_start - cast((cast(geography_id as integer) % 4) - 1 as integer) as av from sums),
ok as (select * from p where activity is not null and av <= period_start),
d as (select geography_id, count(*) as n from ok group by 1)
select (select count(*) from ok) as complete_observations, (select count(distinct period_start) from ok) as complete_periods, (select count(*) from p where activity is not null and av > period_start) as availability_exclusions,
  round((select count(*) filter (where activity is null) / count(*) from p), 6) as activity__missingness, (select count(*) from d) as complete_markets, (select count(*) from d where n >= 4) as deep_markets,
  case when (select count(*) from ok) >= 30 and (select count(*) from d) >= 3 and (select count(distinct period_start) from ok) >= 4 and (select count(*) from d where n >= 4) >= 3 then 'ready' else 'not_ready' end as status""")
def specification_readiness(spark, sf_dir):
    out = t.specification_readiness(simple_panel(spark, sf_dir), "target", ["activity"], frequency="quarterly", markets=3, periods_minimum=4, sample=30)
    return out.withColumn("activity__missingness", F.round("activity__missingness", 6))


@query("horizon_pairs", "with " + b.SQL_LINES + ", " + b.sql_market_sums("sums", "geography_id") + """,
p as (select geography_id, cast(year(period_start) as varchar) || '-Q' || quarter(period_start) as period, year(period_start) * 4 + quarter(period_start) as idx, cast(discount_sum as double) / line_count as target from sums),
h as (select unnest([1, 2, 4]) as horizon)
select a.geography_id as market_id, a.period, cast(horizon as integer) as horizon, c.period as target_period, round(c.target, 6) as future_target from p a, h join p c on c.geography_id = a.geography_id and c.idx = a.idx + horizon""")
def horizon_pairs(spark, sf_dir):
    rows = simple_panel(spark, sf_dir).select("market_id", "period", "target")
    parts = [t.horizon_pairs(rows, h) for h in (1, 2, 4)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("market_id", "period", "horizon", "target_period", F.round("future_target", 6).alias("future_target"))
