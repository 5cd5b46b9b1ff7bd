"""Descriptive analytics and assumption recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.operators import analytics as a
from parcelflow.operators import assumptions
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query

KEY = "metric, property_type, geography_type, geography_id"
ORDERED = b.SQL_OBSERVATIONS + f""",
ordered as (
  select {KEY}, observation_date, value, row_number() over w - 1 as position, lag(value, 1) over w as previous, lag(value, 4) over w as l4, lag(value, 12) over w as l12,
         max(value) over (w rows between unbounded preceding and current row) as peak, first_value(value) over w as first
  from obs window w as (partition by {KEY} order by observation_date, value))"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(*columns, digits=6):
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


@query("benchmark_matrix", "with " + b.SQL_OBSERVATIONS + f""",
s as (select {KEY}, count(*) as count, min(observation_date) as start_date, max(observation_date) as end_date, min(value) as minimum, max(value) as maximum,
  quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3, min_by(value, observation_date) as first, max_by(value, observation_date) as latest,
  count(distinct observation_date) as periods from obs group by all)
select {KEY}, count, start_date, end_date, {r('minimum', 'maximum', 'q1', 'median', 'q3', 'latest')}, round((latest - first) / greatest(periods - 1, 1), 6) as mean_change_per_period from s""")
def benchmark_matrix(spark, sf_dir):
    out = a.benchmark_matrix(b.market_observations(spark, sf_dir))
    return rounded(out, "minimum", "maximum", "q1", "median", "q3", "latest", "mean_change_per_period")


@query("change_factors", "with " + ORDERED + f"""
select {KEY}, observation_date as period, position + 1 as samples_to_date, factor, round(change, 6) as change from (
  select *, unnest(['period_change', 'period_percent_change', 'change_4_observed_periods', 'change_12_observed_periods']) as factor,
    unnest([value - previous, value / nullif(previous, 0) - 1, value / nullif(l4, 0) - 1, value / nullif(l12, 0) - 1]) as change from ordered) where change is not null""")
def change_factors(spark, sf_dir):
    return rounded(a.change_factors(b.market_observations(spark, sf_dir)), "change")


@query("ts_diagnostics", "with " + ORDERED + f""",
s as (select {KEY}, count(*) as periods, min(observation_date) as start_date, max(observation_date) as end_date, max_by(value, position) as latest,
  coalesce(regr_slope(value, position), 0) as slope, coalesce(avg(value - previous), 0) as mean_change, coalesce(stddev_samp(value - previous), 0) as volatility,
  least(min(coalesce((value - peak) / nullif(abs(peak), 0), 0)), 0) as maximum_drawdown, avg(value) as m, stddev_samp(value) as d from ordered group by all),
z as (select *, case when periods > 1 then (latest - m) / (case when coalesce(d, 0) = 0 then 1 else d end) else 0 end as latest_z_score from s)
select {KEY}, periods, start_date, end_date, {r('latest', 'slope', 'mean_change', 'volatility', 'maximum_drawdown', digits=4)}, round(latest_z_score, 4) as latest_z_score, abs(latest_z_score) >= 3 as latest_is_outlier from z""")
def ts_diagnostics(spark, sf_dir):
    out = a.time_series_diagnostics(b.market_observations(spark, sf_dir))
    return rounded(out, "latest", "slope", "mean_change", "volatility", "maximum_drawdown", "latest_z_score", digits=4)


@query("stress_bands", "with " + ORDERED + f"""
select {KEY}, count(*) as changes, round(min(value - previous), 6) as worst, round(max(value - previous), 6) as best, round(quantile_cont(value - previous, 0.1), 6) as p10,
  round(quantile_cont(value - previous, 0.5), 6) as p50, round(quantile_cont(value - previous, 0.9), 6) as p90 from ordered where previous is not null group by {KEY} having count(*) >= 2""")
def stress_bands(spark, sf_dir):
    return rounded(a.stress_bands(b.market_observations(spark, sf_dir)), "worst", "best", "p10", "p50", "p90")


@query("correlation_pairs", "with " + b.SQL_OBSERVATIONS + """
select l.metric as left_metric, r.metric as right_metric, count(*) as pairs,
  round(case when stddev_pop(l.value) = 0 or stddev_pop(r.value) = 0 then 0 else covar_pop(l.value, r.value) / (stddev_pop(l.value) * stddev_pop(r.value)) end, 6) as correlation
from obs l join obs r on l.observation_date = r.observation_date and l.geography_id = r.geography_id and l.property_type = r.property_type and l.metric < r.metric
group by all having count(*) >= 3""")
def correlation_pairs(spark, sf_dir):
    return rounded(a.correlation_pairs(b.market_observations(spark, sf_dir)), "correlation")


@query("lead_lag", "with " + b.SQL_OBSERVATIONS + """,
placed as (select *, dense_rank() over (partition by property_type, geography_type, geography_id order by observation_date) as p from obs),
per as (
  select l.property_type, l.geography_type, l.geography_id, l.metric as leading_metric, r.metric as lagging_metric, cast(r.p - l.p as integer) as lag, count(*) as pairs,
    case when stddev_pop(l.value) = 0 or stddev_pop(r.value) = 0 then 0 else covar_pop(l.value, r.value) / (stddev_pop(l.value) * stddev_pop(r.value)) end as correlation
  from placed l join placed r on r.property_type = l.property_type and r.geography_id = l.geography_id and l.metric < r.metric and r.p - l.p between -4 and 4 group by all having count(*) >= 4)
select property_type, geography_type, geography_id, leading_metric, lagging_metric, lag as strongest_lag, round(correlation, 5) as correlation, pairs from per
qualify row_number() over (partition by property_type, geography_id, leading_metric, lagging_metric order by round(abs(correlation), 12) desc, lag desc) = 1""")
def lead_lag(spark, sf_dir):
    return rounded(a.lead_lag(b.market_observations(spark, sf_dir)), "correlation", digits=5)


def event_observations(spark, sf_dir):
    """Event values as an irregular daily series per event type and user group."""
    return b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), F.lit("all").alias("property_type"), F.lit("market").alias("geography_type"),
        F.lpad((F.col("user_id") % 50).cast("string"), 5, "0").alias("geography_id"), F.to_date("ts").alias("observation_date"), "value",
    )


SQL_EVENTS = """ev as (
  select event_type as metric, 'all' as property_type, 'market' as geography_type, lpad(cast(user_id % 50 as varchar), 5, '0') as geography_id, cast(ts as date) as observation_date, value from events)"""


@query("cadence_gaps", "with " + SQL_EVENTS + f""",
d as (select distinct {KEY}, observation_date from ev),
g as (select *, observation_date - lag(observation_date) over (partition by {KEY} order by observation_date) as days from d),
t as (select {KEY}, count(days) + 1 as periods, list_sort(list(days) filter (where days is not null)) as ds from g group by {KEY} having count(days) >= 2)
select {KEY}, periods, ds[(len(ds) - 1) // 2 + 1] as typical_gap, list_min(ds) as minimum_gap, list_max(ds) as maximum_gap, len(list_distinct(ds)) > 1 as irregular,
  cast(len(list_filter(ds, lambda x: ds[(len(ds) - 1) // 2 + 1] > 0 and x > ds[(len(ds) - 1) // 2 + 1] * 1.75)) as bigint) as large_gaps from t""")
def cadence_gaps(spark, sf_dir):
    return a.cadence(event_observations(spark, sf_dir))


@query("cadence_large_gaps", "with " + SQL_EVENTS + f""",
d as (select distinct {KEY}, observation_date from ev),
g as (select *, observation_date - lag(observation_date) over w as days, lag(observation_date) over w as after from d window w as (partition by {KEY} order by observation_date)),
t as (select {KEY}, list_sort(list(days) filter (where days is not null)) as ds from g group by {KEY} having count(days) >= 2)
select {KEY}, after, observation_date as before, days from g join t using ({KEY}) where days > ds[(len(ds) - 1) // 2 + 1] * 1.75 and ds[(len(ds) - 1) // 2 + 1] > 0""")
def cadence_large_gaps(spark, sf_dir):
    return a.large_gaps(event_observations(spark, sf_dir))


@query("factor_scorecards", "with " + ORDERED + f""",
s as (select {KEY}, count(*) as periods, max(observation_date) as end_date, max_by(value, position) as latest, max_by(value, position) - min_by(value, position) as momentum,
  avg(value - previous) as mean_change, coalesce(stddev_samp(value - previous), 0) as volatility, sqrt(avg(pow(least(value - previous, 0), 2)) filter (where previous is not null)) as downside_deviation
  from ordered group by {KEY} having count(*) >= 3),
p as (select *, count(*) over (partition by metric, property_type, geography_type) as peers, {', '.join(f"row_number() over (partition by metric, property_type, geography_type order by round({c}, 12), geography_id) - 1 as {c}_r" for c in a.SCORE_FIELDS)} from s)
select {KEY}, periods, end_date, {r(*a.SCORE_FIELDS, digits=4)}, peers, {', '.join(f"round({c}_r / greatest(peers - 1, 1), 6) as {c}_percentile" for c in a.SCORE_FIELDS[:2])} from p""")
def factor_scorecards(spark, sf_dir):
    out = a.factor_scorecards(b.market_observations(spark, sf_dir))
    return rounded(out.drop("mean_change_percentile", "volatility_percentile", "downside_deviation_percentile"), *a.SCORE_FIELDS, digits=4)


SQL_REGIMES = b.SQL_OBSERVATIONS + """,
both_metrics as (
  select property_type, geography_type, geography_id, observation_date, max(value) filter (where metric = 'rent_growth_12m') as growth, max(value) filter (where metric = 'vacancy_rate') as vacancy
  from obs group by all having growth is not null and vacancy is not null),
stepped as (select *, vacancy - lag(vacancy) over (partition by property_type, geography_id order by observation_date) as vacancy_change from both_metrics),
regimes as (select *, case when vacancy_change is null then 'initial' when growth > 0 and vacancy_change <= 0 then 'favorable' when growth < 0 and vacancy_change > 0 then 'adverse' else 'mixed' end as regime from stepped),
chained as (select *, lag(regime) over (partition by property_type, geography_id order by observation_date) as previous_regime from regimes)"""


@query("regimes", "with " + SQL_REGIMES + """
select property_type, geography_type, geography_id, observation_date, round(growth, 6) as growth, round(vacancy, 6) as vacancy, round(vacancy_change, 6) as vacancy_change, regime, previous_regime from chained""")
def regimes(spark, sf_dir):
    return rounded(a.regimes(b.market_observations(spark, sf_dir)), "growth", "vacancy", "vacancy_change")


@query("regime_transitions", "with " + SQL_REGIMES + """
select property_type, geography_type, geography_id, previous_regime || '->' || regime as transition, count(*) as count from chained where previous_regime is not null group by all""")
def regime_transitions(spark, sf_dir):
    return a.regime_transitions(b.market_observations(spark, sf_dir))


@query("baseline_backtest", "with " + ORDERED + f""",
f as (select {KEY}, observation_date, value, previous, unnest(['persistence', 'mean_change']) as baseline,
        unnest([previous, previous + (previous - first) / nullif(position - 1, 0)]) as forecast from ordered where position >= 3)
select {KEY}, baseline, count(*) as tests, min(observation_date) as test_start, max(observation_date) as test_end, round(avg(abs(value - forecast)), 5) as mae,
  round(sqrt(avg(pow(value - forecast, 2))), 5) as rmse, round(avg(value - forecast), 5) as bias, round(avg(((forecast - previous) * (value - previous) > 0)::int), 6) as directional_accuracy
from f group by all""")
def baseline_backtest(spark, sf_dir):
    out = a.baseline_backtest(b.market_observations(spark, sf_dir))
    return rounded(rounded(out, "directional_accuracy"), "mae", "rmse", "bias", digits=5)


def snapshots_of(spark, sf_dir):
    """Line discounts as snapshot observations: one snapshot per source and return flag."""
    return b.order_lines(spark, sf_dir).select(
        F.lit("vacancy_rate").alias("metric"), F.to_date(F.date_trunc("month", "o_date")).alias("observation_date"), F.lit("market").alias("geography_type"), "geography_id", "property_type",
        F.lit(None).cast("string").alias("property_subtype"), F.concat_ws("/", "o_orderpriority", "l_returnflag").alias("snapshot_id"), F.col("o_orderpriority").alias("source_label"),
        F.col("l_discount").alias("value"), F.when(F.col("l_tax") < 0.03, "high").otherwise("moderate").alias("quality_level"), (F.col("l_quantity") > 48).alias("invalid"),
    )


SQL_SNAPSHOTS = b.SQL_LINES + """,
snap as (
  select 'vacancy_rate' as metric, cast(date_trunc('month', o_date) as date) as observation_date, 'market' as geography_type, geography_id, property_type, o_orderpriority || '/' || l_returnflag as snapshot_id,
    o_orderpriority as source_label, l_discount as value, case when l_tax < 0.03::double then 'high' else 'moderate' end as quality_level, l_quantity > 48 as invalid from lines)"""


@query("revision_conflicts", "with " + SQL_SNAPSHOTS + """
select metric, observation_date, geography_type, geography_id, property_type, cast(null as varchar) as property_subtype, count(distinct snapshot_id) as snapshots, count(distinct source_label) as sources,
  count(distinct value) as distinct_values, min(value) as minimum, max(value) as maximum, round(max(value) - min(value), 6) as absolute_spread,
  round((max(value) - min(value)) / nullif(abs(min(value)), 0), 6) as relative_spread, count(distinct value) > 1 as conflict
from snap group by metric, observation_date, geography_type, geography_id, property_type having count(distinct snapshot_id) >= 2""")
def revision_conflicts(spark, sf_dir):
    return rounded(a.revision_conflicts(snapshots_of(spark, sf_dir)), "absolute_spread", "relative_spread")


@query("profile_observations", "with " + SQL_SNAPSHOTS + """
select metric, count(*) as observations, count(distinct observation_date) as periods, min(observation_date) as start_date, max(observation_date) as end_date,
  count(distinct geography_id) as geographies, count(distinct source_label) as sources, min(value) as minimum, max(value) as maximum, true as stale from snap group by metric""")
def profile_observations(spark, sf_dir):
    return a.profile_metrics(snapshots_of(spark, sf_dir), "2024-01-01")


@query("assumption_coverage", "with " + b.SQL_OBSERVATIONS + """,
catalog(assumption, metric) as (values """ + ", ".join(f"('{n}', '{m}')" for n, m, _, _ in assumptions.CATALOG) + """)
select assumption, metric, count(value) > 0 as available, count(value) as observations from catalog left join obs using (metric) group by all""")
def assumption_coverage(spark, sf_dir):
    return a.assumption_coverage(b.market_observations(spark, sf_dir), assumptions.catalog(spark))


@query("source_scorecards", "with " + SQL_SNAPSHOTS + """,
names as (select distinct o_orderpriority || '/' || f as snapshot_id from orders, (select unnest(['A', 'N', 'R', 'X']) as f))
select snapshot_id, count(value) as observations, count(distinct metric) as metrics, count(distinct geography_id) as geographies, count(distinct property_type) as property_types,
  count(*) filter (where quality_level = 'high') as high_quality, count(*) filter (where invalid) as invalid_observations from names left join snap using (snapshot_id) group by all""")
def source_scorecards(spark, sf_dir):
    flags = F.explode(F.array(*[F.lit(f) for f in ("A", "N", "R", "X")]))
    names = b.table(spark, sf_dir, "orders").select("o_orderpriority").distinct().withColumn("flag", flags)
    return a.source_scorecards(snapshots_of(spark, sf_dir), names.select(F.concat_ws("/", "o_orderpriority", "flag").alias("snapshot_id")))


def deal_contexts(spark, sf_dir):
    """Every customer is a deal looking for evidence in its own nation, region and segment."""
    customers = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    market = F.lpad(F.col("c_nationkey").cast("string"), 5, "0")
    key = F.col("c_custkey") % 5
    none = F.lit(None).cast("string")
    return customers.select(
        F.col("c_custkey").alias("deal_id"), F.lower("c_mktsegment").alias("property_type"), none.alias("property_subtype"), none.alias("submarket"),
        F.when(key == 0, market).alias("market_id"), F.when(key == 1, F.col("n_regionkey").cast("string")).alias("cbsa"), F.when(key == 2, F.lit("00")).alias("state_fips"),
    )


def deal_observations(spark, sf_dir):
    nations = b.table(spark, sf_dir, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geography_id"), F.col("n_regionkey").cast("string").alias("cbsa")
    )
    none = F.lit(None).cast("string")
    return b.market_observations(spark, sf_dir).join(nations, "geography_id").withColumns({
        "submarket": none, "property_subtype": none, "county_fips": F.col("geography_id"),
    })


@query("fallback_recommendation", "with " + b.SQL_OBSERVATIONS + """,
o as (select obs.*, cast(n_regionkey as varchar) as cbsa from obs join nation on lpad(cast(n_nationkey as varchar), 5, '0') = geography_id),
catalog(assumption, metric, preferred) as (values """ + ", ".join(f"('{n}', '{m}', {p})" for n, m, _, p in assumptions.CATALOG) + """),
stats as (
  select metric, level, k, count(*) as samples, count(distinct observation_date) as periods, min(observation_date) as first_date, max(observation_date) as latest_date,
    max_by(value, (observation_date, value)) as most_recent, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3
  from (select *, unnest([2, 3, 4, 5]) as level, unnest([geography_id || property_type, cbsa || property_type, substr(geography_id, 1, 2) || property_type, property_type]) as k from o) group by all),
deals as (
  select c_custkey as deal_id, unnest([2, 3, 4, 5]) as level, unnest([case when c_custkey % 5 = 0 then lpad(cast(c_nationkey as varchar), 5, '0') || lower(c_mktsegment) end,
    case when c_custkey % 5 = 1 then n_regionkey || lower(c_mktsegment) end, case when c_custkey % 5 = 2 then '00' || lower(c_mktsegment) end, lower(c_mktsegment)]) as k
  from customer join nation on c_nationkey = n_nationkey),
picked as (
  select deal_id, assumption, s.*, preferred from deals d join stats s on s.level = d.level and s.k = d.k join catalog c on c.metric = s.metric
  qualify row_number() over (partition by deal_id, assumption order by s.level) = 1),
scored as (select *, least(1::double, periods / preferred) as completeness, case when date '2002-01-01' - latest_date <= 120 then 1::double when date '2002-01-01' - latest_date <= 365 then 0.75::double
    when date '2002-01-01' - latest_date <= 730 then 0.4::double else 0.1::double end as freshness, level >= 4 as out_of_domain from picked)
select deal_id, assumption, (['', '', 'exact_market_property_type', 'cbsa_property_type', 'state_property_type', 'national_property_type'])[level + 1] as fallback_level, samples,
  round(q1, 6) as low, round(q2, 6) as base, round(q3, 6) as high, first_date, latest_date, round(completeness, 6) as completeness, freshness, out_of_domain from scored""")
def fallback_recommendation(spark, sf_dir):
    out = assumptions.recommend(deal_contexts(spark, sf_dir), deal_observations(spark, sf_dir), "2002-01-01")
    return rounded(out, "low", "base", "high", "completeness").drop("most_recent", "confidence", "confidence_score")


@query("assumption_confidence", "with " + b.SQL_OBSERVATIONS + """,
s as (select metric, property_type, geography_id, count(*) as n, count(distinct observation_date) as p, max(observation_date) as latest from obs group by all),
c as (select *, case when date '2002-01-01' - latest <= 120 then 1::double when date '2002-01-01' - latest <= 365 then 0.75::double when date '2002-01-01' - latest <= 730 then 0.4::double else 0.1::double end as fresh,
  least(1::double, n / 24) as size from s),
t as (select *, round(size, 4) * 0.15::double + round(least(1::double, p / 12), 4) * 0.15::double + fresh * 0.15::double + 0.9::double * 0.15::double + 0.85::double * 0.15::double + 0.75::double * 0.10::double + 0.05::double as total from c)
select metric, property_type, geography_id, round(total, 4) as score, case when total >= 0.55::double then 'moderate' else 'low' end as label from t""")
def assumption_confidence(spark, sf_dir):
    stats = b.market_observations(spark, sf_dir).groupBy("metric", "property_type", "geography_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("observation_date").alias("p"), F.max("observation_date").alias("latest")
    )
    as_of = F.lit("2002-01-01").cast("date")
    scored = assumptions.confidence(
        F.col("n"), F.least(F.lit(1.0), F.col("p") / 12), assumptions.freshness(F.col("latest"), as_of), F.lit(0.9), F.lit(0.85), F.lit(0.75), F.lit(0.0), F.lit(1.0), F.lit(False)
    )
    return stats.select("metric", "property_type", "geography_id", scored["score"].alias("score"), scored["label"].alias("label"))


@query("model_blend", "with " + b.SQL_OBSERVATIONS + """,
s as (select property_type, geography_id, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3, max_by(value, (observation_date, value)) as most_recent,
  avg(value) as estimate, stddev_pop(value) as model_mae, 3 * stddev_pop(value) as baseline_mae, 2 * stddev_pop(value) as holdout_mae from obs where metric = 'vacancy_rate' group by all),
q as (select *, round(least(1::double, least(1::double, coalesce((baseline_mae - model_mae) / nullif(baseline_mae, 0), 0) * 2) * 0.55::double + least(1::double, coalesce(model_mae / nullif(holdout_mae, 0), 0)) * 0.25::double
   + case when cast(geography_id as integer) % 2 = 0 then 0.10::double else 0 end + 0.10::double), 12) as score from s),
t as (select *, case when score >= 0.75::double then 'strong' when score >= 0.45::double then 'moderate' else 'weak' end as tier from q),
w as (select *, case tier when 'strong' then 0.45::double when 'moderate' then 0.35::double else 0.20::double end * estimate
   + case tier when 'strong' then 0.40::double when 'moderate' then 0.45::double else 0.55::double end * median
   + case tier when 'strong' then 0.15::double when 'moderate' then 0.20::double else 0.25::double end * most_recent as base from t)
select property_type, geography_id, tier, round(base, 6) as base, round(least(q1, estimate, base - model_mae), 6) as downside, round(greatest(q3, estimate, base + model_mae), 6) as upside from w""")
def model_blend(spark, sf_dir):
    """Vacancy forecasts per market and segment blended with history; weights depend on the tier."""
    from parcelflow.functions import keyed

    rows = b.market_observations(spark, sf_dir).filter("metric = 'vacancy_rate'")
    key = ["property_type", "geography_id"]
    spread = F.stddev_pop("value")
    stats = rows.groupBy(*key).agg(
        F.max_by("value", F.struct("observation_date", "value")).alias("most_recent"), F.avg("value").alias("estimate"), spread.alias("model_mae"),
        (3 * spread).alias("baseline_mae"), (2 * spread).alias("holdout_mae"),
    ).join(keyed.grouped_quantiles(rows, key, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), key)
    none = F.lit(None).cast("double")
    forecasts = stats.withColumns({
        "segment": F.col("property_type"), "property_type": F.lit("multifamily"), "assumption": F.lit("vacancy"), "stable": F.col("geography_id").cast("int") % 2 == 0,
        "cross_checks_ok": F.lit(True), "forecast_low": none, "forecast_high": none,
    })
    out = rounded(assumptions.blend(forecasts), "base", "downside", "upside")
    return out.select(F.col("segment").alias("property_type"), "geography_id", "tier", "base", "downside", "upside")


@query("promotion_evidence", """
select o_orderpriority, count(*) as models, count(*) filter (where o_orderstatus = 'F' and o_orderkey % 3 <> 0) as not_real, count(*) filter (where o_orderstatus = 'F' and o_totalprice < 100000) as no_hash,
  count(*) filter (where o_orderstatus <> 'F' or (o_orderkey % 3 = 0 and o_totalprice >= 100000)) as complete from orders group by all""")
def promotion_evidence(spark, sf_dir):
    """Orders as model rows; finished ones claim validation."""
    hashes = F.array(F.sha2(F.col("o_orderkey").cast("string"), 256))
    models = b.table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "validated").otherwise("research").alias("validation_state"),
        F.when(F.col("o_orderkey") % 3 == 0, "real").otherwise("research").alias("data_status"), F.lit("validated").alias("governance_status"),
        F.lit(True).alias("eligible_for_controlling_forecast"), F.lit("passed").alias("reference_status"), F.lit("passed").alias("cross_check_status"),
        hashes.alias("source_manifest_hashes"), hashes.alias("target_dataset_hashes"), F.lit("h").alias("feature_table_hash"),
        F.when(F.col("o_totalprice") >= 100000, "h").alias("model_result_hash"), F.lit(True).alias("candidate_only"), F.lit(True).alias("analyst_approval_required"),
    )
    judged = assumptions.promotion_evidence(models)
    has = lambda code: F.count_if(F.array_contains("missing_evidence", code))
    return judged.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("models"), has("real data").alias("not_real"), has("model result hash").alias("no_hash"), F.count_if(F.size("missing_evidence") == 0).alias("complete")
    )
