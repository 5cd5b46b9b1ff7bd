"""Panel regression queries on nation-quarter panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import periods
from parcelflow.operators import stats
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query
from parcelflow.session import checkpointed

FEATURES = ["rent", "tax"]


def panel(spark, sf_dir):
    """Nation-quarter panel: discount rate explained by rent and tax, with release dates."""
    rows = b.market_sums(spark, sf_dir, "geography_id").select(
        F.col("geography_id").alias("market_id"), periods.quarter_label("period_start").alias("period"), F.lit("multifamily").alias("property_type"),
        (F.col("discount_sum").cast("double") / F.col("line_count")).alias("target"),
        (F.col("price_sum").cast("double") / F.col("quantity_sum").cast("double") / 1000).alias("rent"), (F.col("tax_sum").cast("double") / F.col("line_count") * 10).alias("tax"),
        F.date_add(F.last_day(F.add_months("period_start", 2)), (F.col("geography_id").cast("int") * 7) % 120).alias("target_available_at"),
        F.when(F.col("geography_id") < "00010", "north").otherwise("south").alias("source_company"),
    )
    return stats.prepare_panel(rows, "target", FEATURES)


SQL_PANEL = b.SQL_LINES + ",\n" + b.sql_market_sums("sums", "geography_id") + """,
panel as (
  select geography_id as entity, cast(year(period_start) as varchar) || '-Q' || quarter(period_start) as label, cast(year(period_start) * 4 + quarter(period_start) - 1 as integer) as idx,
    cast(discount_sum as double) / line_count as target, cast(price_sum as double) / cast(quantity_sum as double) / 1000 as rent, cast(tax_sum as double) / line_count * 10 as tax,
    last_day(cast(period_start + interval 2 month as date)) + cast((cast(geography_id as integer) * 7) % 120 as integer) as target_available_at, period_start,
    case when geography_id < '00010' then 'north' else 'south' end as source_company from sums)"""


def _ols_sql(source, group=None):
    """Two-feature least squares in closed form."""
    g = f"{group}, " if group else ""
    by = f"group by {group}" if group else ""
    return f"""m as (select {g}count(*) as n, var_pop(rent) as sxx, var_pop(tax) as szz, covar_pop(rent, tax) as sxz, covar_pop(rent, target) as sxy, covar_pop(tax, target) as szy,
    avg(rent) as mx, avg(tax) as mz, avg(target) as my from {source} {by}),
fit as (select *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) as b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) as b2 from m)"""


@query("prepare_panel", "with " + SQL_PANEL + " select entity, label, idx, round(target, 6) as target, round(rent, 6) as rent, round(tax, 6) as tax from panel")
def prepare_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("entity", "label", "idx", *[F.round(c, 6).alias(c) for c in ("target", "rent", "tax")])


@query("panel_findings", "with " + SQL_PANEL + " select cast(0 as bigint) as duplicate_keys, count(*) as keys, false as mixed_property_types from panel")
def panel_findings(spark, sf_dir):
    return stats.panel_findings(panel(spark, sf_dir))


@query("ols_pooled", "with " + SQL_PANEL + ", " + _ols_sql("panel") + """,
e as (select sum(pow(target - my - b1 * (rent - mx) - b2 * (tax - mz), 2)) as sse, sum(pow(target - my, 2)) as sst, any_value(n) as n, any_value(b1) as b1, any_value(b2) as b2, any_value(my - b1 * mx - b2 * mz) as b0,
  any_value(sxx) as sxx, any_value(szz) as szz, any_value(sxz) as sxz from panel, fit)
select term, round(coefficient, 6) as coefficient, round(se, 6) as standard_error, n, cast(3 as bigint) as parameters, round(1 - sse / sst, 6) as r_squared from (
  select *, unnest(['rent', 'tax', 'intercept']) as term, unnest([b1, b2, b0]) as coefficient,
    unnest([sqrt(sse / (n - 3) * szz / (n * (sxx * szz - sxz * sxz))), sqrt(sse / (n - 3) * sxx / (n * (sxx * szz - sxz * sxz))), null]) as se from e) where term <> 'intercept'""")
def ols_pooled(spark, sf_dir):
    fit = stats.fit_ols(panel(spark, sf_dir), "target", FEATURES, covariance="classical").filter("term <> 'intercept'")
    return fit.select("term", F.round("coefficient", 6).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"), "n", "parameters", F.round("r_squared", 6).alias("r_squared"))


SQL_WITHIN = """,
within as (select entity, label, target - avg(target) over (partition by entity) as target, rent - avg(rent) over (partition by entity) as rent, tax - avg(tax) over (partition by entity) as tax from panel)"""


@query("ols_entity_fe", "with " + SQL_PANEL + SQL_WITHIN + ", " + _ols_sql("within") + """
select term, round(coefficient, 6) as coefficient, n, (select count(distinct entity) from panel) + 2 as parameters from (select n, unnest(['rent', 'tax']) as term, unnest([b1, b2]) as coefficient from fit)""")
def ols_entity_fe(spark, sf_dir):
    fit = stats.fit_ols(panel(spark, sf_dir), "target", FEATURES, entity_effects=True, covariance="hc1")
    return fit.select("term", F.round("coefficient", 6).alias("coefficient"), "n", "parameters")


@query("ols_cluster_se", "with " + SQL_PANEL + """,
w as (select entity, target - avg(target) over (partition by entity) as y, rent - avg(rent) over (partition by entity) as x from panel),
f as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as sxx, count(*) as n, count(distinct entity) as g from w),
s as (select entity, sum(x * (y - beta * x)) as score from w, f group by entity)
select round(any_value(beta), 6) as coefficient, round(sqrt(sum(score * score) / pow(any_value(sxx), 2) * (any_value(g) / (any_value(g) - 1)) * ((any_value(n) - 1) / (any_value(n) - any_value(g) - 1))), 6) as standard_error from s, f""")
def ols_cluster_se(spark, sf_dir):
    fit = stats.fit_ols(panel(spark, sf_dir), "target", ["rent"], entity_effects=True, covariance="cluster_entity")
    return fit.select(F.round("coefficient", 6).alias("coefficient"), F.round("standard_error", 6).alias("standard_error"))


@query("ols_by_source", "with " + SQL_PANEL + ", " + _ols_sql("panel", "source_company") + """
select source_company, term, round(coefficient, 6) as coefficient, n from (select source_company, n, unnest(['rent', 'tax', 'intercept']) as term, unnest([b1, b2, my - b1 * mx - b2 * mz]) as coefficient from fit)""")
def ols_by_source(spark, sf_dir):
    fit = stats.fit_ols(panel(spark, sf_dir), "target", FEATURES, group=["source_company"])
    return fit.select("source_company", "term", F.round("coefficient", 6).alias("coefficient"), "n")


@query("ols_predict", "with " + SQL_PANEL + ", " + _ols_sql("panel", "source_company") + """
select p.entity, p.label, round(my + b1 * (rent - mx) + b2 * (tax - mz), 6) as prediction from panel p join fit f using (source_company)""")
def ols_predict(spark, sf_dir):
    rows = panel(spark, sf_dir)
    fit = stats.fit_ols(rows, "target", FEATURES, group=["source_company"])
    return stats.predict(rows, fit, FEATURES, ["source_company"]).select("entity", "label", F.round("prediction", 6).alias("prediction"))


@query("entity_effects", "with " + SQL_PANEL + """,
w as (select entity, source_company, target - avg(target) over (partition by entity) as y, rent - avg(rent) over (partition by entity) as x from panel),
f as (select source_company, sum(x * y) / sum(x * x) as beta from w group by source_company)
select entity, round(avg(target) - any_value(beta) * avg(rent), 6) as effect from panel join f using (source_company) group by entity""")
def entity_effects(spark, sf_dir):
    rows = panel(spark, sf_dir)
    fit = stats.fit_ols(rows, "target", ["rent"], group=["source_company"], entity_effects=True)
    return stats.entity_effects(rows, fit, "target", ["rent"], ["source_company"]).select("entity", F.round("effect", 6).alias("effect"))


@query("regression_diagnostics", "with " + SQL_PANEL + """,
c as (select count(*) as sample_size, corr(rent, tax) as rt, corr(rent, target) as ry, corr(tax, target) as ty from panel)
select sample_size, left_name, right_name, round(correlation, 6) as correlation, round(vif, 6) as vif from (
  select sample_size, unnest(['rent','rent','rent','tax','tax','tax','target','target','target']) as left_name, unnest(['rent','tax','target','rent','tax','target','rent','tax','target']) as right_name,
    unnest([1, rt, ry, rt, 1, ty, ry, ty, 1]) as correlation, unnest([1 / (1 - rt * rt), null, null, null, 1 / (1 - rt * rt), null, null, null, null]) as vif from c)""")
def regression_diagnostics(spark, sf_dir):
    out = stats.diagnostics(panel(spark, sf_dir), "target", FEATURES)
    return out.withColumns({"correlation": F.round("correlation", 6), "vif": F.round("vif", 6)})


SQL_TRAIN = SQL_PANEL + """,
grid as (select idx as origin, min(period_start) as origin_start from panel group by idx),
origins as (select * from grid qualify row_number() over (order by origin) > 4),
train as (select o.origin, p.* from origins o join panel p on p.idx < o.origin and p.target_available_at <= o.origin_start)"""

SQL_FORWARD = SQL_TRAIN + """,
tw as (select origin, entity, target - avg(target) over w as y, rent - avg(rent) over w as x from train window w as (partition by origin, entity)),
beta as (select origin, sum(x * y) / sum(x * x) as b from tw group by origin),
hist as (select origin, entity, avg(target) as ym, avg(rent) as xm, max_by(target, idx) as last, list(target order by idx) as h from train group by all),
med as (select origin, median(target) as med from train group by origin),
pairs as (select origin, entity, target as y, lag(target) over (partition by origin, entity order by idx) as x from train),
ar as (select origin, case when count(x) >= 3 then coalesce(regr_slope(y, x), 0) else 1 end as slope, case when count(x) >= 3 then avg(y) filter (where x is not null) - coalesce(regr_slope(y, x), 0) * avg(x) else 0 end as icept from pairs group by origin),
peer as (select a.origin, a.entity, median(b.last) as peer from hist a join hist b on a.origin = b.origin and a.entity <> b.entity group by all),
tests as (
  select p.entity, p.label, p.target as actual, last as prior_actual, ym + b * (rent - xm) as model, last as last_observation, ym as entity_mean, med as historical_median,
    list_avg(h[greatest(len(h) - 11, 1):len(h)]) as recent_3_year_mean, coalesce(peer, med) as peer_market_median, icept + slope * last as simple_autoregressive
  from panel p join hist t on t.origin = p.idx and t.entity = p.entity join beta on beta.origin = p.idx join med on med.origin = p.idx join ar on ar.origin = p.idx
  left join peer on peer.origin = p.idx and peer.entity = p.entity),
long as (from tests unpivot (prediction for method in (model, last_observation, entity_mean, historical_median, recent_3_year_mean, peer_market_median, simple_autoregressive)))"""


def forward(spark, sf_dir):
    return stats.walk_forward(panel(spark, sf_dir), "target", ["rent"])


@query("walk_forward", "with " + SQL_FORWARD + " select entity, label, method, round(prediction, 6) as prediction, round(actual, 6) as actual, round(prior_actual, 6) as prior_actual from long")
def walk_forward(spark, sf_dir):
    return forward(spark, sf_dir).select("entity", "label", "method", *[F.round(c, 6).alias(c) for c in ("prediction", "actual", "prior_actual")])


@query("wf_baselines", "with " + SQL_FORWARD + """
select method, count(*) as sample_size, round(avg(abs(actual - prediction)), 6) as mae, round(sqrt(avg(pow(actual - prediction, 2))), 6) as rmse, round(avg(actual - prediction), 6) as bias from long group by method""")
def wf_baselines(spark, sf_dir):
    metrics = stats.prediction_metrics(forward(spark, sf_dir), ["method"])
    return metrics.select("method", "sample_size", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


@query("market_holdout", "with " + SQL_PANEL + """,
f as (select e.entity, regr_slope(p.target, p.rent) as b, regr_intercept(p.target, p.rent) as a from (select distinct entity from panel) e join panel p on p.entity <> e.entity group by e.entity)
select entity, label, round(target, 6) as actual, round(a + b * rent, 6) as prediction, round(lag(target) over (partition by entity order by idx), 6) as prior_actual from panel join f using (entity)""")
def market_holdout(spark, sf_dir):
    out = stats.market_holdout(checkpointed(panel(spark, sf_dir)), "target", ["rent"])
    return out.select("entity", "label", *[F.round(c, 6).alias(c) for c in ("actual", "prediction", "prior_actual")])


@query("lag_search", "with " + SQL_PANEL + """,
l as (select k.lag, p.entity, p.idx, p.target, q.rent as x from panel p, (select unnest([0, 1, 2]) as lag) k join panel q on q.entity = p.entity and q.idx = p.idx - k.lag)
select cast(lag as integer) as lag, round(corr(x, target), 6) as correlation, count(*) as observations from l group by lag""")
def lag_search(spark, sf_dir):
    rows = stats.lagged(panel(spark, sf_dir), "rent", [0, 1, 2]).filter("lagged IS NOT NULL")
    return rows.groupBy("lag").agg(F.round(stats.numbers.safe_corr("lagged", "target"), 6).alias("correlation"), F.count(F.lit(1)).alias("observations"))


SQL_LAGGED = SQL_PANEL + """,
lp as (select k.lag, p.entity, p.idx, p.label, p.target, p.target_available_at, p.period_start, q.rent as x from panel p, (select unnest([0, 1, 2]) as lag) k join panel q on q.entity = p.entity and q.idx = p.idx - k.lag),
grid as (select lag, idx as origin, min(period_start) as origin_start from lp group by lag, idx),
origins as (select * from grid qualify row_number() over (partition by lag order by origin) > 4),
train as (select o.origin, p.* from origins o join lp p on p.lag = o.lag and p.idx < o.origin and p.target_available_at <= o.origin_start),
tw as (select lag, origin, entity, target - avg(target) over w as yd, x - avg(x) over w as xd from train window w as (partition by lag, origin, entity)),
beta as (select lag, origin, sum(xd * yd) / sum(xd * xd) as b from tw group by lag, origin),
hist as (select lag, origin, entity, avg(target) as ym, avg(x) as xm, max_by(target, idx) as last, list(target order by idx) as h from train group by all),
med as (select lag, origin, median(target) as med from train group by lag, origin),
pairs as (select lag, origin, entity, target as y, lag(target) over (partition by lag, origin, entity order by idx) as z from train),
ar as (select lag, origin, case when count(z) >= 3 then coalesce(regr_slope(y, z), 0) else 1 end as slope, case when count(z) >= 3 then avg(y) filter (where z is not null) - coalesce(regr_slope(y, z), 0) * avg(z) else 0 end as icept from pairs group by lag, origin),
peer as (select a.lag, a.origin, a.entity, median(b.last) as peer from hist a join hist b on a.lag = b.lag and a.origin = b.origin and a.entity <> b.entity group by all),
tests as (
  select p.lag, p.target as actual, ym + b * (p.x - xm) as model, last as last_observation, ym as entity_mean, med as historical_median, list_avg(h[greatest(len(h) - 11, 1):len(h)]) as recent_3_year_mean,
    coalesce(peer, med) as peer_market_median, icept + slope * last as simple_autoregressive
  from lp p join hist t on t.lag = p.lag and t.origin = p.idx and t.entity = p.entity join beta b on b.lag = p.lag and b.origin = p.idx
    join med m on m.lag = p.lag and m.origin = p.idx join ar r on r.lag = p.lag and r.origin = p.idx
  left join peer on peer.lag = p.lag and peer.origin = p.idx and peer.entity = p.entity),
errors as (select lag, method, avg(abs(actual - prediction)) as mae, count(*) as n from (from tests unpivot (prediction for method in (model, last_observation, entity_mean, historical_median, recent_3_year_mean, peer_market_median, simple_autoregressive))) group by all)"""


@query("lag_search_ranked", "with " + SQL_LAGGED + """
select cast(e.lag as integer) as lag, round(max(mae) filter (where method = 'model'), 6) as model_mae, round(min(mae) filter (where method <> 'model'), 6) as best_baseline_mae,
  max(n) filter (where method = 'model') as sample_size, round(any_value(c), 6) as correlation, max(mae) filter (where method = 'model') < min(mae) filter (where method <> 'model') as beats_baseline
from errors e join (select lag, corr(x, target) as c from lp group by lag) k on k.lag = e.lag group by e.lag""")
def lag_search_ranked(spark, sf_dir):
    out = stats.lag_search(panel(spark, sf_dir), "target", "rent", [0, 1, 2])
    return out.withColumns({c: F.round(c, 6) for c in ("model_mae", "best_baseline_mae", "correlation")})


@query("stability", "with " + SQL_PANEL + """,
o as (select idx, row_number() over (order by idx) - 1 as pos, count(*) over () as n from panel group by idx),
starts as (select idx as window_start from o where pos in (0, n // 4, n // 2)),
w as (select window_start, target - avg(target) over v as y, rent - avg(rent) over v as x from starts join panel on idx >= window_start window v as (partition by window_start, entity))
select window_start, 'rent' as term, round(sum(x * y) / sum(x * x), 6) as coefficient, count(*) as n from w group by window_start""")
def stability(spark, sf_dir):
    return stats.stability(checkpointed(panel(spark, sf_dir)), "target", ["rent"]).withColumn("coefficient", F.round("coefficient", 6))


@query("sign_stability", "with " + SQL_PANEL + """,
o as (select list(idx order by idx) as a from (select distinct idx from panel)), s as (select distinct unnest([a[1], a[len(a) // 4 + 1], a[len(a) // 2 + 1]]) as window_start from o),
w as (select window_start, rent - avg(rent) over g as rent, tax - avg(tax) over g as tax, target - avg(target) over g as target from panel join s on idx >= window_start window g as (partition by window_start, entity)),
""" + _ols_sql("w", "window_start") + """,
t as (select unnest(['rent', 'tax']) as term, unnest([b1, b2]) as coefficient from fit)
select term, count(*) as windows, round(min(coefficient), 6) as minimum, round(max(coefficient), 6) as maximum, min(sign(coefficient)) = max(sign(coefficient)) as sign_consistent from t group by term""")
def sign_stability(spark, sf_dir):
    out = stats.sign_stability(stats.stability(checkpointed(panel(spark, sf_dir)), "target", FEATURES))
    return out.withColumns({c: F.round(c, 6) for c in ("minimum", "maximum")})


SQL_CROSS = SQL_PANEL + """,
f as (select source_company as train_source, regr_slope(target, rent) as b, regr_intercept(target, rent) as a from panel group by 1),
crossed as (select train_source, source_company as test_source, entity, label, target as actual, a + b * rent as prediction from panel join f on train_source <> source_company)"""


@query("cross_source", "with " + SQL_CROSS + " select train_source, test_source, entity, label, round(actual, 6) as actual, round(prediction, 6) as prediction from crossed")
def cross_source(spark, sf_dir):
    out = stats.cross_source(checkpointed(panel(spark, sf_dir)), "target", ["rent"])
    return out.select("train_source", "test_source", "entity", "label", F.round("actual", 6).alias("actual"), F.round("prediction", 6).alias("prediction"))


@query("company_bias", "with " + SQL_CROSS + " select test_source, count(*) as observations, round(avg(actual - prediction), 6) as mean_residual from crossed group by test_source")
def company_bias(spark, sf_dir):
    return stats.company_bias(stats.cross_source(checkpointed(panel(spark, sf_dir)), "target", ["rent"])).withColumn("mean_residual", F.round("mean_residual", 6))


@query("forecast", "with " + SQL_CROSS + """,
e as (select quantile_cont(actual - prediction, 0.25) as lo, quantile_cont(actual - prediction, 0.75) as hi from crossed), p as (select regr_slope(target, rent) as b, regr_intercept(target, rent) as a from panel)
select entity, label, round(a + b * rent, 6) as estimate, round(b * rent, 6) as contribution, round(a + b * rent + lo, 6) as low, round(a + b * rent + hi, 6) as high from panel, p, e""")
def forecast(spark, sf_dir):
    rows = checkpointed(panel(spark, sf_dir))
    out = stats.forecast(rows, stats.fit_ols(rows, "target", ["rent"]), stats.cross_source(rows, "target", ["rent"]), ["rent"])
    return out.select("entity", "label", F.round("estimate", 6).alias("estimate"), F.round("rent__contribution", 6).alias("contribution"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("promotion_gates", "with " + SQL_PANEL + """
select source_company, case when count(*) < 400 then 'rejected' else 'research' end as status, case when count(*) < 400 then 'sample_size_below_minimum' else '' end as failures from panel group by source_company""")
def promotion_gates(spark, sf_dir):
    rows = panel(spark, sf_dir)
    models = rows.groupBy("source_company").agg(F.count(F.lit(1)).alias("sample_size"), F.countDistinct("entity").alias("markets"), F.countDistinct("label").alias("periods")).withColumns({
        "deep_markets": F.col("markets"), "look_ahead": F.lit(False), "predictions": F.lit(1), "model_mae": F.lit(0.1), "baseline_mae": F.lit(0.2), "holdout_predictions": F.lit(1),
        "severe_instability": F.lit(False), "data_status": F.lit("research"), "model_mode": F.lit("ad_hoc_research"),
    })
    out = stats.promotion_gates(models, minimum_sample=400)
    return out.select("source_company", "status", F.array_join("failures", ",").alias("failures"))


@query("simple_lm", "with " + SQL_PANEL + """,
f as (select regr_slope(target, rent) as b, regr_intercept(target, rent) as a from panel)
select term, round(coefficient, 6) as coefficient, (select round(sqrt(avg(pow(target - a - b * rent, 2))), 6) from panel, f) as rmse from (select unnest(['rent', 'intercept']) as term, unnest([b, a]) as coefficient from f)""")
def simple_lm(spark, sf_dir):
    fit = stats.fit_ols(panel(spark, sf_dir), "target", ["rent"], covariance="classical")
    return fit.select("term", F.round("coefficient", 6).alias("coefficient"), F.round("rmse", 6).alias("rmse"))


@query("reproduce_models", "with " + SQL_PANEL + " select distinct source_company, source_company = 'north' as reproduced from panel")
def reproduce_models(spark, sf_dir):
    """Stored digests of both source models; one was stored wrong."""
    rows = panel(spark, sf_dir)
    digests = stats.result_digest(stats.fit_ols(rows, "target", FEATURES, group=["source_company"]), ["source_company"])
    stored = digests.withColumn("digest", F.when(F.col("source_company") == "north", F.col("digest")).otherwise("stale"))
    return stats.reproduce(rows, "target", FEATURES, stored, ["source_company"]).select("source_company", "reproduced")


@query("ols_two_way", "with " + SQL_PANEL + """,
w as (select target - avg(target) over (partition by entity) - avg(target) over (partition by label) + avg(target) over () as y, rent - avg(rent) over (partition by entity) - avg(rent) over (partition by label) + avg(rent) over () as x from panel)
select round(sum(x * y) / sum(x * x), 6) as coefficient, count(*) as n, (select count(distinct entity) + count(distinct label) from panel) as parameters from w""")
def ols_two_way(spark, sf_dir):
    """Entity and time effects together; the closed form of the text holds for a balanced panel."""
    fit = stats.fit_ols(panel(spark, sf_dir), "target", ["rent"], entity_effects=True, time_effects=True, covariance="classical")
    return fit.filter("term = 'rent'").select(F.round("coefficient", 6).alias("coefficient"), "n", "parameters")


@query("stability_performance", "with " + SQL_FORWARD + """,
parts as (
  select 'market' as kind, entity as name, actual, prediction, prior_actual from long where method = 'model'
  union all select 'era', 'early', actual, prediction, prior_actual from long where method = 'model' and label <= '1995-Q4'
  union all select 'era', 'middle', actual, prediction, prior_actual from long where method = 'model' and label between '1995-Q1' and '1996-Q4'
  union all select 'era', 'late', actual, prediction, prior_actual from long where method = 'model' and label >= '1997-Q1')
select kind, name, count(*) as sample_size, round(avg(abs(actual - prediction)), 6) as mae, round(sqrt(avg(pow(actual - prediction, 2))), 6) as rmse, round(avg(actual - prediction), 6) as bias,
  round(avg(case when (prediction - prior_actual) * (actual - prior_actual) > 0 then 1.0::double else 0.0::double end), 6) as directional_accuracy from parts group by all""")
def stability_performance(spark, sf_dir):
    """The model's walk-forward errors by market and by overlapping eras."""
    rows = forward(spark, sf_dir).filter("method = 'model'")
    out = stats.performance(rows, [("early", None, "1995-Q4"), ("middle", "1995-Q1", "1996-Q4"), ("late", "1997-Q1", None)])
    return out.select("kind", "name", "sample_size", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "directional_accuracy")])


@query("feature_availability", "with " + SQL_PANEL + """
select 'rent' as feature, round(avg(case when cast(entity as integer) % 4 > 0 then 1.0::double else 0.0::double end), 6) as availability_rate from panel
union all select 'tax', 1.0::double from panel having count(*) > 0""")
def feature_availability(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumns({
        "rent__available_at": F.when(F.col("entity").cast("int") % 4 > 0, F.col("target_available_at")), "tax__available_at": F.coalesce("target_available_at", F.current_date()),
    })
    return stats.availability_rate(rows, FEATURES).select("feature", F.round("availability_rate", 6).alias("availability_rate"))
