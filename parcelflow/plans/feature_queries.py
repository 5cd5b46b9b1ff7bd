"""Feature panel queries over nation-year revenue and a national daily series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from parcelflow.functions import periods
from parcelflow.operators import features, lineage, target_panel
from parcelflow.operators.features import FeatureSpec
from parcelflow.plans import bindings as b
from parcelflow.plans import feature_panel, panel_queries, panel_versions
from parcelflow.plans.registry import query
from parcelflow.plans.stream_queries import scratch
from parcelflow.sources import store
from parcelflow.session import checkpointed

SPECS = (
    FeatureSpec("revenue", "source", "USD", "revenue", ("orders",), cbsa_sum=True),
    FeatureSpec("quantity", "source", "units", "quantity", ("orders",), cbsa_sum=True),
    FeatureSpec("order_value_mean", "period_mean", "USD", "order_value", ("daily",), market_aggregation="broadcast"),
    FeatureSpec("order_value_end", "period_end", "USD", "order_value", ("daily",), market_aggregation="broadcast"),
    FeatureSpec("revenue_growth_yoy", "growth", "decimal_fraction", inputs=("revenue",)),
    FeatureSpec("revenue_cagr_3y", "cagr", "decimal_fraction", inputs=("revenue",), lag=3),
    FeatureSpec("order_value_change_2q", "difference", "USD", inputs=("order_value_end",), lag=2, frequencies=("quarterly",)),
    FeatureSpec("revenue_per_1000_units", "ratio_per_1000", "USD", inputs=("revenue", "quantity")),
    FeatureSpec("revenue_growth_yoy_lag_1", "lag", "decimal_fraction", inputs=("revenue_growth_yoy",), lag=1),
)


def facts(spark, sf_dir):
    yearly = b.market_sums(spark, sf_dir, "geography_id", frequency="year").select(
        "geography_id", F.col("period_start").alias("observation_date"), F.col("available_at").alias("as_of_date"),
        F.col("revenue_sum").cast("double").alias("revenue"), F.col("quantity_sum").cast("double").alias("quantity"),
    ).unpivot(["geography_id", "observation_date", "as_of_date"], ["revenue", "quantity"], "metric", "value").select(
        "metric", "value", "observation_date", "as_of_date", F.lit("orders").alias("source_id"), F.lit("county").alias("geography_type"),
        "geography_id", F.lit("annual").alias("period_type"), F.col("geography_id").alias("county_fips"),
    )
    daily = b.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("observation_date")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value")
    ).select(
        F.lit("order_value").alias("metric"), "value", "observation_date", F.col("observation_date").alias("as_of_date"), F.lit("daily").alias("source_id"),
        F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), F.lit("daily").alias("period_type"), F.lit(None).cast("string").alias("county_fips"),
    )
    return yearly.unionByName(daily).withColumns({
        "observation_id": F.concat_ws(":", "metric", "geography_id", "observation_date"), "state_fips": F.substring("county_fips", 1, 2),
        "cbsa": F.lit(None).cast("string"), "quality_level": F.lit("high"), "unit": F.lit("u"), "source_series": F.col("metric"),
        "source_dataset": F.lit("d"), "source_version": F.lit("1"),
    })


def regions(spark, sf_dir):
    return b.table(spark, sf_dir, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("county_fips"), F.lpad(F.col("n_regionkey").cast("string"), 5, "0").alias("cbsa"),
        F.make_date(F.lit(1998), F.lit(7), F.lit(1)).alias("as_of_date"), F.concat(F.lit("membership:"), F.col("n_name")).alias("observation_id"),
    )


def tables(spark, sf_dir, geography="county", frequency="quarterly", only=None):
    crosswalk = regions(spark, sf_dir) if geography == "cbsa" else None
    return feature_panel.build(
        facts(spark, sf_dir), geography=geography, frequency=frequency, specs=SPECS, crosswalk=crosswalk, only=only, stage=checkpointed, check=False
    )


SQL_VALUES = b.SQL_LINES + """,
yearly as (
  select geography_id, year(o_date) as y, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue,
         cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, max(cast(l_shipdate as date)) as available_at from lines group by all),
annual as (
  select 'revenue' as feature_name, geography_id, y, revenue as value, available_at from yearly
  union all select 'quantity', geography_id, y, quantity, available_at from yearly),
quarterly as (
  select feature_name, geography_id, make_date(y, m, 1) as period_start, value, available_at from annual, (select unnest([1, 4, 7, 10])::bigint as m)),
spine as (select distinct geography_id, period_start from quarterly),
daily as (
  select cast(o_orderdate as date) as d, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as value from orders group by 1),
national as (
  select cast(date_trunc('quarter', d) as date) as period_start, avg(value) as mean_value, max_by(value, d) as end_value, max(d) as available_at from daily group by 1),
macro as (
  select 'order_value_mean' as feature_name, period_start, mean_value as value, available_at from national
  union all select 'order_value_end', period_start, end_value, available_at from national),
local_macro as (select feature_name, geography_id, s.period_start, value, available_at from macro m join spine s on s.period_start = m.period_start),
level1 as (select * from quarterly union all select * from local_macro),
growth as (
  select 'revenue_growth_yoy' as feature_name, c.geography_id, c.period_start, c.value / p.value - 1 as value, greatest(c.available_at, p.available_at) as available_at
  from level1 c join level1 p on p.feature_name = c.feature_name and p.geography_id = c.geography_id and p.period_start = cast(c.period_start - interval 12 month as date)
  where c.feature_name = 'revenue' and p.value <> 0),
cagr as (
  select 'revenue_cagr_3y' as feature_name, c.geography_id, c.period_start, pow(c.value / p.value, 1.0::double / 3) - 1 as value, greatest(c.available_at, p.available_at) as available_at
  from level1 c join level1 p on p.feature_name = c.feature_name and p.geography_id = c.geography_id and p.period_start = cast(c.period_start - interval 36 month as date)
  where c.feature_name = 'revenue' and p.value <> 0 and c.value / p.value > 0),
change2q as (
  select 'order_value_change_2q' as feature_name, c.geography_id, c.period_start, c.value - p.value as value, greatest(c.available_at, p.available_at) as available_at
  from level1 c join level1 p on p.feature_name = c.feature_name and p.geography_id = c.geography_id and p.period_start = cast(c.period_start - interval 6 month as date)
  where c.feature_name = 'order_value_end'),
per1000 as (
  select 'revenue_per_1000_units' as feature_name, c.geography_id, c.period_start, c.value / p.value * 1000.0::double as value, greatest(c.available_at, p.available_at) as available_at
  from level1 c join level1 p on p.geography_id = c.geography_id and p.period_start = c.period_start
  where c.feature_name = 'revenue' and p.feature_name = 'quantity' and p.value <> 0),
lagged as (
  select 'revenue_growth_yoy_lag_1' as feature_name, s.geography_id, s.period_start, p.value, p.available_at
  from spine s join growth p on p.geography_id = s.geography_id and p.period_start = cast(s.period_start - interval 3 month as date)),
vals as (
  select * from level1 union all select * from growth union all select * from cagr union all select * from change2q
  union all select * from per1000 union all select * from lagged)"""


def _one(name, digits=6):
    def run(spark, sf_dir):
        only = [name] if name.startswith("revenue") else [name, "revenue"]
        values = tables(spark, sf_dir, only=only).values.filter((F.col("feature_name") == name) & (F.col("geography_type") == "county"))
        return values.select("geography_id", "period_start", F.round("value", digits).alias("value"), "available_at")

    sql = f"with {SQL_VALUES} select geography_id, period_start, round(value, {digits}) as value, available_at from vals where feature_name = '{name}'"
    return run, sql


for _name, _feature, _digits in (
    ("carry_forward_quarters", "revenue", 2), ("macro_period_mean", "order_value_mean", 4), ("macro_period_end", "order_value_end", 4),
    ("growth_yoy", "revenue_growth_yoy", 6), ("cagr_3y", "revenue_cagr_3y", 6), ("difference_2q", "order_value_change_2q", 4),
    ("ratio_per_1000", "revenue_per_1000_units", 4), ("lag_n", "revenue_growth_yoy_lag_1", 6),
):
    _run, _sql = _one(_feature, _digits)
    query(_name, _sql)(_run)


@query("cbsa_sum", "with " + SQL_VALUES + """
select lpad(cast(n_regionkey as varchar), 5, '0') as geography_id, feature_name, period_start, round(sum(value), 2) as value,
       greatest(max(available_at), date '1998-07-01') as available_at
from quarterly join nation on lpad(cast(n_nationkey as varchar), 5, '0') = geography_id group by all""")
def cbsa_sum(spark, sf_dir):
    values = tables(spark, sf_dir, "cbsa", only=["revenue", "quantity"]).values.filter("geography_type = 'cbsa' AND feature_name IN ('revenue', 'quantity')")
    return values.select("geography_id", "feature_name", "period_start", F.round("value", 2).alias("value"), "available_at")


@query("feature_panel_wide", "with " + SQL_VALUES + """
select 'county' as geography_type, geography_id, period_start, cast(year(period_start) as integer) as year, cast(quarter(period_start) as integer) as quarter,
  round(max(value) filter (where feature_name = 'revenue'), 2) as revenue, max(available_at) filter (where feature_name = 'revenue') as revenue__available_at,
  round(max(value) filter (where feature_name = 'revenue_growth_yoy'), 6) as revenue_growth_yoy,
  max(available_at) filter (where feature_name = 'revenue_growth_yoy') as revenue_growth_yoy__available_at,
  round(max(value) filter (where feature_name = 'order_value_change_2q'), 4) as order_value_change_2q,
  round(max(value) filter (where feature_name = 'revenue_growth_yoy_lag_1'), 6) as revenue_growth_yoy_lag_1
from vals group by geography_id, period_start""")
def feature_panel_wide(spark, sf_dir):
    panel = tables(spark, sf_dir).panel
    return panel.select(
        "geography_type", "geography_id", "period_start", "year", "quarter", F.round("revenue", 2).alias("revenue"), "revenue__available_at",
        F.round("revenue_growth_yoy", 6).alias("revenue_growth_yoy"), "revenue_growth_yoy__available_at",
        F.round("order_value_change_2q", 4).alias("order_value_change_2q"), F.round("revenue_growth_yoy_lag_1", 6).alias("revenue_growth_yoy_lag_1"),
    )


@query("feature_profile", "with " + SQL_VALUES + """,
everything as (select geography_id, period_start, feature_name from vals union all select 'US', period_start, feature_name from macro)
select count(*) as feature_values, count(*) as unique_lineage_ids, count(distinct geography_id) as geographies, min(period_start) as earliest,
       max(period_start) as latest, cast(0 as bigint) as non_finite_values, cast(0 as bigint) as forbidden_imputation_labels,
       cast(0 as bigint) as invalid_period_starts, cast(0 as bigint) as duplicate_feature_keys from everything""")
def feature_profile(spark, sf_dir):
    return features.profile_panel(tables(spark, sf_dir).values, "quarterly")


@query("source_feature_conflicts", "with " + b.SQL_CANONICAL + """
select geography_id, cast(year(observation_date) as integer) as year, count(*) as copies,
       count(distinct (value, unit, source_series, source_dataset, source_version)) > 1 as conflict, max(as_of_date) as available_at,
       case when bool_or(quality_level = 'low') then 'low' when bool_or(quality_level = 'unknown') then 'unknown'
            when bool_or(quality_level = 'moderate') then 'moderate' else 'high' end as quality_level
from canonical where metric = 'line_price' and source_id = '1-URGENT' group by all""")
def source_feature_conflicts(spark, sf_dir):
    """The conflict gate over raw line observations: copies, worst quality and latest availability."""
    rows = b.canonical(spark, sf_dir).withColumns({
        "period_type": F.lit("annual"), "state_fips": F.substring("geography_id", 1, 2), "county_fips": F.col("geography_id"), "cbsa": F.lit(None).cast("string"),
    })
    spec = FeatureSpec("line_price", "source", "USD", "line_price", ("1-URGENT",))
    return features.source_groups(rows, [spec]).select("geography_id", "year", "copies", "conflict", "available_at", "quality_level")


@query("feature_lineage_nodes", "with " + SQL_VALUES + """
select geography_id, period_start, round(value, 6) as value from growth""")
def feature_lineage_nodes(spark, sf_dir):
    values = tables(spark, sf_dir, only=["revenue_growth_yoy"]).values
    roots = values.filter("feature_name = 'revenue_growth_yoy'").select("lineage_id")
    return lineage.feature_nodes(values, roots).select("geography_id", "period_start", F.round("value", 6).alias("value"))


@query("lineage_trace", "with " + SQL_VALUES + """
select geography_id, period_start, cast(2 as bigint) as observations, cast(3 as bigint) as feature_nodes, cast(2 as integer) as depth from growth""")
def lineage_trace(spark, sf_dir):
    """Every growth value traced to its observations: node counts and depth per root."""
    built = tables(spark, sf_dir, only=["revenue_growth_yoy"])
    roots = built.values.filter("feature_name = 'revenue_growth_yoy' AND geography_type = 'county'")
    reached = lineage.trace(built.edges, roots.select("lineage_id"))
    counts = reached.groupBy("root_id").agg(
        F.count_if(F.col("node_kind") == "observation").alias("observations"), F.count_if(F.col("node_kind") == "feature").alias("feature_nodes"),
        F.max("depth").alias("depth"),
    )
    return counts.join(roots, counts.root_id == roots.lineage_id).select("geography_id", "period_start", "observations", "feature_nodes", "depth")


@query("frequency_conversion", "with " + b.SQL_LINES + """
select cast(date_trunc('quarter', o_date) as date) as period_start, min(cast(year(o_date) * 4 + quarter(o_date) - 1 as integer)) as period_index,
       min(last_day(cast(cast(date_trunc('quarter', o_date) as date) + interval 2 month as date))) as period_end, count(*) as rows from lines group by 1""")
def frequency_conversion(spark, sf_dir):
    periods.require_conversion("daily", "quarterly", "period_mean_broadcast")
    rows = b.order_lines(spark, sf_dir).withColumn("label", periods.quarter_label("o_date"))
    return rows.groupBy(periods.period_start("label").alias("period_start")).agg(
        F.min(periods.quarter_index("label")).alias("period_index"), F.min(periods.period_end("label", F.lit("quarterly"))).alias("period_end"),
        F.count(F.lit(1)).alias("rows"),
    )


def published(spark, sf_dir, name, geography="county"):
    """A store with the panel of the given tables: published, published again without a change, then with other growth."""
    root = scratch(spark, name)
    crosswalk = regions(spark, sf_dir) if geography == "cbsa" else None
    rows = checkpointed(facts(spark, sf_dir))
    put = lambda specs: panel_versions.publish(rows, root, geography=geography, frequency="quarterly", specs=specs, crosswalk=crosswalk)
    first, again = put(SPECS), put(SPECS)
    changed = tuple(replace(s, unit="percent_of_one") if s.name == "revenue_growth_yoy" else s for s in SPECS)
    return root, first, again, put(changed)


@query("published_feature_panel", "with " + SQL_VALUES + """
select geography_id, period_start, round(max(value) filter (where feature_name = 'revenue'), 2) as revenue, max(available_at) filter (where feature_name = 'revenue') as revenue__available_at,
  round(max(value) filter (where feature_name = 'revenue_growth_yoy'), 6) as revenue_growth_yoy, round(max(value) filter (where feature_name = 'order_value_mean'), 4) as order_value_mean,
  round(max(value) filter (where feature_name = 'revenue_cagr_3y'), 6) as revenue_cagr_3y
from vals group by geography_id, period_start""")
def published_feature_panel(spark, sf_dir):
    """The wide panel of the pinned first version, read back and verified after a later version was published."""
    root, first, _, _ = published(spark, sf_dir, "panel")
    panel = panel_versions.open_version(spark, root, geography="county", frequency="quarterly", version=first["version"]).panel
    return panel.select(
        "geography_id", "period_start", F.round("revenue", 2).alias("revenue"), "revenue__available_at", F.round("revenue_growth_yoy", 6).alias("revenue_growth_yoy"),
        F.round("order_value_mean", 4).alias("order_value_mean"), F.round("revenue_cagr_3y", 6).alias("revenue_cagr_3y"),
    )


@query("feature_rebuild", "with " + SQL_VALUES + """
select feature_name, count(*) as rows, feature_name like 'revenue_growth_yoy%' as rebuilt, round(sum(value), 2) as total from vals group by feature_name""")
def feature_rebuild(spark, sf_dir):
    """The newest version after one spec changed: which features were rewritten, and their values as read back."""
    root, _, again, third = published(spark, sf_dir, "rebuild")
    if again["outcome"] != "unchanged":
        raise ValueError("a rebuild without a change published a version")
    values = panel_versions.open_version(spark, root, geography="county", frequency="quarterly").values
    nodes = panel_versions.manifest(spark, root).filter((F.col("version") == third["version"]) & F.col("role").isin("base", "local", "derived"))
    flags = nodes.groupBy("feature_name").agg(F.max("rebuilt").alias("rebuilt"))
    counts = values.filter("geography_type = 'county'").groupBy("feature_name").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))
    return counts.join(flags, "feature_name").select("feature_name", "rows", "rebuilt", "total")


@query("feature_versions", """
select * from (values ('county', 'quarterly', 1, 11, 11, false), ('county', 'quarterly', 2, 11, 2, true)) as t(geography, frequency, place, nodes, rebuilt, active)
where exists (select 1 from lineitem)""")
def feature_versions(spark, sf_dir):
    """The published versions in order, with how many of their nodes each wrote anew."""
    root, first, _, _ = published(spark, sf_dir, "versions")
    rows = panel_versions.versions(spark, root)
    place = F.when(F.col("version") == first["version"], 1).otherwise(2)
    return rows.select("geography", "frequency", place.alias("place"), "nodes", "rebuilt", "active")


SQL_TARGET_LINEAGE = b.SQL_OBSERVATIONS + ", " + panel_queries.SQL_WEIGHTS + """,
yearly as (select geography_id, year(o_date) as y, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue from lines group by all),
areas as (select lpad(cast(n_regionkey as varchar), 5, '0') as area, y, sum(revenue) as revenue, count(*) as n from yearly join nation on lpad(cast(n_nationkey as varchar), 5, '0') = geography_id group by all),
z as (select market_id, count(*) as counties from weights group by 1),
mk as (select w.market_id, y, sum(revenue * weight) as revenue, count(*) as n, sum(weight) as total from weights w join yearly s on s.geography_id = w.county_fips join z on z.market_id = w.market_id
  group by w.market_id, y, counties having count(*) = counties),
tg as (select *, cast(geography_id as integer) % 3 as k from obs where metric = 'vacancy_rate')
select tg.geography_id as market_id, tg.property_type, observation_date as period_start, round(coalesce(a.revenue, c.revenue, m.revenue), 2) as revenue,
  coalesce(case when a.n > 0 then 1 end, case when c.y > 0 then 1 end, m.n) as parents, round(coalesce(case when c.y > 0 or a.n > 0 then 1.0::double end, m.total), 9) as weight,
  coalesce(2 * a.n, case when c.y > 0 then 1 end, m.n) as observations
from tg join nation on lpad(cast(n_nationkey as varchar), 5, '0') = tg.geography_id
left join areas a on k = 0 and a.area = lpad(cast(n_regionkey as varchar), 5, '0') and a.y = year(observation_date)
left join yearly c on k = 1 and c.geography_id = tg.geography_id and c.y = year(observation_date)
left join mk m on k = 2 and m.market_id = tg.property_type and m.y = year(observation_date)
where coalesce(a.y, c.y, m.y) is not null"""


@query("target_panel_lineage", "with " + SQL_TARGET_LINEAGE)
def target_panel_lineage(spark, sf_dir):
    """A published target panel read back: every row with the feature values and, traced on, the observations behind it."""
    rows = checkpointed(facts(spark, sf_dir))
    put = lambda geography, crosswalk: feature_panel.build(
        rows, geography=geography, frequency="quarterly", specs=SPECS, crosswalk=crosswalk, only=["revenue"], stage=checkpointed, check=False
    )
    county, area = put("county", None), put("cbsa", regions(spark, sf_dir))
    values = checkpointed(county.values.unionByName(area.values.filter("geography_type = 'cbsa'")))
    feature = county.edges.unionByName(area.edges).distinct()
    nations = b.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("geography_id"), F.lpad(F.col("n_regionkey").cast("string"), 5, "0").alias("area"))
    key = F.col("geography_id").cast("int") % 3
    targets = b.market_observations(spark, sf_dir).filter("metric = 'vacancy_rate'").join(nations, "geography_id").withColumns({
        "cbsa": F.when(key == 0, F.col("area")), "county_fips": F.when(key == 1, F.col("geography_id")), "definition_id": F.when(key == 2, F.col("property_type")),
        "period": periods.quarter_label("observation_date"), "target_id": F.sha2(F.concat_ws("|", F.lit("target"), "geography_id", "property_type", "observation_date"), 256),
    })
    wide = lambda kind, name: values.filter((F.col("geography_type") == kind) & (F.col("feature_name") == "revenue")).select(
        F.col("geography_id").alias(name), periods.quarter_label("period_start").alias("period"), F.col("value").alias("revenue"), F.col("available_at").alias("revenue__available_at"))
    weights = target_panel.county_weights(panel_queries.inventory(spark, sf_dir)).withColumnRenamed("market_id", "definition_id").drop("basis")
    market = target_panel.weighted_features(weights, values.filter("geography_type = 'county'"), spark.createDataFrame(panel_queries.RULES[:1], "feature_name string, rule string")).filter(
        "value IS NOT NULL").select("definition_id", periods.quarter_label("period_start").alias("period"), F.col("value").alias("revenue"), F.col("available_at").alias("revenue__available_at"))
    panel = checkpointed(target_panel.join_features(targets, wide("cbsa", "geography_id"), wide("county", "geography_id"), market, ["revenue"]).filter("problem IS NULL"))
    edges = target_panel.feature_edges(panel, values, weights, ["revenue"])
    sent = store.publish_tables({"panel": panel, "edges": edges}, scratch(spark, "targets"), {"target": "vacancy_rate", "features": ["revenue"]})
    tables = store.open_tables(spark, sent["path"])
    every = tables["edges"].select(*features.EDGE_COLUMNS).unionByName(feature)
    reached = lineage.trace(every, tables["panel"].select(F.col("target_id").alias("lineage_id")))
    direct = tables["edges"].groupBy("lineage_id").agg(F.count(F.lit(1)).alias("parents"), F.round(F.sum("weight"), 9).alias("weight"))
    ends = reached.filter("node_kind = 'observation'").groupBy(F.col("root_id").alias("lineage_id")).agg(F.count(F.lit(1)).alias("observations"))
    return tables["panel"].withColumnRenamed("target_id", "lineage_id").join(direct, "lineage_id").join(ends, "lineage_id").select(
        F.col("geography_id").alias("market_id"), "property_type", F.col("observation_date").alias("period_start"), F.round("revenue", 2).alias("revenue"), "parents", "weight", "observations"
    )
