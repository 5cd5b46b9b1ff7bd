"""Observation warehouse: filters, coverage, versions, crosswalks, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import numbers, periods
from parcelflow.operators import validate, warehouse
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query
from parcelflow.schemas import metric_dim, target_metric_dim
from parcelflow.sources import panels


@query("flagship_growth_panel", "with " + b.SQL_LINES + """,
obs as (
  select geography_id, cast(date_trunc('quarter', o_date) as date) as period_start,
         cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as value, max(cast(l_shipdate as date)) as available_at
  from lines group by all)
select c.geography_id, c.period_start, round(c.value, 2) as revenue, round(c.value / p.value - 1, 6) as revenue_growth_yoy,
       greatest(c.available_at, p.available_at) as available_at
from obs c left join obs p on p.geography_id = c.geography_id and p.value <> 0
     and p.period_start = cast(c.period_start - interval 1 year as date)
""")
def flagship(spark, sf_dir):
    """Quarterly revenue per nation with exact one-year growth; a gap yields no growth."""
    obs = b.market_sums(spark, sf_dir, "geography_id").select(
        "geography_id", "period_start", F.col("revenue_sum").cast("double").alias("value"), "available_at"
    )
    prior = obs.filter("value <> 0").select(
        "geography_id", periods.shift("period_start", 4, "quarterly").alias("period_start"),
        F.col("value").alias("prior"), F.col("available_at").alias("prior_available"),
    )
    return obs.join(prior, ["geography_id", "period_start"], "left").select(
        "geography_id", "period_start", F.round("value", 2).alias("revenue"),
        F.round(F.col("value") / F.col("prior") - 1, 6).alias("revenue_growth_yoy"),
        F.greatest("available_at", "prior_available").alias("available_at"),
    )


@query("observations_long", "with " + b.SQL_OBSERVATIONS + """
select metric, property_type, geography_type, geography_id, observation_date, round(value, 6) as value, sample_count, available_at from obs""")
def observations_long(spark, sf_dir):
    return b.market_observations(spark, sf_dir).withColumn("value", F.round("value", 6))


@query("observation_filter_topn", "with " + b.SQL_CANONICAL + """
select observation_id, observation_date, metric, geography_id, cast(value as double) as value from canonical
where metric in ('line_price') and geography_id = '00007' order by observation_date, observation_id limit 500""")
def observation_filter_topn(spark, sf_dir):
    found = warehouse.query_observations(
        b.canonical(spark, sf_dir), metrics=["line_price"], geography_id="00007",
        columns=["observation_id", "observation_date", "metric", "geography_id", "value"], limit=500,
    )
    return found.withColumn("value", F.col("value").cast("double"))


@query("project_rename", """
select l_orderkey as source_row, l_shipdate::date as as_of_date, l_extendedprice as value, 'USD' as unit from lineitem""")
def project_rename(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return warehouse.rename_columns(lines, {"l_orderkey": "source_row", "l_shipdate": "as_of_date", "l_extendedprice": "value"}, {"unit": "USD"})


@query("coverage_report", "with " + b.SQL_CANONICAL + """
select source_id, metric, geography_type, period_type, min(observation_date) as earliest, max(observation_date) as latest,
       count(*) as observations, count(distinct geography_id) as geographies, count(distinct source_dataset) as datasets
from canonical group by all""")
def coverage_report(spark, sf_dir):
    return warehouse.coverage(b.canonical(spark, sf_dir))


@query("warehouse_summary", "with " + b.SQL_CANONICAL + """
select count(distinct concat_ws('/', source_id, source_dataset)) as files, count(*) as rows, count(distinct metric) as metrics,
       min(observation_date) as earliest, max(observation_date) as latest from canonical""")
def warehouse_summary(spark, sf_dir):
    return warehouse.summary(b.canonical(spark, sf_dir).withColumn("source_file", F.concat_ws("/", "source_id", "source_dataset")))


@query("profile_quality", "with " + b.SQL_CANONICAL + """
select count(*) as rows, count(distinct observation_id) as unique_observation_ids, count(*) filter (where value is null) as null_values,
       min(observation_date) as earliest, max(observation_date) as latest, count(distinct geography_id) as geographies,
       count(distinct metric) as metrics, count(*) filter (where value < 0) as negative_values_review,
       count(*) - count(distinct observation_id) as duplicate_observations,
       round(count(*) filter (where value is null) / count(*) * 100, 6) as null_percentage from canonical""")
def profile_quality(spark, sf_dir):
    return warehouse.profile(b.canonical(spark, sf_dir)).withColumn("null_percentage", F.round("null_percentage", 6))


@query("active_versions", "with " + b.SQL_LEDGER + " select source_id, source_dataset, source_version, created_at, rows from active")
def active_versions(spark, sf_dir):
    return warehouse.active_versions(b.ledger(spark, sf_dir))


@query("active_observations", "with " + b.SQL_LEDGER + """
select c.source_id, c.source_dataset, c.metric, count(*) as observations, cast(sum(value) as double) as total
from canonical c join active a using (source_id, source_dataset, source_version) group by all""")
def active_observations(spark, sf_dir):
    facts = warehouse.active_observations(b.canonical(spark, sf_dir), b.ledger(spark, sf_dir), ("created_at",))
    return facts.groupBy("source_id", "source_dataset", "metric").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("value").cast("double").alias("total")
    )


@query("version_union", "with " + b.SQL_CANONICAL + """
select source_version, metric, count(*) as observations, count(unit) as with_unit, count(quality_level) as with_quality
from (select source_version, metric, cast(null as varchar) as unit, quality_level from canonical where source_version = 'O'
      union all by name select source_version, metric, unit, cast(null as varchar) as quality_level from canonical where source_version <> 'O') group by all""")
def version_union(spark, sf_dir):
    facts = b.canonical(spark, sf_dir)
    older = facts.filter("source_version = 'O'").drop("unit")
    newer = facts.filter("source_version <> 'O'").drop("quality_level")
    return warehouse.union_versions(older, newer).groupBy("source_version", "metric").agg(
        F.count(F.lit(1)).alias("observations"), F.count("unit").alias("with_unit"), F.count("quality_level").alias("with_quality")
    )


@query("label_drift", """
with seen as (select source, list_sort(list(distinct lang)) as langs from documents group by source)
select source, coalesce(array_to_string(list_sort(list_filter(['de','en','es','fr','it'], lambda x: not list_contains(langs, x))), ','), '') as missing,
       coalesce(array_to_string(list_sort(list_filter(langs, lambda x: not list_contains(['de','en','es','fr','it'], x))), ','), '') as unexpected from seen""")
def label_drift(spark, sf_dir):
    return warehouse.drifted_labels(b.table(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr", "it"])


@query("geography_period_spine", "with " + b.SQL_LINES + """
select distinct geography_id, cast(date_trunc('quarter', o_date) as date) as period_start from lines""")
def geography_period_spine(spark, sf_dir):
    return warehouse.spine(b.order_lines(spark, sf_dir).withColumn("period_start", F.to_date(F.date_trunc("quarter", "o_date"))))


@query("duplicate_collapse", """
select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all""")
def duplicate_collapse(spark, sf_dir):
    return warehouse.collapse_duplicates(b.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("text_search", """
select p_partkey, p_name, p_brand, p_type from part
where contains(lower(coalesce(p_name, '')), 'red') or contains(lower(coalesce(p_brand, '')), 'red') or contains(lower(coalesce(p_type, '')), 'red')""")
def text_search(spark, sf_dir):
    return warehouse.search(b.table(spark, sf_dir, "part"), "RED", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand", "p_type")


@query("paged_list", """
select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey limit 50 offset 100""")
def paged_list(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return warehouse.page(customers, sort="c_acctbal", allowed=("c_acctbal", "c_name"), tie="c_custkey", descending=True, limit=50, offset=100)


@query("keyset_page", """
select c_custkey, c_name, c_acctbal from customer where c_acctbal > 1000 or (c_acctbal = 1000 and c_custkey > 10)
order by c_acctbal nulls last, c_custkey limit 50""")
def keyset_page(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return warehouse.next_page(customers, sort="c_acctbal", tie="c_custkey", after=(1000.0, 10), limit=50)


@query("crosswalk_current", "with " + b.SQL_CROSSWALK + """
select county_fips, cbsa, observation_date, source_version, evidence_rows from crosswalk
qualify row_number() over (partition by county_fips order by observation_date desc, source_version desc) = 1""")
def crosswalk_current(spark, sf_dir):
    return warehouse.current_crosswalk(b.crosswalk(spark, sf_dir)).select("county_fips", "cbsa", "observation_date", "source_version", "evidence_rows")


@query("crosswalk_as_of", "with " + b.SQL_CROSSWALK + """,
requests as (select distinct lpad(cast(c_nationkey as varchar), 5, '0') as county_fips, cast(o_orderdate as date) as on_date
             from orders join customer on o_custkey = c_custkey)
select r.county_fips, r.on_date, max_by(cbsa, observation_date) as cbsa, max(observation_date) as effective_date
from requests r join crosswalk c on c.county_fips = r.county_fips and c.observation_date <= r.on_date group by all""")
def crosswalk_as_of(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    requests = orders.select(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips"), F.to_date("o_orderdate").alias("on_date"))
    return warehouse.crosswalk_as_of(requests, b.crosswalk(spark, sf_dir))


@query("annual_growth", "with " + b.SQL_LINES + """,
yearly as (select geography_id, year(o_date) as year, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value from lines group by all)
select 'county' as geography_type, c.geography_id, cast(c.year as integer) as year, round(pow(c.value / p.value, 0.5::double) - 1, 6) as value,
       p.geography_id || ':' || p.year as prior_id, c.geography_id || ':' || c.year as current_id
from yearly c join yearly p on p.geography_id = c.geography_id and p.year = c.year - 2 and p.value <> 0""")
def annual_growth(spark, sf_dir):
    yearly = b.market_sums(spark, sf_dir, "geography_id", frequency="year").select(
        F.lit("county").alias("geography_type"), "geography_id", F.col("period_start").alias("observation_date"),
        F.lit("annual").alias("period_type"), F.lit("line_price").alias("metric"), F.col("price_sum").alias("value"),
        F.concat_ws(":", "geography_id", F.year("period_start")).alias("observation_id"),
    )
    return warehouse.annual_growth(yearly, "line_price", 2).withColumn("value", F.round("value", 6))


@query("observation_lineage", "with " + b.SQL_LEDGER + """
select c.observation_id, c.source_version, cast(c.value as double) as value, l.created_at, l.rows as manifest_rows
from canonical c join ledger l using (source_id, source_dataset, source_version)
where c.observation_id in (select concat_ws('-', l_orderkey, l_linenumber, l_partkey) || '-line_price' from lineitem)""")
def observation_lineage(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), F.lit("-line_price")).alias("observation_id")
    )
    led = b.ledger(spark, sf_dir).withColumn("manifest_hash", F.col("rows"))
    found = warehouse.observation_versions(b.canonical(spark, sf_dir), led, wanted)
    return found.select("observation_id", "source_version", F.col("value").cast("double").alias("value"), "created_at", F.col("manifest_hash").alias("manifest_rows"))


RAW_SQL = """raw as (
  select l_orderkey, l_linenumber,
    case l_orderkey % 7 when 0 then '2024' when 1 then '2024-Q' || cast(l_linenumber as varchar) when 2 then '2024-1' || cast(l_linenumber % 5 as varchar)
      when 3 then cast(cast(l_shipdate as date) as varchar) when 4 then 'FY24' when 5 then '2024-q2' else '2024-02-30' end as observation_date,
    case l_suppkey % 4 when 0 then 'annual' when 1 then 'quarterly' when 2 then 'monthly' else 'irregular' end as period_type,
    case l_partkey % 9 when 0 then 'galaxy' else 'county' end as geography_type,
    case l_partkey % 11 when 0 then '123' else '01001' end as county_fips,
    case l_partkey % 13 when 0 then 'n/a' else cast(l_quantity as varchar) end as value,
    case l_suppkey % 5 when 0 then 'best' else 'high' end as quality_level
  from lineitem)"""


@query("quarantine_split", "with " + RAW_SQL + """,
typed as (
  select *, upper(trim(observation_date)) as label from raw),
judged as (
  select l_orderkey, l_linenumber,
    not (case when regexp_full_match(label, '\\d{4}') then period_type in ('annual', 'irregular')
         when regexp_full_match(label, '\\d{4}-Q[1-4]') then period_type in ('quarterly', 'monthly', 'irregular')
         when regexp_full_match(label, '\\d{4}-(0[1-9]|1[0-2])') then period_type in ('quarterly', 'monthly', 'irregular')
         when regexp_full_match(label, '\\d{4}-\\d{2}-\\d{2}') then try_cast(label as date) is not null and period_type = 'irregular'
         else false end) as period_invalid,
    geography_type <> 'county' as geography_type_unsupported, length(county_fips) <> 5 as county_fips_invalid,
    try_cast(value as double) is null as value_not_numeric, quality_level <> 'high' as quality_level_invalid
  from typed)
select period_invalid::int::varchar || geography_type_unsupported::int || county_fips_invalid::int || value_not_numeric::int || quality_level_invalid::int as verdict,
       count(*) as rows from judged group by all""")
def quarantine_split(spark, sf_dir):
    """Raw rows with planted defects; counts per combination of error codes."""
    lines = b.table(spark, sf_dir, "lineitem")
    case = lambda key, branches, other: _case(F.col(key[0]) % key[1], branches, other)
    raw = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_series"),
        case(("l_orderkey", 7), [
            F.lit("2024"), F.concat(F.lit("2024-Q"), F.col("l_linenumber").cast("string")),
            F.concat(F.lit("2024-1"), (F.col("l_linenumber") % 5).cast("string")), F.to_date("l_shipdate").cast("string"),
            F.lit("FY24"), F.lit("2024-q2"),
        ], F.lit("2024-02-30")).alias("observation_date"),
        case(("l_suppkey", 4), [F.lit("annual"), F.lit("quarterly"), F.lit("monthly")], F.lit("irregular")).alias("period_type"),
        case(("l_partkey", 9), [F.lit("galaxy")], F.lit("county")).alias("geography_type"),
        case(("l_partkey", 11), [F.lit("123")], F.lit("01001")).alias("county_fips"),
        case(("l_partkey", 13), [F.lit("n/a")], F.col("l_quantity").cast("string")).alias("value"),
        case(("l_suppkey", 5), [F.lit("best")], F.lit("high")).alias("quality_level"),
        F.lit("01001").alias("geography_id"), F.lit("fred").alias("source_id"), F.lit("d").alias("source_dataset"), F.lit("1").alias("source_version"),
        F.lit("2024-06-01T00:00:00Z").alias("retrieved_at"), F.lit("m").alias("metric"), F.lit("u").alias("unit"),
        F.lit("t").alias("transformation_version"), F.lit("ref").alias("raw_source_reference"), F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256)).alias("raw_row_hash"),
    )
    judged = validate.observation_errors(raw)
    codes = ["period_invalid", "geography_type_unsupported", "county_fips_invalid", "value_not_numeric", "quality_level_invalid"]
    verdict = F.concat(*[F.array_contains("errors", c).cast("int").cast("string") for c in codes])
    return judged.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def _case(selector, branches, other):
    out = other
    for i, branch in reversed(list(enumerate(branches))):
        out = F.when(selector == i, branch).otherwise(out)
    return out


@query("record_validation", "with " + b.SQL_RECORDS + """
select metric, count(*) as rows, count(*) filter (where release_date < strptime(substr(period, 1, 4) || '-' || ((cast(substr(period, 7, 1) as integer) - 1) * 3 + 1) || '-01', '%Y-%m-%d')::date) as early_release,
  count(*) filter (where verification_status = 'rejected') as rejected, count(*) filter (where licensing_notes is null) as missing_required
from records group by metric""")
def record_validation(spark, sf_dir):
    """Target records mapped to governed names, then checked against the metric registry."""
    records = b.cre_records(spark, sf_dir).withColumns({
        "market": F.col("geography_id"), "property_type": F.lit("multifamily"), "source_identifier": F.col("evidence"), "source_period": F.col("period"),
        "retrieved_at": F.col("retrieved_on").cast("string"), "value": F.col("value").cast("string"), "release_date": F.col("release_date").cast("string"),
        "methodology": F.when(F.col("is_rate"), "market_vacancy").otherwise("asking_rent"), "state_fips": F.lit(None).cast("string"),
        "county_fips": F.lit(None).cast("string"), "cbsa": F.lit(None).cast("string"), "source_class": F.lit("manual_research"),
    })
    judged = validate.record_errors(records, target_metric_dim(spark))
    has = lambda code: F.count_if(F.array_contains("errors", code))
    return judged.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), has("release_before_period").alias("early_release"),
        F.count_if(F.col("verification_status") == "rejected").alias("rejected"), has("missing_required").alias("missing_required"),
    )


@query("registry_coverage", "with " + b.SQL_OBSERVATIONS + """
select metric, count(*) as observations, metric in ('effective_rent', 'inventory', 'vacancy_rate') as governed from obs group by metric""")
def registry_coverage(spark, sf_dir):
    """Observed metrics against the fingerprinted target registry (a fixed table)."""
    dim = target_metric_dim(spark).groupBy("metric").agg(F.min("fingerprint").alias("fingerprint"))
    counts = b.market_observations(spark, sf_dir).groupBy("metric").agg(F.count(F.lit(1)).alias("observations"))
    return counts.join(F.broadcast(dim), "metric", "left").select("metric", "observations", F.col("fingerprint").isNotNull().alias("governed"))


@query("public_registry_check", "with " + b.SQL_CANONICAL + """
select metric, count(*) as rows, cast(0 as bigint) as governed_rows from canonical group by metric""")
def public_registry_check(spark, sf_dir):
    dim = metric_dim(spark).select("metric", F.lit(1).alias("known"))
    joined = b.canonical(spark, sf_dir).join(F.broadcast(dim), "metric", "left")
    return joined.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.count("known").alias("governed_rows"))


@query("decimal_predicates", """
select o_orderpriority, count(*) filter (where cast(o_totalprice as decimal(18,2)) >= 250000.00) as at_least, count(*) filter (where cast(o_totalprice as decimal(18,2)) <= 100000.50) as at_most, cast(0 as bigint) as unparsable
from orders group by 1""")
def decimal_predicates(spark, sf_dir):
    """Exact decimal comparison of text values; text that is no number never matches."""
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return b.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(numbers.decimal_at_least(text, F.lit("250000.00"))).alias("at_least"), F.count_if(numbers.decimal_at_most(text, F.lit("100000.50"))).alias("at_most"),
        F.count_if(numbers.decimal_at_least(F.concat(text, F.lit("?")), F.lit("0"))).alias("unparsable"),
    )


@query("market_panel_unpivot", "with " + b.SQL_LINES + ", " + b.sql_market_sums("sums", "geography_id, property_type") + """
select period_start::varchar as observation_date, 'market' as geography_type, geography_id, property_type, metric, round(value, 6) as value, case when metric = 'vacancy_rate' then 'decimal_fraction' else 'count_or_level' end as unit,
  case when metric <> 'lease_comp_count' then line_count end as sample_count
from (select *, unnest(['vacancy_rate', 'inventory', 'lease_comp_count']) as metric, unnest([cast(discount_sum as double) / line_count, case when line_count > 3 then cast(quantity_sum as double) end, line_count::double]) as value from sums)
where value is not null""")
def market_panel_unpivot(spark, sf_dir):
    """Wide interchange rows (text) to one observation per non-blank metric."""
    wide = b.market_sums(spark, sf_dir, "geography_id", "property_type").select(
        F.col("period_start").cast("string").alias("period"), F.col("geography_id").alias("market_id"), "property_type", F.lit("s").alias("source"), F.lit("r").alias("source_reference"),
        (F.col("discount_sum").cast("double") / F.col("line_count")).cast("string").alias("vacancy_rate"), F.when(F.col("line_count") > 3, F.col("quantity_sum").cast("string")).otherwise("").alias("inventory"),
        F.col("line_count").cast("string").alias("lease_comp_count"),
    )
    rows = panels.panel_observations(wide)
    return rows.select("observation_date", "geography_type", "geography_id", "property_type", "metric", F.round(F.col("value").cast("double"), 6).alias("value"), "unit", "sample_count")


@query("panel_row_quarantine", """
select case when c_acctbal < 0 then 'no_metric' when c_custkey % 7 = 0 then 'county_fips_invalid' else '' end as errors, count(*) as rows from customer group by 1""")
def panel_row_quarantine(spark, sf_dir):
    """Customers as wide panel rows with planted county and metric defects."""
    k = F.col("c_custkey")
    rows = b.table(spark, sf_dir, "customer").select(
        F.lit("2024-03-31").alias("period"), F.lit("2024-04-01").alias("source_date"), k.cast("string").alias("market_id"), F.col("c_name").alias("market_name"), F.lit("office").alias("property_type"), F.lit("s").alias("source"),
        F.lit("r").alias("source_reference"), F.lit("ok").alias("usage_rights"), F.when((k % 7 == 0) & (F.col("c_acctbal") >= 0), "12").otherwise("01001").alias("county_fips"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("effective_rent"),
    )
    judged = validate.panel_row_errors(rows, [], ["effective_rent"], panels.PANEL_PROPERTY_TYPES)
    return judged.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("rows"))


@query("series_interchange", """
select cast(o_orderdate as date)::varchar as period, 'US' as market_id, round(sum(cast(o_totalprice as decimal(18,2)))::double / 100, 4) as treasury_rate from orders group by 1""")
def series_interchange(spark, sf_dir):
    """One catalogued daily series as single-metric interchange rows, percent to fraction."""
    daily = b.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("value"))
    rows = daily.withColumns({"geography_type": F.lit("country"), "geography_id": F.lit("US")})
    out = panels.series_panel(rows, "treasury_rate", percent=True, source="s", source_date="2024-01-01", reference="r", rights="public", property_type="multifamily")
    return out.select("period", "market_id", F.round(F.col("treasury_rate").cast("double"), 4).alias("treasury_rate"))
