"""Comparables, proximity, screening and outcome queries.

Suppliers are subjects, orders are comparables, customers are places and parts are candidates;
coordinates are arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.operators import comparables as c
from parcelflow.operators import screening as s
from parcelflow.operators import validate
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query

RADIUS = 60.0
AS_OF = "1998-06-30"


def subjects(spark, sf_dir):
    k = F.col("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(
        k.alias("subject_id"), F.concat(F.lit("type"), (k % 5).cast("string")).alias("property_type"), ((k * 7919) % 1000 / 100.0).alias("latitude"), ((k * 104729) % 1000 / 100.0).alias("longitude"),
        F.when(k % 7 != 0, (k % 90 + 10).cast("double")).alias("units"), F.when(k % 6 != 0, (k % 60 + 1955).cast("double")).alias("year_built"), (F.abs("s_acctbal") + 100).alias("rentable_sf"),
    )


def comps(spark, sf_dir):
    k = F.col("o_orderkey")
    return b.table(spark, sf_dir, "orders").select(
        k.alias("comp_id"), F.concat(F.lit("addr-"), k.cast("string")).alias("address"), F.concat(F.lit("Type"), (k % 5).cast("string")).alias("property_type"),
        ((F.col("o_custkey") * 15485863) % 10000 / 1000.0).alias("latitude"), ((k * 32452843) % 10000 / 1000.0).alias("longitude"), F.col("o_totalprice").alias("value"),
        F.when(k % 3 == 0, "USD/unit").otherwise("USD/unit/month").alias("unit"), F.to_date("o_orderdate").alias("observed_date"), F.when(k % 4 != 0, (k % 80 + 5).cast("double")).alias("units"),
        F.when(k % 9 != 0, (k % 70 + 1950).cast("double")).alias("year_built"),
    )


SQL_COMPS = """subj as (
  select s_suppkey as subject_id, 'type' || s_suppkey % 5 as property_type, (s_suppkey * 7919) % 1000 / 100.0::double as lat, (s_suppkey * 104729) % 1000 / 100.0::double as lon,
    case when s_suppkey % 7 <> 0 then s_suppkey % 90 + 10 end as su, case when s_suppkey % 6 <> 0 then s_suppkey % 60 + 1955 end as sy, abs(s_acctbal) + 100 as sf from supplier),
comp as (
  select o_orderkey as comp_id, 'addr-' || o_orderkey as address, 'type' || o_orderkey % 5 as property_type, (o_custkey * 15485863) % 10000 / 1000.0::double as clat, (o_orderkey * 32452843) % 10000 / 1000.0::double as clon,
    o_totalprice as value, case when o_orderkey % 3 = 0 then 'USD/unit' else 'USD/unit/month' end as unit, cast(o_orderdate as date) as observed_date,
    case when o_orderkey % 4 <> 0 then o_orderkey % 80 + 5 end as cu, case when o_orderkey % 9 <> 0 then o_orderkey % 70 + 1950 end as cy from orders),
near as (
  select s.*, c.* exclude (property_type), 3958.7613::double * 2 * asin(sqrt(least(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2), 1))) as d,
    date '1998-06-30' - observed_date as age from subj s join comp c using (property_type) where value > 0)"""

UNIT_PART = "case when su > 0 and cu > 0 then least(su, cu) / greatest(su, cu)::double * {w} else 0 end"
YEAR_PART = "case when sy > 0 and cy > 0 then greatest(0, 1 - abs(sy - cy) / 50.0::double) * {w} else 0 end"


def _ranked_sql(wd, wu, wr, where):
    recency = f" + greatest(0, 1 - age / 730.0::double) * {wr}" if wr else ""
    return f""",
sc as (
  select *, round((greatest(0, 1 - d / 60.0::double) * {wd}{recency} + {UNIT_PART.format(w=wu)} + {YEAR_PART.format(w=wu)})
    / ({wd} + {wr} + case when su > 0 and cu > 0 then {wu} else 0 end + case when sy > 0 and cy > 0 then {wu} else 0 end), 6) as similarity, round(d, 3) as distance_miles from near where d <= 60 {where}),
ranked as (select *, cast(row_number() over (partition by subject_id order by similarity desc, distance_miles, address) as integer) as rank from sc qualify rank <= 10)"""


SQL_RENT = SQL_COMPS + _ranked_sql("0.5::double", "0.25::double", 0, "")
SQL_SALE = SQL_COMPS + _ranked_sql("0.4::double", "0.2::double", "0.2::double", "and age between 0 and 730 and unit = 'USD/unit'")


def rent_ranked(spark, sf_dir):
    return c.rank_comps(subjects(spark, sf_dir), comps(spark, sf_dir), kind="rent", radius_miles=RADIUS)


def sale_ranked(spark, sf_dir):
    return c.rank_comps(subjects(spark, sf_dir), comps(spark, sf_dir), kind="sale", as_of=AS_OF, radius_miles=RADIUS)


RANKED = "select subject_id, rank, comp_id, address, distance_miles, similarity from ranked"


@query("rent_comps_topk", "with " + SQL_RENT + RANKED)
def rent_comps_topk(spark, sf_dir):
    return rent_ranked(spark, sf_dir).select("subject_id", "rank", "comp_id", "address", "distance_miles", "similarity")


@query("sale_comps_topk", "with " + SQL_SALE + RANKED)
def sale_comps_topk(spark, sf_dir):
    return sale_ranked(spark, sf_dir).select("subject_id", "rank", "comp_id", "address", "distance_miles", "similarity")


@query("comp_rejections", "with " + SQL_COMPS + """,
r as (select property_type, count(*) as n, count(*) filter (where date '1998-06-30' < observed_date) as fut, count(*) filter (where date '1998-06-30' - observed_date > 730) as stale,
  count(*) filter (where date '1998-06-30' - observed_date between 0 and 730 and unit <> 'USD/unit') as bad from comp group by 1)
select subject_id, (select count(*) from comp) - n as property_type_mismatch, fut as future_evidence, stale as stale_evidence, bad as invalid from subj join r using (property_type)""")
def comp_rejections(spark, sf_dir):
    return c.rejection_counts(subjects(spark, sf_dir), comps(spark, sf_dir), kind="sale", as_of=AS_OF)


def _located(name, kind, age):
    where = "age between 0 and 730" if age else "true"

    def run(spark, sf_dir):
        return c.located_rejections(subjects(spark, sf_dir), comps(spark, sf_dir), kind=kind, as_of=AS_OF, radius_miles=RADIUS)

    query(name, "with " + SQL_COMPS.replace("where value > 0)", ")") + f""",
t as (select property_type, count(*) as n, count(*) filter (where {age} and date '1998-06-30' < observed_date) as fut, count(*) filter (where {age} and date '1998-06-30' - observed_date > 730) as stale from comp group by 1),
d as (select subject_id, property_type, count(*) filter (where {where} and d > 60) as outside, count(*) filter (where {where} and d <= 60 and (not value > 0 or ({age} and unit <> 'USD/unit'))) as bad from near group by all)
select d.subject_id, (select count(*) from comp) - n as property_type_mismatch, fut as future_evidence, stale as stale_evidence, outside as outside_radius, bad as invalid from d join t using (property_type)""")(run)


_located("rent_comp_rejections", "rent", False)
_located("sale_comp_rejections", "sale", True)


@query("comp_benchmark", "with " + SQL_RENT + """
select subject_id, count(*) as count, min(unit) as unit, round(min(value), 2) as minimum, round(median(value), 2) as median, round(max(value), 2) as maximum from ranked group by 1 having min(unit) = max(unit)""")
def comp_benchmark(spark, sf_dir):
    out = c.benchmark(rent_ranked(spark, sf_dir))
    return out.withColumns({x: F.round(x, 2) for x in ("minimum", "median", "maximum")})


SQL_IMPLIED = SQL_SALE + """,
imp as (select subject_id, count(*) as count, 'USD/unit' as unit, min(value * su) as lo, median(value * su) as mid, max(value * su) as hi from ranked group by 1 having count(su) = count(*))"""


@query("sale_implied_values", "with " + SQL_IMPLIED + " select subject_id, count, unit, round(lo, 2) as implied_minimum, round(mid, 2) as implied_median, round(hi, 2) as implied_maximum from imp")
def sale_implied_values(spark, sf_dir):
    out = c.implied_values(sale_ranked(spark, sf_dir), subjects(spark, sf_dir))
    return out.withColumns({x: F.round(x, 2) for x in ("implied_minimum", "implied_median", "implied_maximum")})


@query("equity_scenarios", "with " + SQL_IMPLIED + """,
x as (select subject_id, s_acctbal_basis as basis, lo, mid, hi from imp join (select s_suppkey as subject_id, abs(s_acctbal) * 1000 + 1 + 5000 + 0 + 250 as s_acctbal_basis from supplier) using (subject_id))
select subject_id, round(basis, 2) as basis, scenario, round(v, 2) as indicated_value, round(v - basis, 2) as equity_wedge, round((v - basis) / basis, 6) as wedge_to_basis
from (select *, unnest(['downside', 'base', 'upside']) as scenario, unnest([lo, mid, hi]) as v from x)""")
def equity_scenarios(spark, sf_dir):
    costs = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("subject_id"), (F.abs("s_acctbal") * 1000 + 1).alias("purchase_price"), F.lit(5000.0).alias("renovation_budget"), F.lit(None).cast("double").alias("closing_costs"), F.lit(250.0).alias("holding_costs"))
    out = c.scenarios(c.implied_values(sale_ranked(spark, sf_dir), subjects(spark, sf_dir)), costs)
    return out.withColumns({"basis": F.round("basis", 2), "indicated_value": F.round("indicated_value", 2), "equity_wedge": F.round("equity_wedge", 2), "wedge_to_basis": F.round("wedge_to_basis", 6)})


def economic_evidence(spark, sf_dir):
    """Supplier costs as long evidence; some suppliers lack closing costs, some repeat a field."""
    wide = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("subject_id"), (F.abs("s_acctbal") * 1000 + 1).alias("purchase_price"), F.lit(5000.0).alias("renovation_budget"),
        F.when(F.col("s_suppkey") % 3 != 0, 1200.0).alias("closing_costs"), F.lit(250.0).alias("holding_costs"), (F.abs("s_acctbal") * 500).alias("loan_amount"), (F.abs("s_acctbal") + 10).alias("annual_insurance"),
        F.when(F.col("s_suppkey") % 10 == 0, 1.5).otherwise(0.05).alias("vacancy_rate"))
    fields = [x for x in wide.columns if x != "subject_id"]
    unit = F.when(F.col("field") == "vacancy_rate", "decimal_fraction").when(F.col("field") == "annual_insurance", "USD/year").otherwise("USD")
    return wide.unpivot("subject_id", fields, "field", "value").filter("value IS NOT NULL").withColumns({
        "unit": unit, "source_type": F.lit("public_record"), "source_reference": F.lit("ref"), "licensing_notes": F.lit("ok"), "as_of_date": F.lit("1998-01-01").cast("date"), "analysis_as_of": F.lit(AS_OF).cast("date"),
    })


@query("economic_errors", """
select case when s_suppkey % 10 = 0 then 'value_out_of_range' else '' end as errors, count(*) as rows from supplier, (select unnest(range(1)) as x) group by 1
""")
def economic_errors(spark, sf_dir):
    judged = validate.economic_errors(economic_evidence(spark, sf_dir)).filter("field = 'vacancy_rate'")
    return judged.groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("rows"))


@query("economic_screen", """
with w as (select s_suppkey as subject_id, abs(s_acctbal) * 1000 + 1 as p, case when s_suppkey % 3 <> 0 then 1200.0::double end as cc, abs(s_acctbal) * 500 as loan, abs(s_acctbal) + 10 as ins,
  case when s_suppkey % 7 <> 0 then s_suppkey % 90 + 10 end as su from supplier),
k as (select *, p + 5000 + coalesce(cc, 0) + 250 as known, cc is not null as complete from w)
select subject_id, round(known, 2) as known_basis, complete as basis_complete, round(case when complete then known / su end, 4) as basis_per_unit, round(case when complete then loan / known end, 6) as loan_to_basis,
  round(case when complete then known - loan end, 2) as equity_requirement, round(ins, 2) as known_annual_costs from k""")
def economic_screen(spark, sf_dir):
    out = c.economic_screen(economic_evidence(spark, sf_dir), subjects(spark, sf_dir))
    digits = {"known_basis": 2, "basis_per_unit": 4, "loan_to_basis": 6, "equity_requirement": 2, "known_annual_costs": 2}
    return out.withColumns({k: F.round(k, v) for k, v in digits.items()}).drop("cost_to_rent")


@query("gross_rent_proxy", "with " + SQL_RENT + """,
bm as (select subject_id, median(value) as m, any_value(su) as su from ranked group by 1 having min(unit) = max(unit) and min(unit) = 'USD/unit/month')
select subject_id, round(m * su, 2) as monthly_rent, round(m * su * 12, 2) as annual_rent from bm where su > 0""")
def gross_rent_proxy(spark, sf_dir):
    out = c.rent_proxy(c.benchmark(rent_ranked(spark, sf_dir)), subjects(spark, sf_dir))
    return out.withColumns({"monthly_rent": F.round("monthly_rent", 2), "annual_rent": F.round("annual_rent", 2)})


@query("property_quality", "with " + SQL_RENT.replace("ranked as", "rr as") + ", " + _ranked_sql("0.4::double", "0.2::double", "0.2::double", "and age between 0 and 730 and unit = 'USD/unit'").replace("sc as", "sc2 as").replace("from sc ", "from sc2 ").lstrip(",\n") + """,
q as (select subject_id, coalesce((select count(*) from rr where rr.subject_id = subj.subject_id), 0) as rent_comps, coalesce((select count(*) from ranked k where k.subject_id = subj.subject_id), 0) as sale_comps from subj)
select subject_id, rent_comps, sale_comps, case when least(rent_comps, sale_comps) >= 5 then 'high' when least(rent_comps, sale_comps) >= 3 then 'moderate' else 'low' end as quality from q""")
def property_quality(spark, sf_dir):
    return c.property_quality(subjects(spark, sf_dir), rent_ranked(spark, sf_dir), sale_ranked(spark, sf_dir)).drop("sale_units")


CATEGORIES = ("downtown", "employment_center", "grocery", "healthcare", "park", "school", "shopping_center")


def places(spark, sf_dir):
    k = F.col("c_custkey")
    category = F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (k % len(CATEGORIES) + 1).cast("int"))
    return b.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), category.alias("category"), ((k * 6700417) % 10000 / 1000.0).alias("latitude"), ((k * 2147483) % 10000 / 1000.0).alias("longitude"),
        F.date_add(F.lit("1990-01-01").cast("date"), (k % 4000).cast("int")).alias("evidence_date"), F.when(k % 8 == 0, F.lit("1999-01-01").cast("date")).alias("effective_from"),
        F.when(k % 8 == 1, F.lit("1997-01-01").cast("date")).alias("effective_to"),
    )


SQL_PLACES = """places as (
  select c_name as name, (['downtown', 'employment_center', 'grocery', 'healthcare', 'park', 'school', 'shopping_center'])[c_custkey % 7 + 1] as category,
    (c_custkey * 6700417) % 10000 / 1000.0::double as clat, (c_custkey * 2147483) % 10000 / 1000.0::double as clon, date '1990-01-01' + cast(c_custkey % 4000 as integer) as evidence_date,
    case when c_custkey % 8 = 0 then date '1999-01-01' end as effective_from, case when c_custkey % 8 = 1 then date '1997-01-01' end as effective_to from customer),
subj as (select s_suppkey as subject_id, (s_suppkey * 7919) % 1000 / 100.0::double as lat, (s_suppkey * 104729) % 1000 / 100.0::double as lon from supplier),
pairs as (select subject_id, category, name, round(3958.7613::double * 2 * asin(sqrt(least(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2), 1))), 3) as distance_miles
  from subj, places),
nearest as (select * from pairs qualify row_number() over (partition by subject_id, category order by distance_miles, name) = 1)"""


@query("nearest_by_category", "with " + SQL_PLACES + " select subject_id, category, distance_miles, name from nearest")
def nearest_by_category(spark, sf_dir):
    return c.nearest_by_category(subjects(spark, sf_dir), places(spark, sf_dir))


@query("location_findings", "with " + SQL_PLACES + """,
t(category, threshold_miles) as (values """ + ", ".join(f"('{k}', {v}::double)" for k, v in sorted(c.LOCATION_THRESHOLDS.items())) + """)
select s.subject_id, t.category, threshold_miles, distance_miles, name, case when distance_miles is null then 'coverage_missing' when distance_miles <= threshold_miles then 'within_analyst_threshold' else 'beyond_analyst_threshold' end as state
from subj s cross join t left join nearest n on n.subject_id = s.subject_id and n.category = t.category""")
def location_findings(spark, sf_dir):
    near = c.nearest_by_category(subjects(spark, sf_dir), places(spark, sf_dir))
    return c.location_findings(subjects(spark, sf_dir), near, c.LOCATION_THRESHOLDS)


@query("location_evidence_states", "with " + SQL_PLACES + """
select category, coalesce(case when date '1998-06-30' < evidence_date then 'future_evidence' when date '1998-06-30' - evidence_date > 2000 then 'stale_evidence'
  when effective_from > date '1998-06-30' then 'not_yet_effective' when effective_to < date '1998-06-30' then 'expired' end, 'usable') as state, count(*) as rows from places group by all""")
def location_evidence_states(spark, sf_dir):
    judged = c.location_evidence(places(spark, sf_dir), AS_OF, 2000)
    return judged.groupBy("category", F.coalesce("refused", F.lit("usable")).alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def candidates(spark, sf_dir):
    """Parts as candidates: retail price against traded prices, discounts as cap rates, taxes as vacancy."""
    lines = b.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("disc"), F.sum(F.col("l_tax").cast("decimal(18,2)")).alias("tax"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"), F.max(F.to_date("l_shipdate")).alias("shipped"),
    )
    parts = b.table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("p_partkey")
    d = lambda x: F.col(x).cast("double")
    dims = F.array(*[F.struct(F.lit(x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(s.DIMENSIONS)])
    hashes = F.map_from_entries(F.transform(F.filter(dims, lambda x: (k + x["i"]) % 4 != 0), lambda x: F.struct(x["d"], F.array(F.sha2(k.cast("string"), 256)))))
    dates = F.map_from_entries(F.transform(F.filter(dims, lambda x: (k + x["i"]) % 9 != 0), lambda x: F.struct(x["d"], F.date_sub("shipped", x["i"] * 20))))
    return parts.select(
        k.alias("candidate_id"), F.col("p_brand").alias("property_type"), F.date_add("shipped", (k % 400).cast("int")).alias("analysis_as_of"), d("p_retailprice").alias("subject_rent"),
        F.round(d("price") / d("qty") / 2, 2).alias("market_rent"), F.lit("USD").alias("rent_unit"), F.when(k % 5 != 0, d("p_retailprice") * 3).alias("acquisition_basis"), F.round(d("price") / d("qty") * 1.2, 2).alias("comparable_sale_basis"),
        F.lit("USD").alias("basis_unit"), d("qty").alias("current_noi"), F.when(k % 6 != 0, d("qty") + (k % 30) - 10).alias("stabilized_noi"), F.round(d("disc") / F.col("n"), 6).alias("subject_cap_rate"), F.lit(0.047).alias("market_cap_rate"),
        F.round(d("tax") / F.col("n"), 6).alias("subject_vacancy"), F.lit(0.031).alias("market_vacancy"), F.col("n").cast("int").alias("rent_comp_count"), (k % 3).cast("int").alias("sale_comp_count"),
        (k % 2 == 0).alias("location_evidence_complete"), (k % 3 == 0).alias("renovation_budget_verified"), F.date_sub("shipped", 300).alias("insurance_evidence_date"), hashes.alias("evidence_hashes"), dates.alias("evidence_dates"),
    )


SQL_CANDIDATES = """ln as (
  select l_partkey, count(*) as n, cast(sum(cast(l_discount as decimal(18,2))) as double) as disc, cast(sum(cast(l_tax as decimal(18,2))) as double) as tax, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, max(cast(l_shipdate as date)) as shipped from lineitem group by 1),
cand as (
  select p_partkey as k, p_brand, shipped, cast(p_partkey % 400 as integer) as ahead, n, p_partkey % 3 as sale_n, p_retailprice as sr, round(price / qty / 2, 2) as mr, case when p_partkey % 5 <> 0 then p_retailprice * 3 end as ab, round(price / qty * 1.2::double, 2) as cb,
    qty as cn, case when p_partkey % 6 <> 0 then qty + p_partkey % 30 - 10 end as sn, round(disc / n, 6) as sc, 0.047::double as mc, round(tax / n, 6) as sv, 0.031::double as mv from part join ln on p_partkey = l_partkey),
met as (select *, (mr - sr) / mr as rent_gap, (cb - ab) / cb as basis_discount, sn - cn as noi_upside, (sn - cn) / nullif(cn, 0) as noi_upside_ratio, (sc - mc) * 10000 as cap_spread_bps, sv - mv as vacancy_delta from cand),
gov as (
  select *, list_transform([rent_gap is not null, basis_discount is not null, noi_upside is not null, true, true, true, k % 2 = 0], lambda x, i: x and (k + i - 1) % 4 <> 0 and (k + i - 1) % 9 <> 0) as g from met),
scr as (
  select *, len(list_filter(g, lambda x: x)) as dims, (g[1] and rent_gap >= 0.05::double)::int as f1, (g[2] and basis_discount >= 0.05::double)::int as f2, (g[3] and noi_upside > 0)::int as f3, (g[4] and round(cap_spread_bps, 8) >= 25)::int as f4, (g[5] and round(vacancy_delta, 10) >= 0.01::double)::int as f5,
    (g[1] and rent_gap >= 0.10::double)::int + (g[2] and basis_discount >= 0.075::double)::int + (g[3] and noi_upside > 0 and noi_upside_ratio >= 0.05::double)::int + (g[4] and round(cap_spread_bps, 8) >= 50)::int + (g[5] and round(vacancy_delta, 10) >= 0.02::double)::int as high,
    list_max([case when g[i] then ahead + (i - 1) * 20 end for i in range(1, 8)]) as oldest, g[6] and n + sale_n >= 3 as support from gov),
tiers as (
  select *, f1 + f2 + f3 + f4 + f5 as signals, case when dims < 3 or not (g[1] or g[2] or g[3] or g[4] or g[5]) then 'INSUFFICIENT_EVIDENCE'
    when dims >= 5 and high >= 2 and oldest <= 365 and support then 'HIGH_PRIORITY_REVIEW' when f1 + f2 + f3 + f4 + f5 > 0 and oldest <= 365 then 'WORTH_REVIEWING' else 'LOW_PRIORITY' end as tier from scr)"""


@query("screening_metrics", "with " + SQL_CANDIDATES + """
select k as candidate_id, round(rent_gap, 6) as rent_gap, round(basis_discount, 6) as basis_discount, round(noi_upside, 6) as noi_upside, round(noi_upside_ratio, 6) as noi_upside_ratio, round(cap_spread_bps, 4) as cap_spread_bps, round(vacancy_delta, 6) as vacancy_delta from met""")
def screening_metrics(spark, sf_dir):
    out = s.metrics(candidates(spark, sf_dir))
    digits = {"rent_gap": 6, "basis_discount": 6, "noi_upside": 6, "noi_upside_ratio": 6, "cap_spread_bps": 4, "vacancy_delta": 6}
    return out.select("candidate_id", *[F.round(F.col(k).cast("double"), v).alias(k) for k, v in digits.items()])


@query("screening_tiers", "with " + SQL_CANDIDATES + """
select k as candidate_id, tier as screening_tier, cast(signals as integer) as signals, cast(high as integer) as high_signals_found, cast(dims as integer) as dimensions, round(dims / 7, 4) as evidence_completeness, cast(oldest as integer) as evidence_freshness_days from tiers""")
def screening_tiers(spark, sf_dir):
    return s.screen(candidates(spark, sf_dir)).select(
        "candidate_id", "screening_tier", "signals", "high_signals_found", "dimensions", "evidence_completeness", "evidence_freshness_days")


@query("evidence_validation", "with " + SQL_CANDIDATES + " select count(*) as candidates, cast(0 as bigint) as with_errors from cand")
def evidence_validation(spark, sf_dir):
    rows = candidates(spark, sf_dir).withColumn("analysis_as_of", F.date_add("analysis_as_of", 1))
    rates = ["subject_cap_rate", "market_cap_rate", "subject_vacancy", "market_vacancy"]
    judged = validate.evidence_errors(rows, ["subject_rent", "market_rent", "current_noi", *rates], rates, ["rent_comp_count", "sale_comp_count"])
    return judged.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.size("errors") > 0).alias("with_errors"))


def screening_store(spark, sf_dir):
    """Candidates, evidence versions (lines per part) and runs (shipped lines) with recorded tiers."""
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate_id"), "l_linenumber", "l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    key = F.concat_ws("-", "candidate_id", "l_linenumber", "l_quantity")
    evidence = lines.select("candidate_id", key.alias("content_hash"), F.to_date("l_shipdate").alias("created_at"))
    versions = s.number_versions(evidence).withColumn("version_id", F.col("content_hash"))
    runs = lines.filter("l_returnflag <> 'N'").select(
        "candidate_id", key.alias("version_id"), F.to_date("l_shipdate").alias("evaluated_at"), F.concat_ws("-", "l_orderkey", "l_linenumber", "candidate_id", "l_quantity").alias("run_id"),
        F.when(F.col("l_quantity") > 40, "HIGH_PRIORITY_REVIEW").when(F.col("l_quantity") > 20, "WORTH_REVIEWING").otherwise("LOW_PRIORITY").alias("screening_tier"),
    )
    base = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("name"), F.lit("1992-01-01").cast("date").alias("created_at"))
    return base, versions, runs


SQL_STORE = """ev as (select l_partkey as candidate_id, concat_ws('-', l_partkey, l_linenumber, case when l_quantity = floor(l_quantity) then cast(l_quantity as decimal(18,1)) end) as h, cast(l_shipdate as date) as created_at from lineitem),
uq as (select candidate_id, h, min(created_at) as created_at from ev group by all),
versions as (select *, row_number() over (partition by candidate_id order by created_at, h) as version_number from uq),
runs as (
  select l_partkey as candidate_id, concat_ws('-', l_partkey, l_linenumber, cast(l_quantity as decimal(18,1))) as h, cast(l_shipdate as date) as evaluated_at, concat_ws('-', l_orderkey, l_linenumber, l_partkey, cast(l_quantity as decimal(18,1))) as run_id,
    case when l_quantity > 40 then 'HIGH_PRIORITY_REVIEW' when l_quantity > 20 then 'WORTH_REVIEWING' else 'LOW_PRIORITY' end as screening_tier from lineitem where l_returnflag <> 'N'),
lv as (select * from versions qualify row_number() over (partition by candidate_id order by version_number desc) = 1),
lr as (select * from runs qualify row_number() over (partition by candidate_id order by evaluated_at desc, run_id desc) = 1),
listed as (
  select p_partkey as candidate_id, p_name as name, lv.version_number, lr.screening_tier, lr.evaluated_at, case when lr.run_id is null then 'NOT_SCREENED' when lr.h = lv.h then 'CURRENT' else 'OUTDATED_EVIDENCE' end as currency
  from part left join lv on lv.candidate_id = p_partkey left join lr on lr.candidate_id = p_partkey)"""


@query("evidence_versions", "with " + SQL_STORE + " select candidate_id, h as content_hash, created_at, version_number from versions")
def evidence_versions(spark, sf_dir):
    return screening_store(spark, sf_dir)[1].select("candidate_id", "content_hash", "created_at", "version_number")


@query("candidate_list", "with " + SQL_STORE + " select * from listed")
def candidate_list(spark, sf_dir):
    return s.candidate_list(*screening_store(spark, sf_dir)).drop("created_at")


@query("candidate_summary", "with " + SQL_STORE + """
select count(*) as candidates, count(*) filter (where currency = 'CURRENT') as current, count(*) filter (where currency = 'OUTDATED_EVIDENCE') as outdated_evidence, count(*) filter (where currency = 'NOT_SCREENED') as not_screened,
  count(*) filter (where currency = 'CURRENT' and screening_tier = 'HIGH_PRIORITY_REVIEW') as high_priority_review, count(*) filter (where currency = 'CURRENT' and screening_tier = 'WORTH_REVIEWING') as worth_reviewing,
  count(*) filter (where currency = 'CURRENT' and screening_tier = 'LOW_PRIORITY') as low_priority, cast(0 as bigint) as insufficient_evidence from listed""")
def candidate_summary(spark, sf_dir):
    return s.candidate_summary(s.candidate_list(*screening_store(spark, sf_dir)))


@query("candidate_timeline", "with " + SQL_STORE + """,
t as (select p_partkey as candidate_id, 'created' as event, date '1992-01-01' as happened_at from part union all select candidate_id, 'evidence_version', created_at from versions union all select candidate_id, 'screening_run', evaluated_at from runs)
select candidate_id, event, count(*) as events, min(happened_at) as first_at, max(happened_at) as last_at from t group by all""")
def candidate_timeline(spark, sf_dir):
    events = s.timeline(*screening_store(spark, sf_dir))
    return events.groupBy("candidate_id", "event").agg(F.count(F.lit(1)).alias("events"), F.to_date(F.min("happened_at")).alias("first_at"), F.to_date(F.max("happened_at")).alias("last_at"))


@query("reproduce_screening", "with " + SQL_CANDIDATES + """,
r as (select *, case when k % 11 = 0 then 'LOW_PRIORITY' else tier end as stored, k % 13 = 0 as unknown from tiers)
select case when unknown then 'unknown_policy' when stored = tier then 'reproduced' else 'different' end as state, count(*) as runs from r group by 1""")
def reproduce_screening(spark, sf_dir):
    inputs = candidates(spark, sf_dir)
    done = s.screen(inputs).select(
        F.col("candidate_id").alias("run_id"), F.col("candidate_id").alias("version_id"), F.when(F.col("candidate_id") % 11 == 0, "LOW_PRIORITY").otherwise(F.col("screening_tier")).alias("screening_tier"),
        "policy_id", F.when(F.col("candidate_id") % 13 == 0, "0.9.0").otherwise(F.col("policy_version")).alias("policy_version"))
    out = s.reproduce(inputs.withColumn("version_id", F.col("candidate_id")), done)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("runs"))


@query("text_duplicates", """
with n as (select p_partkey, sha256(regexp_replace(lower(trim(p_name)), '[.,]', '', 'g')) as address_hash from part)
select p_partkey, address_hash, count(*) over (partition by address_hash) as copies from n qualify copies > 1""")
def text_duplicates(spark, sf_dir):
    return s.address_duplicates(b.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "address_hash", "copies")


def outcomes(spark, sf_dir):
    """Orders as realised outcomes: forecast at the order date, realised when its total is known."""
    k = F.col("o_orderkey")
    text = lambda e: e.cast("string")
    day = F.to_date("o_orderdate")
    digest = F.sha2(k.cast("string"), 256)
    return b.table(spark, sf_dir, "orders").select(
        k.alias("row_number"), text(k).alias("observation_id"), text(F.col("o_custkey")).alias("property_id"), text(F.col("o_custkey") % 25).alias("market_id"),
        F.when(k % 50 == 0, "FY1").otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))).alias("period"), F.lit("multifamily").alias("property_type"),
        text(day).alias("forecast_origin"), text(F.date_add(day, F.when(k % 31 == 0, 5).otherwise(-5))).alias("feature_available_at"), text(F.date_add(day, F.when(k % 37 == 0, 0).otherwise(90))).alias("outcome_realized_at"),
        text(F.date_add(day, 120)).alias("outcome_released_at"), F.lit("realized_total_return").alias("outcome"), F.when(k % 41 == 0, "55").otherwise("0.12").alias("outcome_value"),
        F.when(F.col("o_orderstatus") == "P", "synthetic").otherwise("real").alias("data_status"), F.when(k % 43 == 0, "xyz").otherwise(digest).alias("source_hash"), digest.alias("feature_hash"), F.lit("s").alias("source_name"),
        text(k).alias("source_record_id"), F.lit("ok").alias("licensing_notes"), F.lit("m").alias("methodology"), F.lit(True).alias("analyst_verified"), (k % 47 != 0).alias("rights_documented"),
    )


SQL_OUTCOMES = """oc as (
  select o_orderkey as k, o_custkey as prop, o_custkey % 25 as market, cast(o_orderdate as date) as d, o_orderstatus, case when o_orderkey % 50 = 0 then 'FY1' else year(o_orderdate) || '-Q' || quarter(o_orderdate) end as period,
    count(*) over (partition by o_custkey, cast(o_orderdate as date)) as copies from orders)"""


@query("outcome_findings", "with " + SQL_OUTCOMES + """,
f as (
  select case when k % 31 = 0 then 'future_feature_leakage' end as code from oc union all select case when k % 37 = 0 then 'outcome_timing_invalid' end from oc
  union all select case when d + 120 > date '1998-12-31' then 'outcome_not_released_as_of_review' end from oc union all select case when k % 41 = 0 then 'extreme_outcome_value' end from oc
  union all select case when o_orderstatus = 'P' then 'non_real_data' end from oc union all select case when k % 43 = 0 then 'lineage_hash_invalid' end from oc
  union all select case when k % 50 = 0 then 'period_invalid' end from oc union all select case when copies > 1 then 'duplicate_property_origin_outcome' end from oc)
select case when code = 'extreme_outcome_value' then 'warning' else 'blocking' end as severity, code, count(*) as rows from f where code is not null group by all""")
def outcome_findings(spark, sf_dir):
    found = validate.outcome_findings(outcomes(spark, sf_dir), "1998-12-31")
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("rows"))


SQL_STATES = SQL_OUTCOMES + """,
st as (select *, case when k % 50 = 0 then 'period_invalid' when copies > 1 then 'duplicate_property_origin_outcome' when o_orderstatus = 'P' then 'non_real_data' when k % 47 = 0 then 'governance_incomplete'
  when k % 43 = 0 then 'lineage_hash_invalid' when k % 31 = 0 then 'future_feature_leakage' when k % 37 = 0 then 'outcome_not_forward' when d + 120 > date '1998-12-31' then 'outcome_not_released_as_of_evaluation'
  when k % 41 = 0 then 'outcome_value_extreme_review' end as rejected from oc)"""


@query("outcome_rejections", "with " + SQL_STATES + " select coalesce(rejected, 'eligible') as rejected, count(*) as rows from st group by 1")
def outcome_rejections(spark, sf_dir):
    states = s.outcome_states(outcomes(spark, sf_dir), as_of="1998-12-31")
    return states.groupBy(F.coalesce("rejected", F.lit("eligible")).alias("rejected")).agg(F.count(F.lit(1)).alias("rows"))


@query("outcome_readiness", "with " + SQL_STATES + """,
m as (select market, count(distinct period) as p from st where rejected is null group by 1)
select (select count(*) from st) as raw_observations, (select count(*) from st where rejected is null) as eligible, (select count(distinct period) from st where rejected is null) as periods,
  (select count(*) from m) as markets, (select count(*) from m where p >= 8) as deep_markets, '' as blockers, true as ready""")
def outcome_readiness(spark, sf_dir):
    return s.outcome_readiness(s.outcome_states(outcomes(spark, sf_dir), as_of="1998-12-31"))


@query("source_rights", """
select coalesce(o_orderpriority, '') as rights_status, count(*) as sources, cast(0 as bigint) as documented from orders where o_orderpriority not in ('1-URGENT') group by 1
union all select 'public_open', count(*), count(*) from orders where o_orderpriority = '1-URGENT'""")
def source_rights(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(
        F.lit("s").alias("source_name"), F.lit("n").alias("licensing_notes"), F.when(F.col("o_orderpriority") == "1-URGENT", "public_open").otherwise(F.col("o_orderpriority")).alias("rights_status"), F.lit(None).cast("string").alias("file_sha256"))
    judged = validate.rights_errors(rows)
    return judged.groupBy("rights_status").agg(F.count(F.lit(1)).alias("sources"), F.count_if((F.size("errors") == 0) & F.col("rights_documented")).alias("documented"))
