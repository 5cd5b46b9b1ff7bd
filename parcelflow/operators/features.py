"""Feature panels: one long table of values, built level by level from declarative specs.

Every spec of a level is computed in one aggregate or one self-join keyed by (feature,
geography, period), with the specs as a small constant table.  Values travel with their
availability date, quality rank and an order-free lineage digest; parent links live in a
separate edge table, so no row holds an unbounded list.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import hashing, numbers, periods

VALUE_COLUMNS = [
    "feature_name", "geography_type", "geography_id", "state_fips", "county_fips", "cbsa", "period_start", "value",
    "unit", "transformation", "available_at", "quality_level", "lineage_id",
]
EDGE_COLUMNS = ["lineage_id", "parent_id", "parent_kind"]


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str  # source, period_mean, period_end, growth, cagr, difference, ratio_per_1000, lag
    unit: str = ""
    metric: str | None = None
    source_ids: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    frequencies: tuple[str, ...] = ("annual", "quarterly")
    geographies: tuple[str, ...] = ("county", "cbsa")
    cbsa_sum: bool = False
    lag: int = 0
    subtype: str | None = None
    market_aggregation: str = "unsupported"

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"feature name must be an identifier: {self.name}")
        if self.kind == "source" and not self.metric:
            raise ValueError(f"source feature {self.name} needs one metric")
        if self.name == "market_rent" and self.metric == "fair_market_rent":
            raise ValueError("fair market rent cannot be registered as market rent")
        if self.lag < 0:
            raise ValueError("lag cannot be negative")

    def lag_periods(self, frequency: str) -> int:
        """Declared lags win; growth and plain differences look back one year."""
        per_year = 1 if frequency == "annual" else 4
        if self.kind == "cagr":
            return self.lag * per_year
        if self.kind == "growth":
            return per_year
        if self.kind == "difference":
            return self.lag or per_year
        return self.lag


def _source(name, metric, unit, source, cbsa=True, frequencies=("annual", "quarterly"), subtype=None):
    geographies = ("county", "cbsa") if cbsa else ("county",)
    return FeatureSpec(name, "source", unit, metric, (source,), (), frequencies, geographies, cbsa, 0, subtype)


def _derived(name, kind, inputs, unit="decimal_fraction", lag=0, frequencies=("annual", "quarterly"), market="portfolio_weighted_mean", geographies=("county", "cbsa")):
    return FeatureSpec(name, kind, unit, None, (), tuple(inputs), frequencies, geographies, False, lag, None, market)


def _macro(name, kind, metric, unit):
    return FeatureSpec(name, kind, unit, metric, ("fred_public",), market_aggregation="broadcast")


_A, _Q = ("annual",), ("quarterly",)
# Governed feature registry.
REGISTRY = (
    _source("population", "population", "persons", "census_acs"),
    _source("households", "households", "households", "census_acs"),
    _source("median_household_income", "median_household_income", "USD_current", "census_acs", cbsa=False),
    _source("per_capita_income", "per_capita_income", "USD_current", "census_acs", cbsa=False),
    _source("housing_units", "housing_units", "units", "census_acs"),
    _source("occupied_housing_units", "occupied_housing_units", "units", "census_acs"),
    _source("vacant_housing_units", "vacant_housing_units", "units", "census_acs"),
    _source("civilian_population_16_plus", "civilian_population_16_plus", "persons", "census_acs"),
    _source("personal_income", "personal_income", "thousands_USD_current", "bea_regional"),
    _source("gdp", "gdp", "thousands_USD_current", "bea_regional"),
    _source("covered_employment", "covered_employment", "persons", "bls_laus_ces"),
    _source("housing_units_authorized", "units_authorized_total", "units", "census_bps", frequencies=_A),
    _source("multifamily_5plus_units_authorized", "multifamily_5_plus_units_authorized", "units", "census_bps", frequencies=_A),
    _source("fair_market_rent_2br", "fair_market_rent", "USD_per_month", "hud_public", cbsa=False, subtype="two_bedroom"),
    _derived("population_growth_yoy", "growth", ["population"]),
    _derived("population_growth_3y_cagr", "cagr", ["population"], lag=3),
    _derived("household_growth_yoy", "growth", ["households"]),
    _derived("covered_employment_growth_yoy", "growth", ["covered_employment"]),
    _derived("personal_income_growth_yoy", "growth", ["personal_income"]),
    _derived("housing_unit_growth_yoy", "growth", ["housing_units"]),
    _derived("multifamily_5plus_units_growth_yoy", "growth", ["multifamily_5plus_units_authorized"], frequencies=_A, market="unsupported"),
    _derived("fmr_2br_growth_yoy", "growth", ["fair_market_rent_2br"], market="unsupported", geographies=("county",)),
    _derived("multifamily_permits_per_1000_population", "ratio_per_1000", ["multifamily_5plus_units_authorized", "population"], "units_per_1000_persons", frequencies=_A),
    _macro("treasury_10y_mean", "period_mean", "treasury_10y", "percent"),
    _macro("treasury_10y_period_end", "period_end", "treasury_10y", "percent"),
    _derived("treasury_10y_change_1y", "difference", ["treasury_10y_period_end"], "percentage_points", market="broadcast"),
    _derived("treasury_10y_change_2q", "difference", ["treasury_10y_period_end"], "percentage_points", 2, _Q, "broadcast"),
    _macro("cpi_period_end", "period_end", "cpi", "index_1982_1984_100"),
    _derived("cpi_growth_yoy", "growth", ["cpi_period_end"], market="broadcast"),
    _derived("population_growth_yoy_lag_1y", "lag", ["population_growth_yoy"], lag=1, frequencies=_A),
    _derived("multifamily_permits_per_1000_population_lag_1y", "lag", ["multifamily_permits_per_1000_population"], "units_per_1000_persons", 1, _A),
    _derived("population_growth_yoy_lag_1q", "lag", ["population_growth_yoy"], lag=1, frequencies=_Q),
    _derived("population_growth_yoy_lag_2q", "lag", ["population_growth_yoy"], lag=2, frequencies=_Q),
    _derived("population_growth_yoy_lag_4q", "lag", ["population_growth_yoy"], lag=4, frequencies=_Q),
    _derived("treasury_10y_change_2q_lag_1q", "lag", ["treasury_10y_change_2q"], "percentage_points", 1, _Q, "broadcast"),
    _derived("treasury_10y_change_2q_lag_2q", "lag", ["treasury_10y_change_2q"], "percentage_points", 2, _Q, "broadcast"),
)


def specs_for(specs, frequency: str, geography: str) -> list[FeatureSpec]:
    if frequency not in ("annual", "quarterly") or geography not in ("county", "cbsa"):
        raise ValueError("feature panels are annual or quarterly, by county or cbsa")
    return [s for s in specs if frequency in s.frequencies and geography in s.geographies]


def registry_fingerprint(specs=REGISTRY) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps([asdict(s) for s in sorted(specs, key=lambda s: s.name)], sort_keys=True).encode()).hexdigest()


def levels(specs: list[FeatureSpec]) -> list[list[FeatureSpec]]:
    """Derived specs grouped so that each level only reads earlier ones; a cycle is an error."""
    names = {s.name for s in specs}
    done = {s.name for s in specs if not s.inputs}
    waiting, out = [s for s in specs if s.inputs], []
    while waiting:
        ready = [s for s in waiting if all(i in done or i not in names for i in s.inputs)]
        if not ready:
            raise ValueError(f"feature registry contains a cycle at {waiting[0].name}")
        out.append(ready)
        done |= {s.name for s in ready}
        waiting = [s for s in waiting if s.name not in done]
    return out


def quality_rank(level: Column) -> Column:
    """Worst-of order; unknown ranks below moderate and above low."""
    return F.when(level == "high", 3).when(level == "moderate", 2).when(level == "unknown", 1).otherwise(0)


def quality_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "moderate").when(rank == 1, "unknown").otherwise("low")


def worst_quality(left: Column, right: Column) -> Column:
    return quality_name(F.least(quality_rank(left), quality_rank(right)))


def _id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _spec_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def source_groups(facts: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """AGG-05/06, SET-04: one aggregate for every source spec, with the conflict test in the same pass."""
    sources = [s for s in specs if s.kind == "source"]
    dim = _spec_rows(
        facts.sparkSession,
        [(s.metric, source, s.subtype, s.name, s.unit) for s in sources for source in s.source_ids],
        "metric string, source_id string, wanted_subtype string, feature_name string, feature_unit string",
    )
    rows = facts.filter("geography_type = 'county' AND period_type = 'annual'")
    subtype = F.col("property_subtype") if "property_subtype" in facts.columns else F.lit(None).cast("string")
    rows = rows.join(dim, ["metric", "source_id"]).filter(
        F.col("wanted_subtype").isNull() | F.coalesce(subtype == F.col("wanted_subtype"), F.lit(False))
    )
    variant = F.struct(*[F.col(c).cast("string") for c in ("value", "unit", "source_series", "source_dataset", "source_version")])
    return rows.groupBy("feature_name", "feature_unit", "geography_id", F.year("observation_date").alias("year")).agg(
        F.any_value("state_fips", True).alias("state_fips"), F.any_value("county_fips", True).alias("county_fips"), F.any_value("cbsa", True).alias("cbsa"),
        F.min(F.col("value").cast("double")).alias("value"), F.count(F.lit(1)).alias("copies"),
        F.max("as_of_date").alias("available_at"), quality_name(F.min(quality_rank(F.col("quality_level")))).alias("quality_level"),
        (F.min(variant) != F.max(variant)).alias("conflict"),
        hashing.order_free_digest(F.sha2("observation_id", 256)).alias("inputs_digest"),
    )


def source_features(groups: DataFrame, frequency: str) -> DataFrame:
    """FEA-01/02: annual county values, carried to quarter starts with availability unchanged."""
    months = [1] if frequency == "annual" else [1, 4, 7, 10]
    label = "source_last_observation; original_frequency=annual" if frequency == "annual" else "annual_carry_forward; original_frequency=annual; no interpolation"
    expanded = groups.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    expanded = expanded.withColumn("period_start", F.make_date("year", "month", F.lit(1)))
    transformation = F.concat(
        F.lit(label),
        F.when(F.col("copies") > 1, F.concat(F.lit("; exact_duplicate_collapse="), F.col("copies").cast("string"))).otherwise(""),
    )
    return expanded.select(
        "feature_name", F.lit("county").alias("geography_type"), "geography_id", "state_fips", "county_fips", "cbsa", "period_start", "value",
        F.col("feature_unit").alias("unit"), transformation.alias("transformation"), "available_at", "quality_level",
        _id(F.col("feature_name"), F.col("geography_id"), F.col("period_start").cast("string"), F.col("inputs_digest")).alias("lineage_id"),
    )


def cbsa_sums(values: DataFrame, crosswalk: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """FEA-03, AGG-07, JN-02: additive county features rolled up through the current crosswalk."""
    names = [s.name for s in specs if s.kind == "source" and s.cbsa_sum]
    members = crosswalk.select("county_fips", F.col("cbsa").alias("area"), F.col("as_of_date").alias("member_since"))
    rows = values.filter(F.col("feature_name").isin(names) & (F.col("geography_type") == "county")).join(members, "county_fips")
    grouped = rows.groupBy("feature_name", F.col("area"), "period_start").agg(
        F.sum("value").alias("value"), F.any_value("unit").alias("unit"),
        F.greatest(F.max("available_at"), F.max("member_since")).alias("available_at"),
        quality_name(F.min(quality_rank(F.col("quality_level")))).alias("quality_level"),
        hashing.order_free_digest(F.col("lineage_id")).alias("inputs_digest"),
    )
    return grouped.select(
        "feature_name", F.lit("cbsa").alias("geography_type"), F.col("area").alias("geography_id"), F.lit(None).cast("string").alias("state_fips"),
        F.lit(None).cast("string").alias("county_fips"), F.col("area").alias("cbsa"), "period_start", "value", "unit",
        F.lit("source_backed_county_to_cbsa_sum; current crosswalk vintage").alias("transformation"), "available_at", "quality_level",
        _id(F.col("feature_name"), F.col("area"), F.col("period_start").cast("string"), F.col("inputs_digest")).alias("lineage_id"),
    )


def macro_values(facts: DataFrame, specs: list[FeatureSpec], frequency: str) -> DataFrame:
    """FEA-04/05, AGG-08/09: period mean and period end of original-frequency national series."""
    macros = [s for s in specs if s.kind in ("period_mean", "period_end")]
    unit = "year" if frequency == "annual" else "quarter"
    dim = _spec_rows(
        facts.sparkSession, [(s.metric, source, s.name, s.kind, s.unit) for s in macros for source in s.source_ids],
        "metric string, source_id string, feature_name string, kind string, feature_unit string",
    )
    rows = facts.filter(F.col("metric").isin([s.metric for s in macros])).join(dim, ["metric", "source_id"])
    last = F.max_by(
        F.struct(F.col("value").cast("double").alias("value"), "as_of_date", "quality_level", "observation_id"),
        F.struct("observation_date", "observation_id"),
    )
    grouped = rows.groupBy("feature_name", "kind", "feature_unit", F.to_date(F.date_trunc(unit, "observation_date")).alias("period_start")).agg(
        F.avg(F.col("value").cast("double")).alias("mean"), F.max("as_of_date").alias("mean_available"),
        quality_name(F.min(quality_rank(F.col("quality_level")))).alias("mean_quality"), last.alias("last"),
        hashing.order_free_digest(F.sha2("observation_id", 256)).alias("inputs_digest"),
    )
    mean = F.col("kind") == "period_mean"
    inputs = F.when(mean, F.col("inputs_digest")).otherwise(F.col("last.observation_id"))
    return grouped.select(
        "feature_name", F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), *[F.lit(None).cast("string").alias(c) for c in ("state_fips", "county_fips", "cbsa")],
        "period_start", F.when(mean, F.col("mean")).otherwise(F.col("last.value")).alias("value"), F.col("feature_unit").alias("unit"),
        F.concat("kind", F.lit("_broadcast; original-frequency national aggregation")).alias("transformation"),
        F.when(mean, F.col("mean_available")).otherwise(F.col("last.as_of_date")).alias("available_at"),
        F.when(mean, F.col("mean_quality")).otherwise(F.col("last.quality_level")).alias("quality_level"),
        _id(F.col("feature_name"), F.lit("US"), F.col("period_start").cast("string"), inputs).alias("lineage_id"),
    )


SPINE = ["geography_id", "state_fips", "county_fips", "cbsa", "period_start"]


def panel_spine(values: DataFrame, geography: str) -> DataFrame:
    return values.filter(F.col("geography_type") == geography).select(*SPINE).distinct()


def broadcast_macro(macro: DataFrame, spine: DataFrame, geography: str) -> DataFrame:
    """JN-06: national values on every local geography-period; the macro side is periods x specs."""
    national = macro.select("feature_name", "period_start", "value", "unit", "available_at", "quality_level", F.col("lineage_id").alias("parent_id"))
    joined = spine.join(national, "period_start")
    return joined.select(
        "feature_name", F.lit(geography).alias("geography_type"), *SPINE[:-1], "period_start", "value", "unit",
        F.lit("national_broadcast; value is not a local observation").alias("transformation"), "available_at", "quality_level",
        _id(F.col("feature_name"), F.col("geography_id"), F.col("period_start").cast("string"), F.col("parent_id")).alias("lineage_id"),
        F.array("parent_id").alias("parents"),
    )


def derive(values: DataFrame, specs: list[FeatureSpec], geography: str, frequency: str, spine: DataFrame | None = None) -> DataFrame:
    """FEA-06..09: all growth, CAGR and difference specs in one shifted self-join, ratios in another."""
    local = values.filter(F.col("geography_type") == geography)
    parts = []
    shifted = [s for s in specs if s.kind in ("growth", "cagr", "difference")]
    if shifted:
        dim = _spec_rows(
            values.sparkSession, [(s.inputs[0], s.name, s.kind, s.lag_periods(frequency), max(s.lag, 1), s.unit) for s in shifted],
            "feature_name string, output string, kind string, lag int, years int, output_unit string",
        )
        months = 12 if frequency == "annual" else 3
        current = local.join(dim, "feature_name")
        prior = local.join(dim.select("feature_name", "output", "lag"), "feature_name").select(
            "output", "geography_id", F.add_months("period_start", F.col("lag") * months).alias("period_start"),
            F.col("value").alias("prior"), F.col("available_at").alias("prior_available"), F.col("quality_level").alias("prior_quality"),
            F.col("lineage_id").alias("prior_id"),
        )
        joined = current.join(prior, ["output", "geography_id", "period_start"])
        change = numbers.ratio(F.col("value"), F.col("prior"))
        value = (
            F.when(F.col("kind") == "growth", change - 1)
            .when((F.col("kind") == "cagr") & (change > 0), F.pow(change, F.lit(1.0) / F.col("years")) - 1)
            .when(F.col("kind") == "difference", F.col("value") - F.col("prior"))
        )
        text = F.concat("kind", F.lit("; exact lag="), F.col("lag").cast("string"), F.lit(f" {frequency} period(s); missing periods omitted"))
        parts.append(_finish(
            joined.withColumn("result", value).filter("result IS NOT NULL"), text,
            F.greatest("available_at", "prior_available"), worst_quality(F.col("quality_level"), F.col("prior_quality")),
            F.array("prior_id", "lineage_id"),
        ))
    ratios = [s for s in specs if s.kind == "ratio_per_1000"]
    if ratios:
        dim = _spec_rows(values.sparkSession, [(s.inputs[0], s.inputs[1], s.name, s.unit) for s in ratios], "feature_name string, denominator string, output string, output_unit string")
        left = local.join(dim, "feature_name")
        right = local.join(dim.select(F.col("denominator").alias("feature_name"), "output"), "feature_name").filter("value <> 0").select(
            "output", "geography_id", "period_start", F.col("value").alias("prior"), F.col("available_at").alias("prior_available"),
            F.col("quality_level").alias("prior_quality"), F.col("lineage_id").alias("prior_id"),
        )
        joined = left.join(right, ["output", "geography_id", "period_start"])
        parts.append(_finish(
            joined.withColumn("result", F.col("value") / F.col("prior") * 1000.0), F.lit("ratio_per_1000; exact matching period; no missing-value substitution"),
            F.greatest("available_at", "prior_available"), worst_quality(F.col("quality_level"), F.col("prior_quality")), F.array("lineage_id", "prior_id"),
        ))
    lags = [s for s in specs if s.kind == "lag"]
    if lags:
        parts.append(lag_features(values, lags, geography, frequency, panel_spine(values, geography) if spine is None else spine))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _finish(joined: DataFrame, text: Column, available: Column, quality: Column, parents: Column) -> DataFrame:
    return joined.select(
        F.col("output").alias("feature_name"), "geography_type", *SPINE[:-1], "period_start", F.col("result").alias("value"), F.col("output_unit").alias("unit"),
        text.alias("transformation"), available.alias("available_at"), quality.alias("quality_level"),
        _id(F.col("output"), F.col("geography_id"), F.col("period_start").cast("string"), F.array_join(parents, ",")).alias("lineage_id"), parents.alias("parents"),
    )


def lag_features(values: DataFrame, specs: list[FeatureSpec], geography: str, frequency: str, spine: DataFrame) -> DataFrame:
    """FEA-10: the value n periods earlier, on the full spine (the source may be absent now)."""
    months = 12 if frequency == "annual" else 3
    dim = _spec_rows(values.sparkSession, [(s.inputs[0], s.name, s.lag, s.unit) for s in specs], "feature_name string, output string, lag int, output_unit string")
    prior = values.filter(F.col("geography_type") == geography).join(dim, "feature_name").select(
        "output", "output_unit", "lag", "geography_id", F.add_months("period_start", F.col("lag") * months).alias("period_start"),
        F.col("value").alias("result"), "available_at", "quality_level", "lineage_id",
    )
    joined = spine.withColumn("geography_type", F.lit(geography)).join(prior, ["geography_id", "period_start"])
    text = F.concat(F.lit("lag; exact lag="), F.col("lag").cast("string"), F.lit(f" {frequency} period(s); missing periods omitted"))
    return _finish(joined, text, F.col("available_at"), F.col("quality_level"), F.array("lineage_id"))


def pivot_panel(values: DataFrame, names: list[str], geography: str, frequency: str) -> DataFrame:
    """AGG-10: one row per geography-period with value and availability per feature."""
    rows = values.filter(F.col("geography_type") == geography)
    aggregates = []
    for name in names:
        hit = F.col("feature_name") == name
        aggregates += [F.max(F.when(hit, F.col("value"))).alias(name), F.max(F.when(hit, F.col("available_at"))).alias(f"{name}__available_at")]
    panel = rows.groupBy("geography_type", "geography_id", "period_start").agg(
        F.max("state_fips").alias("state_fips"), F.max("county_fips").alias("county_fips"), F.max("cbsa").alias("cbsa"), *aggregates
    )
    quarter = F.quarter("period_start") if frequency == "quarterly" else F.lit(None).cast("int")
    return panel.withColumns({"year": F.year("period_start"), "quarter": quarter})


def profile_panel(values: DataFrame, frequency: str) -> DataFrame:
    """AGG-04: one aggregate of integrity counters over the long table."""
    key = F.struct("geography_type", "geography_id", "period_start", "feature_name")
    months = [1] if frequency == "annual" else [1, 4, 7, 10]
    return values.agg(
        F.count(F.lit(1)).alias("feature_values"), F.countDistinct("lineage_id").alias("unique_lineage_ids"), F.countDistinct(key).alias("unique_keys"),
        F.countDistinct("geography_id").alias("geographies"), F.min("period_start").alias("earliest"), F.max("period_start").alias("latest"),
        F.count_if(~numbers.finite(F.col("value"))).alias("non_finite_values"),
        F.count_if(F.col("transformation").contains("missing_to_zero") | F.col("transformation").contains("linear_interpolation")).alias("forbidden_imputation_labels"),
        F.count_if(~F.month("period_start").isin(months)).alias("invalid_period_starts"),
    ).withColumn("duplicate_feature_keys", F.col("feature_values") - F.col("unique_keys")).drop("unique_keys")
