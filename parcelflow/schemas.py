"""Closed schemas and governed registries."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical observation columns and types.
OBSERVATION = T.StructType([
    T.StructField("observation_id", T.StringType(), False),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("source_dataset", T.StringType(), False),
    T.StructField("source_series", T.StringType(), False),
    T.StructField("source_version", T.StringType(), False),
    T.StructField("retrieved_at", T.TimestampType(), False),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("geography_type", T.StringType(), False),
    T.StructField("geography_id", T.StringType(), False),
    T.StructField("state_fips", T.StringType()),
    T.StructField("county_fips", T.StringType()),
    T.StructField("cbsa", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("submarket", T.StringType()),
    T.StructField("property_type", T.StringType()),
    T.StructField("property_subtype", T.StringType()),
    T.StructField("observation_date", T.DateType(), False),
    T.StructField("period_type", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DecimalType(38, 12), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("currency", T.StringType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("quality_level", T.StringType(), False),
    T.StructField("methodology", T.StringType()),
    T.StructField("transformation_version", T.StringType(), False),
    T.StructField("raw_source_reference", T.StringType(), False),
    T.StructField("raw_row_hash", T.StringType(), False),
    T.StructField("normalized_row_hash", T.StringType(), False),
])
OBSERVATION_COLUMNS = [f.name for f in OBSERVATION]
REQUIRED = [f.name for f in OBSERVATION if not f.nullable and f.name not in ("observation_id", "normalized_row_hash")]

# Enumerations.
GEOGRAPHY_TYPES = (
    "national", "state", "county", "county_subdivision", "cbsa", "place", "zip", "city", "submarket", "market", "property",
)
QUALITY_LEVELS = ("high", "moderate", "low", "unknown")
CORE_PROPERTY_TYPES = ("multifamily", "industrial", "office", "retail")
VERIFICATION_STATUSES = ("unverified", "analyst_verified", "rejected")
SOURCE_RELIABILITY = {
    "federal_public": 0.98, "state_local_public": 0.92, "academic_open": 0.88, "brokerage_public_report": 0.78,
    "public_brokerage_report": 0.78, "analyst_owned": 0.72, "public_company_filing": 0.90, "user_owned": 0.72,
    "licensed_local": 0.75, "manual_research": 0.60, "unknown": 0.40,
}
BLOCKING_FINDINGS = (
    "duplicate_observation", "source_conflict", "methodology_mismatch", "methodology_change", "frequency_mismatch",
    "market_geography_mismatch", "occupancy_vacancy_mismatch", "operating_unit_mismatch",
    "operating_identity_mismatch", "noi_margin_mismatch", "proxy_not_institutional_target",
)

LEDGER = T.StructType([
    T.StructField("source_id", T.StringType(), False),
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("source_version", T.StringType(), False),
    T.StructField("batch", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("rows", T.LongType(), False),
    T.StructField("earliest", T.DateType()),
    T.StructField("latest", T.DateType()),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("predecessor_hash", T.StringType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("manifest_hash", T.StringType(), False),
])


@dataclass(frozen=True)
class PublicMetric:
    metric: str
    unit: str
    measure_type: str
    aggregation: str
    geography_types: tuple[str, ...]
    frequencies: tuple[str, ...]
    minimum: float | None = None
    maximum: float | None = None


_REGIONAL = ("national", "state", "county", "cbsa", "place")
_ANY_FREQUENCY = ("daily", "weekly", "monthly", "quarterly", "annual")
_US = ("national",)


def _level(metric, unit):
    return PublicMetric(metric, unit, "level", "last_observation", _REGIONAL, _ANY_FREQUENCY)


def _market_rate(metric):
    return PublicMetric(metric, "percent", "rate", "mean", _US, ("daily", "weekly"))


def _survey(metric):
    return PublicMetric(metric, "percent_net_respondents", "rate", "mean", _US, ("quarterly",), -100.0, 100.0)


# Public metric registry (metric, unit, measure, aggregation, geographies, frequencies, range).
PUBLIC_METRICS = (
    _level("population", "persons"), _level("households", "households"),
    _level("median_household_income", "USD_current"), _level("per_capita_income", "USD_current"),
    _level("average_household_size", "persons_per_household"), _level("civilian_population_16_plus", "persons"),
    _level("bachelors_degree_population", "persons"), _level("housing_units", "units"),
    _level("occupied_housing_units", "units"), _level("vacant_housing_units", "units"),
    _level("employment", "persons"), _level("unemployment", "persons"), _level("labor_force", "persons"),
    _level("personal_income", "thousands_USD_current"), _level("personal_income_per_capita", "USD_current"),
    _level("gdp", "thousands_USD_current"), _level("units_authorized_total", "units"),
    _level("single_family_units_authorized", "units"), _level("multifamily_2_to_4_units_authorized", "units"),
    _level("multifamily_5_plus_units_authorized", "units"), _level("residential_permits_total", "permits"),
    _level("covered_employment", "persons"), _level("annual_average_establishments", "establishments"),
    _level("total_annual_wages", "USD_current"), _level("average_weekly_wage", "USD_current_per_week"),
    _level("average_annual_pay", "USD_current_per_year"),
    PublicMetric("county_cbsa_membership", "membership", "category", "not_applicable", ("county",), ("irregular",), 1.0, 1.0),
    PublicMetric("fair_market_rent", "USD_per_month", "level", "last_observation", ("county", "county_subdivision"), ("annual",), 0.0),
    PublicMetric("rental_vacancy_rate", "percent", "rate", "mean", ("national", "region", "state", "cbsa"), ("quarterly", "annual"), 0.0, 100.0),
    PublicMetric("median_asking_rent_vacant_units", "USD_current_per_month", "level", "last_observation", ("national", "region"), ("quarterly", "annual"), 0.0),
    PublicMetric("unemployment_rate", "percent", "rate", "mean", ("national", "state", "county", "cbsa"), ("monthly", "annual"), 0.0, 100.0),
    PublicMetric("fed_funds_rate", "percent", "rate", "mean", _US, ("daily",)),
    _market_rate("sofr"), _market_rate("treasury_2y"), _market_rate("treasury_5y"), _market_rate("treasury_10y"),
    _market_rate("treasury_30y"), _market_rate("mortgage_rate"),
    PublicMetric("cpi", "index_1982_1984_100", "index", "mean", _US, ("monthly",), 0.0),
    _survey("cre_lending_standards_multifamily"), _survey("cre_lending_standards_nonresidential"),
    _survey("cre_loan_demand_multifamily"), _survey("cre_loan_demand_nonresidential"),
    PublicMetric("cre_loan_delinquency_rate", "percent", "rate", "mean", _US, ("quarterly",), 0.0, 100.0),
    PublicMetric("cre_bank_loans", "billions_USD_current", "level", "mean", _US, ("monthly",), 0.0),
)


@dataclass(frozen=True)
class TargetMetric:
    metric: str
    property_types: tuple[str, ...]
    units: dict
    measure_type: str
    minimum: float | None
    maximum: float | None
    jump_threshold: float | None
    methodologies: tuple[str, ...]


_RENT_UNITS = {
    "multifamily": ("USD_per_unit_month", "USD_per_sf_month"), "industrial": ("USD_per_sf_year",),
    "office": ("USD_per_sf_year",), "retail": ("USD_per_sf_year",),
}
_SPACE_UNITS = {"multifamily": ("units",), "industrial": ("sf",), "office": ("sf",), "retail": ("sf",)}
_MF = ("multifamily",)
_COMMERCIAL = ("industrial", "office", "retail")


def _all(*units):
    return {t: tuple(units) for t in CORE_PROPERTY_TYPES}


def _target(metric, types, units, measure, low, high, jump, *methods):
    return TargetMetric(metric, tuple(types), {t: units[t] for t in types}, measure, low, high, jump, methods)


_F = _all("decimal_fraction")
_K = _all("USD_thousands_quarter")
_M = _all("USD_per_unit_month")
# Target metric registry (types, units, range, jump threshold, methodologies).
TARGET_METRICS = (
    _target("asking_rent", CORE_PROPERTY_TYPES, _RENT_UNITS, "level", 0, None, 0.35, "asking_rent", "gross_asking_rent", "net_asking_rent"),
    _target("effective_rent", ("multifamily", "industrial", "office"), _RENT_UNITS, "level", 0, None, 0.35, "effective_rent"),
    _target("average_monthly_revenue_per_occupied_home", _MF, _M, "level", 0, None, 0.35, "same_store_revenue_per_occupied_home"),
    _target("average_monthly_revenue_growth_yoy", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_revenue_per_occupied_home_yoy"),
    _target("average_rental_rate", _MF, _M, "level", 0, None, 0.35, "same_store_average_rental_rate"),
    _target("average_rental_rate_growth_yoy", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_average_rental_rate_yoy"),
    _target("rent_growth_yoy", CORE_PROPERTY_TYPES, _F, "signed_rate", -1, 3, 0.25, "same_store_yoy", "market_yoy", "asking_rent_yoy", "effective_rent_yoy"),
    _target("rent_growth_qoq", CORE_PROPERTY_TYPES, _F, "signed_rate", -1, 3, 0.15, "market_qoq", "asking_rent_qoq", "effective_rent_qoq"),
    _target("revenue_growth_yoy", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_revenue_yoy"),
    _target("revenue_growth_yoy_excluding_rent_relief", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_revenue_yoy_excluding_rent_relief"),
    _target("revenue_growth_yoy_cash_basis", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_revenue_yoy_cash_basis"),
    _target("operating_expense_growth_yoy", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_operating_expense_yoy"),
    _target("noi_growth_yoy", _MF, _F, "signed_rate", -1, 3, 0.25, "same_store_noi_yoy"),
    _target("same_store_revenue", _MF, _K, "level", 0, None, 0.50, "same_store_operating_revenue"),
    _target("same_store_operating_expense", _MF, _K, "level", 0, None, 0.50, "same_store_operating_expense"),
    _target("same_store_noi", _MF, _K, "level", 0, None, 0.50, "same_store_net_operating_income"),
    _target("noi_margin", _MF, _F, "rate", 0, 1, 0.15, "same_store_noi_margin"),
    _target("vacancy_rate", CORE_PROPERTY_TYPES, _F, "rate", 0, 1, 0.10, "market_vacancy", "physical_vacancy", "economic_vacancy"),
    _target("occupancy_rate", _MF, _F, "rate", 0, 1, 0.10, "physical_occupancy", "economic_occupancy"),
    _target("economic_vacancy_rate", _MF, _F, "rate", 0, 1, 0.10, "economic_vacancy"),
    _target("availability_rate", _COMMERCIAL, _F, "rate", 0, 1, 0.10, "market_availability"),
    _target("sublease_availability_rate", ("office",), _F, "rate", 0, 1, 0.10, "sublease_availability"),
    _target("transaction_cap_rate", CORE_PROPERTY_TYPES, _F, "rate", 0, 1, 0.10, "mean_transaction_cap_rate", "median_transaction_cap_rate", "market_cap_rate"),
    _target("concession_rate", _MF, _F, "rate", 0, 1, 0.10, "units_offering_concessions", "concession_value_pct_rent"),
    _target("net_absorption", CORE_PROPERTY_TYPES, _SPACE_UNITS, "flow", None, None, None, "net_absorption"),
    _target("deliveries", CORE_PROPERTY_TYPES, _SPACE_UNITS, "flow", 0, None, 0.50, "completed_new_supply"),
    _target("under_construction", CORE_PROPERTY_TYPES, _SPACE_UNITS, "level", 0, None, 0.50, "under_construction"),
    _target("inventory", CORE_PROPERTY_TYPES, _SPACE_UNITS, "level", 0, None, 0.50, "market_inventory", "same_store_inventory"),
    _target("transaction_volume", CORE_PROPERTY_TYPES, _all("USD", "transactions"), "level", 0, None, 0.50, "transaction_volume"),
    _target("sale_price_per_unit", _MF, _all("USD_per_unit"), "level", 0, None, 0.50, "mean_sale_price", "median_sale_price"),
    _target("sale_price_per_sf", _COMMERCIAL, _all("USD_per_sf"), "level", 0, None, 0.50, "mean_sale_price", "median_sale_price"),
)


def _dim(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def metric_dim(spark: SparkSession) -> DataFrame:
    """Public metric registry with one SHA-256 fingerprint per entry."""
    return _dim(
        spark, [asdict(m) for m in PUBLIC_METRICS],
        "metric string, unit string, measure_type string, aggregation string, geography_types array<string>, "
        "frequencies array<string>, minimum double, maximum double",
    )


def target_metric_dim(spark: SparkSession) -> DataFrame:
    """Target registry exploded to (metric, property_type) rows."""
    rows = [
        {
            "metric": m.metric, "property_type": t, "units": list(m.units[t]), "measure_type": m.measure_type,
            "minimum": None if m.minimum is None else float(m.minimum), "maximum": None if m.maximum is None else float(m.maximum),
            "jump_threshold": m.jump_threshold, "methodologies": list(m.methodologies),
        }
        for m in TARGET_METRICS for t in m.property_types
    ]
    return _dim(
        spark, rows,
        "metric string, property_type string, units array<string>, measure_type string, minimum double, maximum double, "
        "jump_threshold double, methodologies array<string>",
    )
