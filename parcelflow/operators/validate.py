"""Row validation as error arrays, with a valid/quarantine split instead of exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import keyed, numbers, periods
from parcelflow.functions.hashing import row_digest
from parcelflow.schemas import (
    CORE_PROPERTY_TYPES, GEOGRAPHY_TYPES, OBSERVATION_COLUMNS, QUALITY_LEVELS, REQUIRED, SOURCE_RELIABILITY,
    VERIFICATION_STATUSES,
)

SHA256 = r"^[0-9a-f]{64}$"


def errors(checks: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds; a null condition counts as not holding.

    No lambda: Spark would interpret, not compile, every condition below one.
    """
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()])
    return F.array_except(found, F.array(F.lit(None).cast("string")))


def any_of(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds; compiled, where ``exists`` is interpreted."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column.cast("string")) == "")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) by the ``errors`` column."""
    return df.filter(F.size("errors") == 0).drop("errors"), df.filter(F.size("errors") > 0)


def geography_checks(geography_type="geography_type", geography_id="geography_id", state="state_fips", county="county_fips", cbsa="cbsa") -> dict:
    """VAL-03."""
    return {
        "geography_type_unsupported": ~F.coalesce(F.col(geography_type).isin(*GEOGRAPHY_TYPES), F.lit(False)),
        "geography_id_missing": blank(F.col(geography_id)),
        "state_fips_invalid": F.col(state).isNotNull() & ~F.col(state).rlike(r"^\d{2}$"),
        "county_fips_invalid": F.col(county).isNotNull() & ~F.col(county).rlike(r"^\d{5}$"),
        "cbsa_invalid": F.col(cbsa).isNotNull() & ~F.col(cbsa).rlike(r"^\d{5}$"),
    }


def observation_errors(df: DataFrame) -> DataFrame:
    """VAL-01/02/03 over raw text columns: adds normalised fields, hashes and ``errors``."""
    unknown = sorted(set(df.columns) - set(OBSERVATION_COLUMNS))
    if unknown:
        raise ValueError(f"unknown observation fields: {unknown}")
    for name in OBSERVATION_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    period = periods.normalize_period("observation_date", F.col("period_type"))
    value = F.col("value").try_cast("double")
    count = F.col("sample_count").cast("string")
    retrieved = F.col("retrieved_at").cast("string")
    checks = {
        "missing_required": any_of([blank(F.col(c)) for c in REQUIRED]),
        "period_invalid": ~period["valid"],
        **geography_checks(),
        "value_not_numeric": ~blank(F.col("value")) & value.isNull(),
        "value_not_finite": value.isNotNull() & ~numbers.finite(value),
        "sample_count_invalid": F.col("sample_count").isNotNull() & ~count.rlike(r"^\d+$"),
        "quality_level_invalid": ~F.coalesce(F.col("quality_level").isin(*QUALITY_LEVELS), F.lit(False)),
        "retrieved_at_without_zone": ~blank(F.col("retrieved_at")) & ~retrieved.rlike(r"(Z|[+-]\d{2}:?\d{2})$"),
        "raw_row_hash_invalid": ~blank(F.col("raw_row_hash")) & ~F.col("raw_row_hash").rlike(r"^sha256:[0-9a-f]{64}$"),
    }
    out = df.withColumn("errors", errors(checks)).withColumns({
        "observation_date": period["start"], "period_type": period["period_type"],
        "value": F.col("value").try_cast("decimal(38,12)"), "sample_count": F.col("sample_count").try_cast("long"),
        "as_of_date": F.try_to_date(F.col("as_of_date").cast("string"), "yyyy-MM-dd"),
        "retrieved_at": F.try_to_timestamp(F.col("retrieved_at").cast("string")),
    })
    payload = [c for c in OBSERVATION_COLUMNS if c not in ("observation_id", "normalized_row_hash")]
    digest = row_digest(payload)
    supplied = F.col("normalized_row_hash")
    out = out.withColumn("__digest", F.concat(F.lit("sha256:"), digest))
    mismatch = ~blank(supplied) & (supplied != F.col("__digest"))
    return out.withColumns({
        "errors": F.when(mismatch, F.array_append("errors", F.lit("normalized_row_hash_mismatch"))).otherwise(F.col("errors")),
        "normalized_row_hash": F.col("__digest"),
        "observation_id": F.when(blank(F.col("observation_id")), F.substring("__digest", 8, 64)).otherwise(F.col("observation_id")),
    }).select(*OBSERVATION_COLUMNS, "errors")


def crosswalk_errors(df: DataFrame) -> DataFrame:
    """VAL-04."""
    return df.withColumn("errors", errors({
        "county_state_inconsistent": ~F.coalesce(F.col("county_fips").rlike(r"^\d{5}$") & (F.substring("county_fips", 1, 2) == F.col("state_fips")), F.lit(False)),
        "cbsa_invalid": F.col("cbsa").isNotNull() & ~F.col("cbsa").rlike(r"^\d{5}$"),
        "dates_reversed": F.col("effective_to").isNotNull() & (F.col("effective_to") < F.col("effective_from")),
    }))


RECORD_REQUIRED = (
    "market", "geography_type", "geography_id", "period", "frequency", "property_type", "metric", "value", "unit",
    "source_name", "source_identifier", "source_period", "retrieved_at", "methodology", "vintage", "licensing_notes",
    "verification_status",
)


def record_errors(df: DataFrame, dim: DataFrame) -> DataFrame:
    """VAL-05: target records against the per-property-type metric registry (a fixed small table)."""
    text = [c for c in df.columns if dict(df.dtypes)[c] == "string"]
    df = df.withColumn("property_type", F.lower(F.trim("property_type")))
    rules = dim.select(
        "metric", "property_type", F.col("units").alias("__units"), F.col("methodologies").alias("__methods"),
        F.col("minimum").alias("__low"), F.col("maximum").alias("__high"),
    )
    df = df.join(F.broadcast(rules), ["metric", "property_type"], "left")
    value = F.col("value").try_cast("double")
    period = periods.normalize_period("period", F.col("frequency"))
    source_period = periods.normalize_period("source_period", F.col("frequency"))
    released = F.col("release_date").cast("string")
    release = F.when(released.rlike(periods.ISO_DAY), released.try_cast("date")).otherwise(F.try_to_date(released, "yyyy-MM-dd"))
    retrieved = F.try_to_timestamp(F.col("retrieved_at").cast("string"))
    known = F.col("__units").isNotNull()
    count = F.col("sample_count").cast("string")
    checks = {
        "missing_required": any_of([blank(F.col(c)) for c in RECORD_REQUIRED if c in df.columns]),
        "formula_prohibited": any_of([F.substring(F.ltrim(F.col(c)), 1, 1).isin("=", "+", "@") for c in text]),
        "property_type_unsupported": ~F.coalesce(F.col("property_type").isin(*CORE_PROPERTY_TYPES), F.lit(False)),
        "metric_not_governed": ~known,
        "unit_invalid": known & ~F.array_contains("__units", F.col("unit")),
        "methodology_invalid": known & ~F.array_contains("__methods", F.col("methodology")),
        "period_invalid": ~period["valid"],
        "source_period_mismatch": ~F.coalesce(source_period["valid"] & (source_period["label"] == period["label"]), F.lit(False)),
        **geography_checks(),
        "value_not_numeric": ~blank(F.col("value")) & value.isNull(),
        "value_out_of_range": known & value.isNotNull() & (F.coalesce(value < F.col("__low"), F.lit(False)) | F.coalesce(value > F.col("__high"), F.lit(False)) | ~numbers.finite(value)),
        "verification_status_invalid": ~F.coalesce(F.lower("verification_status").isin(*VERIFICATION_STATUSES), F.lit(False)),
        "source_class_unsupported": ~F.coalesce(F.lower("source_class"), F.lit("unknown")).isin(*SOURCE_RELIABILITY),
        "release_date_invalid": ~blank(F.col("release_date")) & release.isNull(),
        "release_before_period": release < period["start"],
        "retrieved_at_invalid": ~blank(F.col("retrieved_at")) & retrieved.isNull(),
        "retrieved_before_release": F.to_date(retrieved) < release,
        "sample_count_invalid": ~blank(count) & ~count.rlike(r"^\d+$"),
        "redistribution_invalid": ~F.coalesce(F.lower("redistribution_permitted"), F.lit("unknown")).isin("yes", "no", "unknown"),
    }
    out = df.withColumn("errors", errors(checks)).drop("__units", "__methods", "__low", "__high")
    return out.withColumns({
        "value": F.col("value").try_cast("decimal(38,12)"), "period": period["label"], "observation_date": period["start"],
        "release_date": release, "retrieved_at": retrieved, "verification_status": F.lower("verification_status"),
    })


def panel_row_errors(df: DataFrame, rates: list[str], levels: list[str], property_types: tuple[str, ...]) -> DataFrame:
    """VAL-08: wide market-panel rows; a bad row is quarantined and the file continues."""
    metrics = [c for c in [*rates, *levels] if c in df.columns]
    number = lambda c: F.col(c).try_cast("double")
    text = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumn("errors", errors({
        "formula_prohibited": F.exists(F.array(*[F.coalesce(F.ltrim(F.col(c)), F.lit("")) for c in text]), lambda v: v.rlike("^[=+@]")),
        "period_invalid": F.try_to_date(F.col("period").cast("string"), "yyyy-MM-dd").isNull(),
        "source_date_invalid": F.try_to_date(F.col("source_date").cast("string"), "yyyy-MM-dd").isNull(),
        "county_fips_invalid": ~blank(F.col("county_fips")) & ~F.col("county_fips").rlike(r"^\d{5}$"),
        "property_type_unsupported": ~F.coalesce(F.col("property_type").isin(*property_types), F.lit(False)),
        "identity_blank": F.exists(F.array(*[blank(F.col(c)) for c in ("market_id", "market_name", "source", "source_reference", "usage_rights")]), lambda b: b),
        "metric_invalid": F.exists(F.array(*[~blank(F.col(c)) & ~numbers.finite(number(c)) for c in metrics]), lambda b: F.coalesce(b, F.lit(False))),
        "rate_out_of_range": F.exists(F.array(F.lit(False), *[F.coalesce(~number(c).between(-1, 1), F.lit(False)) for c in metrics if c in rates]), lambda b: b),
        "no_metric": F.forall(F.array(*[blank(F.col(c)) for c in metrics]), lambda b: b),
    }))


def evidence_errors(df: DataFrame, decimals: list[str], rates: list[str], counts: list[str], as_of: str = "analysis_as_of") -> DataFrame:
    """VAL-09: screening evidence ranges, evidence dates not after the analysis date, hash arrays."""
    number = lambda c: F.col(c).try_cast("decimal(38,12)")
    any_of = lambda items: F.exists(F.array(F.lit(False), *[F.coalesce(i, F.lit(False)) for i in items]), lambda b: b)
    return df.withColumn("errors", errors({
        "decimal_invalid": any_of([F.col(c).isNotNull() & (number(c).isNull() | (number(c) < 0)) for c in decimals]),
        "rate_above_one": any_of([number(c) > 1 for c in rates]),
        "count_negative": any_of([F.col(c) < 0 for c in counts]),
        "future_evidence": F.exists(F.map_values("evidence_dates"), lambda d: d > F.col(as_of)),
        "hash_invalid": F.exists(F.flatten(F.map_values("evidence_hashes")), lambda h: ~h.rlike(SHA256)),
    }))


# Governed economic evidence fields, their unit and kind; source types.
ECONOMIC_FIELDS = {
    "purchase_price": ("USD", "positive"), "renovation_budget": ("USD", "amount"), "closing_costs": ("USD", "amount"),
    "holding_costs": ("USD", "amount"), "annual_property_taxes": ("USD/year", "amount"), "annual_insurance": ("USD/year", "amount"),
    "annual_utilities": ("USD/year", "amount"), "annual_other_operating_costs": ("USD/year", "amount"),
    "vacancy_rate": ("decimal_fraction", "rate"), "concessions_rate": ("decimal_fraction", "rate"), "loan_amount": ("USD", "amount"),
    "interest_rate": ("decimal_fraction", "rate"), "amortization_years": ("years", "years"), "loan_term_years": ("years", "years"),
}
ECONOMIC_SOURCE_TYPES = ("analyst_entered", "document_evidence", "public_record", "user_owned")


def economic_errors(df: DataFrame, extra_source_types: tuple[str, ...] = ()) -> DataFrame:
    """VAL-10: one row per (subject_id, field); duplicates are counted with a splittable join.

    ``extra_source_types`` admits the hand-off types of other systems.
    """
    spec = F.create_map(*[F.lit(v) for field, (unit, kind) in ECONOMIC_FIELDS.items() for v in (field, f"{unit}|{kind}")])
    found = spec[F.col("field")]
    unit, kind = F.split_part(found, F.lit("|"), F.lit(1)), F.split_part(found, F.lit("|"), F.lit(2))
    value = F.col("value").try_cast("decimal(38,12)")
    counted = keyed.with_group_stats(df, ["subject_id", "field"], F.count(F.lit(1)).alias("__copies"))
    return counted.withColumn("errors", errors({
        "field_unsupported": found.isNull(),
        "field_duplicated": F.col("__copies") > 1,
        "unit_mismatch": found.isNotNull() & ~F.coalesce(F.col("unit") == unit, F.lit(False)),
        "value_invalid": value.isNull(),
        "value_out_of_range": ((kind == "amount") & (value < 0)) | ((kind == "positive") & (value <= 0))
        | ((kind == "rate") & ~value.between(0, 1)) | ((kind == "years") & ~value.between(1, 100)),
        "source_incomplete": ~F.coalesce(F.col("source_type").isin(*ECONOMIC_SOURCE_TYPES, *extra_source_types), F.lit(False))
        | blank(F.col("source_reference")) | blank(F.col("licensing_notes")) | F.col("as_of_date").isNull(),
        "future_evidence": F.col("as_of_date") > F.col("analysis_as_of"),
    })).drop("__copies")


OUTCOME_FIELDS = (
    "observation_id", "property_id", "market_id", "period", "property_type", "forecast_origin", "feature_available_at",
    "outcome_realized_at", "outcome_released_at", "outcome", "outcome_value", "data_status", "source_hash", "feature_hash",
    "source_name", "source_record_id", "licensing_notes", "methodology",
)
OUTCOME_PERIOD = r"^\d{4}-(Q[1-4]|\d{2})$"


def outcome_findings(df: DataFrame, as_of) -> DataFrame:
    """VAL-11: long (row_number, severity, code) findings for realised-outcome rows."""
    day = lambda c: F.try_to_date(F.trim(F.col(c).cast("string")), "yyyy-MM-dd")
    origin, feature, realized, released = (day(c) for c in ("forecast_origin", "feature_available_at", "outcome_realized_at", "outcome_released_at"))
    value = F.col("outcome_value").cast("string").try_cast("double")
    missing = F.exists(F.array(*[blank(F.col(c)) for c in OUTCOME_FIELDS]), lambda b: b)
    complete = ~missing
    parsed = complete & origin.isNotNull() & feature.isNotNull() & realized.isNotNull() & released.isNotNull() & value.isNotNull()
    hexed = lambda c: F.col(c).cast("string").rlike("^[0-9a-fA-F]{64}$")
    as_of = F.lit(as_of).cast("date")
    marked = df.withColumn("__codes", errors({
        "missing_required_value": missing,
        "date_or_value_invalid": complete & ~parsed,
        "future_feature_leakage": parsed & (feature > origin),
        "outcome_timing_invalid": parsed & ((realized <= origin) | (released < realized)),
        "outcome_not_released_as_of_review": parsed & (released > as_of),
        "extreme_outcome_value": parsed & ~value.between(-10, 10),
        "non_real_data": parsed & (F.col("data_status") != "real"),
        "lineage_hash_invalid": parsed & ~(hexed("source_hash") & hexed("feature_hash")),
        "period_invalid": parsed & ~F.col("period").rlike(OUTCOME_PERIOD),
    })).withColumn("__complete", complete)
    rowwise = marked.select("row_number", F.explode("__codes").alias("code"))
    complete_rows = marked.filter("__complete").select("row_number", "observation_id", "property_id", "forecast_origin", "outcome")
    duplicates = []
    for code, keys in (("duplicate_observation_id", ["observation_id"]), ("duplicate_property_origin_outcome", ["property_id", "forecast_origin", "outcome"])):
        rows = keyed.rows_of_groups(complete_rows, keys, F.col("__n") > 1, F.count(F.lit(1)).alias("__n"))
        duplicates.append(rows.select("row_number", F.lit(code).alias("code")))
    found = rowwise.unionByName(duplicates[0]).unionByName(duplicates[1])
    severity = F.when(F.col("code") == "extreme_outcome_value", "warning").otherwise("blocking")
    return found.select("row_number", severity.alias("severity"), "code")


def market_definition_errors(df: DataFrame) -> DataFrame:
    """VAL-12: one row per definition; county weights positive, unique and summing to exactly one."""
    parts = df.select("definition_id", F.explode("counties").alias("c")).select(
        "definition_id", F.col("c.county_fips").alias("county_fips"), F.col("c.weight").cast("decimal(28,12)").alias("weight")
    )
    stats = parts.groupBy("definition_id").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("components"), F.countDistinct("county_fips").alias("counties"),
        F.count_if((F.col("weight") <= 0) | F.col("weight").isNull()).alias("bad_weights"),
        F.count_if(~F.col("county_fips").rlike(r"^\d{5}$")).alias("bad_fips"),
    )
    return stats.withColumn("errors", errors({
        "weight_not_positive": F.col("bad_weights") > 0, "county_repeated": F.col("counties") != F.col("components"),
        "county_fips_invalid": F.col("bad_fips") > 0, "weights_do_not_sum_to_one": F.col("total") != 1,
    }))


# Declared usage rights of comparable sources.
RIGHTS_STATUSES = ("public_open", "user_owned", "licensed_local", "unknown_review_required")


def rights_errors(df: DataFrame) -> DataFrame:
    """VAL-13: source metadata of comparable files."""
    return df.withColumn("errors", errors({
        "source_incomplete": blank(F.col("source_name")) | blank(F.col("licensing_notes")),
        "rights_status_invalid": ~F.coalesce(F.col("rights_status").isin(*RIGHTS_STATUSES), F.lit(False)),
        "file_hash_invalid": ~blank(F.col("file_sha256")) & ~F.lower("file_sha256").rlike(SHA256),
    })).withColumn("rights_documented", F.coalesce(F.col("rights_status") != "unknown_review_required", F.lit(False)))
