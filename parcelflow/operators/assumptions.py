"""Assumption recommendations for every deal and assumption in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import keyed
from parcelflow.operators.validate import errors

# Fixed values: (assumption, metric, unit, preferred number of observed periods).
CATALOG = (
    ("market_rent_growth", "rent_growth_12m", "decimal_fraction", 12), ("market_rent", "effective_rent", "USD_per_area", 8),
    ("vacancy", "vacancy_rate", "decimal_fraction", 12), ("renewal_probability", "renewal_probability", "decimal_fraction", 20),
    ("downtime", "downtime_months", "months", 20), ("tenant_improvements", "tenant_improvements", "USD_per_area", 20),
    ("leasing_commissions", "leasing_commission_rate", "decimal_fraction", 20), ("expense_growth", "expense_growth", "decimal_fraction", 12),
    ("property_tax_growth", "property_tax_growth", "decimal_fraction", 12), ("insurance_growth", "insurance_growth", "decimal_fraction", 12),
    ("exit_cap_rate", "transaction_cap_rate", "decimal_fraction", 20), ("discount_rate", "discount_rate", "decimal_fraction", 20),
    ("debt_interest_rate", "debt_interest_rate", "decimal_fraction", 20), ("construction_cost_growth", "construction_cost_growth", "decimal_fraction", 12),
    ("lease_up_pace", "lease_up_units_per_month", "units_per_month", 12),
)

# Fallback hierarchy (level, geography score, property score).
FALLBACKS = (
    ("exact_submarket_property_subtype", 1.0, 1.0), ("exact_market_property_subtype", 0.9, 1.0), ("exact_market_property_type", 0.9, 0.85),
    ("cbsa_property_type", 0.75, 0.85), ("state_property_type", 0.55, 0.85), ("national_property_type", 0.35, 0.85),
)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "assumption string, metric string, unit string, preferred int")


def freshness(latest: Column, as_of: Column) -> Column:
    """ASM-03."""
    age = F.datediff(as_of, latest)
    return F.when(latest.isNull(), 0.0).when(age <= 120, 1.0).when(age <= 365, 0.75).when(age <= 730, 0.4).otherwise(0.1)


def confidence(sample: Column, completeness: Column, fresh: Column, geography: Column, match: Column, source: Column, validation: Column, agreement: Column, out_of_domain: Column) -> Column:
    """ASM-04: struct(score, label) of eight rounded, weighted components; out of domain caps at 0.49."""
    size = F.when(sample > 0, F.least(F.lit(1.0), sample / 24)).otherwise(0.0)
    parts = ((size, 0.15), (completeness, 0.15), (fresh, 0.15), (geography, 0.15), (match, 0.15), (source, 0.10), (validation, 0.10), (agreement, 0.05))
    total = F.lit(0.0)
    for part, weight in parts:
        total = total + F.round(part, 4) * weight
    total = F.when(out_of_domain, F.least(total, F.lit(0.49))).otherwise(total)
    label = F.when((total >= 0.8) & (size >= 0.75) & (validation >= 0.7), "high").when(total >= 0.55, "moderate").when(sample > 0, "low").otherwise("unavailable")
    return F.struct(F.round(total, 4).alias("score"), label.alias("label"))


# The geography columns that identify each fallback level, on the deal and on the observation.
LEVEL_KEYS = (
    (("submarket", "submarket"), ("property_subtype", "property_subtype")),
    (("market_id", "geography_id"), ("property_subtype", "property_subtype")),
    (("market_id", "geography_id"), ("property_type", "property_type")),
    (("cbsa", "cbsa"), ("property_type", "property_type")),
    (("state_fips", "state_of_county"), ("property_type", "property_type")),
    (("property_type", "property_type"),),
)


def contexts(deals: DataFrame) -> DataFrame:
    """Every deal with each level key it can ask for; the key is null where the deal lacks a part."""
    entries = [
        F.struct(F.lit(i).alias("level"), _level_key(i, [F.col(d) for d, _ in pairs]).alias("level_key")) for i, pairs in enumerate(LEVEL_KEYS)
    ]
    return deals.select("deal_id", F.inline(F.array(*entries))).filter("level_key IS NOT NULL")


def _level_key(level: int, parts: list[Column]) -> Column:
    missing = parts[0].isNull()
    for part in parts[1:]:
        missing = missing | part.isNull()
    return F.when(~missing, F.concat_ws("|", F.lit(str(level)), *parts))


def level_statistics(observations: DataFrame) -> DataFrame:
    """Statistics per (metric, level key): observations are aggregated once, before any deal is joined.

    A deal only needs the statistics of one key, so the deal-observation pairs of the
    hierarchy are never produced.
    """
    rows = observations.withColumn("state_of_county", F.substring("county_fips", 1, 2))
    entries = [
        F.struct(F.lit(i).alias("level"), _level_key(i, [F.col(o) for _, o in pairs]).alias("level_key")) for i, pairs in enumerate(LEVEL_KEYS)
    ]
    keyed_rows = rows.select("metric", "observation_date", F.col("value").cast("double").alias("value"), F.inline(F.array(*entries))).filter("level_key IS NOT NULL")
    key = ["metric", "level", "level_key"]
    stats = keyed_rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("observation_date").alias("periods"), F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("latest_date"), F.max_by("value", F.struct("observation_date", "value")).alias("most_recent"),
    )
    quartiles = keyed.grouped_quantiles(keyed_rows, key, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return stats.join(quartiles, key)


def recommend(deals: DataFrame, observations: DataFrame, as_of: str) -> DataFrame:
    """ASM-02/05: first non-empty fallback level per deal and assumption, with quartiles and confidence."""
    spark = deals.sparkSession
    stats = level_statistics(observations)
    wanted = F.broadcast(catalog(spark).select("assumption", "metric", "preferred"))
    offers = contexts(deals).join(stats, ["level", "level_key"]).join(wanted, "metric")
    names = F.array(*[F.lit(n) for n, _, _ in FALLBACKS])
    best = F.min_by(F.struct("level", "samples", "periods", "first_date", "latest_date", "most_recent", "q1", "median", "q3", "preferred"), "level")
    picked = offers.groupBy("deal_id", "assumption").agg(best.alias("b")).select("deal_id", "assumption", "b.*")
    geography = F.array(*[F.lit(g) for _, g, _ in FALLBACKS])[F.col("level")]
    match = F.array(*[F.lit(p) for _, _, p in FALLBACKS])[F.col("level")]
    completeness = F.least(F.lit(1.0), F.col("periods") / F.col("preferred"))
    fresh = freshness(F.col("latest_date"), F.lit(as_of).cast("date"))
    out = F.col("level") >= 4
    scored = confidence(F.col("samples"), completeness, fresh, geography, match, F.lit(0.75), F.lit(0.0), F.lit(1.0), out)
    return picked.select(
        "deal_id", "assumption", names[F.col("level")].alias("fallback_level"), "samples", F.col("q1").alias("low"), F.col("median").alias("base"), F.col("q3").alias("high"),
        "most_recent", "first_date", "latest_date", completeness.alias("completeness"), fresh.alias("freshness"), scored["score"].alias("confidence_score"),
        scored["label"].alias("confidence"), out.alias("out_of_domain"),
    )


# Fixed values: (property type, assumption, tier) -> weights of model, historical median, most recent.
BLEND_WEIGHTS = {
    ("multifamily", "market_rent_growth", "weak"): (0.25, 0.50, 0.25), ("multifamily", "market_rent_growth", "moderate"): (0.40, 0.40, 0.20),
    ("multifamily", "market_rent_growth", "strong"): (0.50, 0.35, 0.15), ("multifamily", "vacancy", "weak"): (0.20, 0.55, 0.25),
    ("multifamily", "vacancy", "moderate"): (0.35, 0.45, 0.20), ("multifamily", "vacancy", "strong"): (0.45, 0.40, 0.15),
}
DEFAULT_WEIGHTS = (0.20, 0.55, 0.25)


def blend(df: DataFrame) -> DataFrame:
    """ASM-06: model quality tier, weighted base and downside/upside per forecast row."""
    gain = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("baseline_mae") - F.col("model_mae")), F.col("baseline_mae")), F.lit(0.0))
    holdout = F.coalesce(F.try_divide(F.col("model_mae"), F.col("holdout_mae")), F.lit(0.0))
    score = (
        F.least(F.lit(1.0), gain * 2) * 0.55 + F.least(F.lit(1.0), holdout) * 0.25 + F.when(F.col("stable"), 0.10).otherwise(0.0)
        + F.when(F.col("cross_checks_ok"), 0.10).otherwise(0.0)
    )
    scored = df.withColumn("quality_score", F.round(F.least(F.lit(1.0), score), 12))
    scored = scored.withColumn("tier", F.when(F.col("quality_score") >= 0.75, "strong").when(F.col("quality_score") >= 0.45, "moderate").otherwise("weak"))
    rules = df.sparkSession.createDataFrame(
        [(*key, *w) for key, w in BLEND_WEIGHTS.items()], "property_type string, assumption string, tier string, w_model double, w_median double, w_recent double"
    )
    out = scored.join(F.broadcast(rules), ["property_type", "assumption", "tier"], "left")
    weight = lambda c, i: F.coalesce(F.col(c), F.lit(DEFAULT_WEIGHTS[i]))
    base = weight("w_model", 0) * F.col("estimate") + weight("w_median", 1) * F.col("median") + weight("w_recent", 2) * F.col("most_recent")
    low, high = F.coalesce("forecast_low", "estimate"), F.coalesce("forecast_high", "estimate")
    return out.withColumns({
        "base": base, "downside": F.least(F.col("q1"), low, base - F.col("model_mae")), "upside": F.greatest(F.col("q3"), high, base + F.col("model_mae")),
    }).drop("w_model", "w_median", "w_recent")


def promotion_evidence(df: DataFrame) -> DataFrame:
    """ASM-07: missing evidence of model rows that claim to be validated."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    claimed = F.col("validation_state") == "validated"
    return df.withColumn("missing_evidence", errors({
        "fictional data": claimed & (F.col("data_status") == "fictional_synthetic"),
        "real data": claimed & (F.col("data_status") != "real"),
        "validated promotion gates": claimed & ~((F.col("governance_status") == "validated") & F.col("eligible_for_controlling_forecast")),
        "reference pass": claimed & (F.col("reference_status") != "passed"),
        "cross-check status": claimed & ~F.coalesce(F.col("cross_check_status").isin("passed", "not_available"), F.lit(False)),
        "source manifest hashes": claimed & empty("source_manifest_hashes"),
        "target dataset hashes": claimed & empty("target_dataset_hashes"),
        "feature table hash": claimed & F.col("feature_table_hash").isNull(),
        "model result hash": claimed & F.col("model_result_hash").isNull(),
        "candidate-only forecast": claimed & ~(F.col("candidate_only") & F.col("analyst_approval_required")),
    }))
