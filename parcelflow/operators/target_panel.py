"""Eligible targets, market definitions and leakage-safe target-feature panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import keyed, periods
from parcelflow.schemas import BLOCKING_FINDINGS

CELL = ["geography_id", "period", "frequency", "property_type", "metric"]
LONGITUDINAL = ["geography_id", "frequency", "property_type", "metric", "source_name"]


def eligibility(scored: DataFrame) -> DataFrame:
    """TGT-01: ordered exclusion reason per row (null when eligible) and the availability date.

    Rows with a column ``n`` stand for so many rows that are alike in all that is looked at."""
    blocking = F.arrays_overlap("verification_findings", F.array(*[F.lit(c) for c in BLOCKING_FINDINGS]))
    available = F.col("target_available_at") if "target_available_at" in scored.columns else F.coalesce(F.col("release_date"), F.col("retrieved_on"))
    role = F.col("source_geography_role") if "source_geography_role" in scored.columns else F.lit(None).cast("string")
    first = (
        F.when(~F.col("model_eligible") | (F.col("verification_status") != "analyst_verified"), "not_model_eligible")
        .when(blocking, "unresolved_quality_finding")
        .when(role == "overlapping_region_rollup", "overlapping_source_geography_rollup")
        .when(~F.col("frequency").isin("annual", "quarterly"), "unsupported_frequency")
        .when(available.isNull(), "missing_availability")
    )
    rows = scored.withColumns({"target_available_at": available, "reason": first})
    candidates = rows.filter("reason IS NULL").drop("reason")
    candidates = keyed.with_group_stats(candidates, LONGITUDINAL, (F.min("methodology") != F.max("methodology")).alias("__changed"))
    candidates = keyed.with_group_stats(candidates, CELL, F.max("__changed").alias("__cell_changed"), F.sum(_weight(scored)).alias("__cell_rows"))
    late = F.when(F.col("__cell_changed"), "longitudinal_methodology_change").when(F.col("__cell_rows") != 1, "unresolved_multiple_sources")
    judged = candidates.withColumn("reason", late).drop("__changed", "__cell_changed", "__cell_rows")
    return judged.unionByName(rows.filter("reason IS NOT NULL"))


def _weight(rows: DataFrame) -> Column:
    return F.col("n") if "n" in rows.columns else F.lit(1)


def eligible_targets(scored: DataFrame) -> DataFrame:
    return eligibility(scored).filter("reason IS NULL").drop("reason")


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NOT NULL").groupBy("property_type", "metric", "reason").agg(F.count(F.lit(1)).alias("rows"))


def target_readiness(judged: DataFrame, registry: DataFrame | None = None, *, markets: int = 5, periods_minimum: int = 20, observations: int = 100) -> DataFrame:
    """TGT-02: depth and readiness for every property type and metric in one pass, from the rows of ``eligibility``."""
    pair = ["property_type", "metric"]
    ok = F.col("reason").isNull()
    total = lambda hit: F.coalesce(F.sum(F.when(hit, _weight(judged))), F.lit(0))
    totals = judged.groupBy(*pair).agg(
        total(F.lit(True)).alias("observations"), total(F.col("verification_status") == "analyst_verified").alias("verified"), total(ok).alias("eligible"),
        F.countDistinct(F.when(ok, F.col("period"))).alias("periods"), F.min(F.when(ok, F.col("period"))).alias("earliest"), F.max(F.when(ok, F.col("period"))).alias("latest"),
    )
    depth = judged.filter(ok).groupBy(*pair, "geography_id").agg(F.countDistinct("period").alias("p")).groupBy(*pair).agg(
        F.count(F.lit(1)).alias("markets"), F.count_if(F.col("p") >= periods_minimum).alias("deep_markets")
    )
    out = totals.join(depth, pair, "left")
    if registry is not None:
        out = registry.select(*pair).distinct().join(out, pair, "full")
    out = out.fillna(0, ["observations", "verified", "eligible", "periods", "markets", "deep_markets"])
    possible = F.col("markets") * F.col("periods")
    ready = (F.col("markets") >= markets) & (F.col("periods") >= periods_minimum) & (F.col("deep_markets") >= markets) & (F.col("eligible") >= observations)
    reasons = F.filter(F.array(
        F.when(F.col("markets") < markets, "markets"), F.when(F.col("periods") < periods_minimum, "periods"),
        F.when(F.col("deep_markets") < markets, "market_depth"), F.when(F.col("eligible") < observations, "eligible_observations"),
    ), lambda r: r.isNotNull())
    return out.withColumns({
        "missingness": F.when(possible > 0, 1.0 - F.col("eligible") / possible), "status": F.when(ready, "ready").otherwise("not_ready"), "reasons": reasons,
    })


def specification_readiness(panel: DataFrame, target: str, features: list[str], *, frequency: str, markets: int, periods_minimum: int, sample: int) -> DataFrame:
    """TGT-03: complete cases known at the forecast origin, and feature missingness."""
    origin = periods.period_start("period")
    complete = F.col(target).isNotNull()
    available = F.lit(True)
    for name in features:
        complete = complete & F.col(name).isNotNull()
        available = available & F.coalesce(F.col(f"{name}__available_at") <= origin, F.lit(False))
    flagged = panel.withColumns({"__complete": complete, "__ok": complete & available})
    depth = flagged.filter("__ok").groupBy("market_id").agg(F.countDistinct("period").alias("p"), F.count(F.lit(1)).alias("n"))
    deep = depth.agg(F.count(F.lit(1)).alias("complete_markets"), F.count_if(F.col("n") >= periods_minimum).alias("deep_markets")).withColumn("__one", F.lit(1))
    totals = flagged.agg(
        F.count_if("__ok").alias("complete_observations"), F.countDistinct(F.when(F.col("__ok"), F.col("period"))).alias("complete_periods"),
        F.count_if(F.col("__complete") & ~F.col("__ok")).alias("availability_exclusions"),
        *[(F.count_if(F.col(n).isNull()) / F.count(F.lit(1))).alias(f"{n}__missingness") for n in features],
    ).withColumn("__one", F.lit(1))
    out = totals.join(deep, "__one").drop("__one")
    ready = (F.col("complete_observations") >= sample) & (F.col("complete_markets") >= markets) & (F.col("complete_periods") >= periods_minimum) & (F.col("deep_markets") >= markets)
    return out.withColumn("status", F.when(ready, "ready").otherwise("not_ready"))


def match_definitions(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """JN-08: the approved definition in force at the period end; several or none is a finding.

    Definitions meet the distinct (market, type, period) cells and not the rows, so the
    interval join is bounded by cells times definitions of one market.
    """
    approved = definitions.filter("review_status = 'analyst_approved'").select("definition_id", F.col("market_id").alias("geography_id"), "property_type", "effective_from", "effective_to")
    cells = rows.select("geography_id", "property_type", "period", "frequency").distinct()
    cells = cells.withColumn("period_end", periods.period_end("period", "frequency"))
    matched = cells.join(approved, ["geography_id", "property_type"]).filter(
        (F.col("effective_from") <= F.col("period_end")) & (F.col("effective_to").isNull() | (F.col("period_end") <= F.col("effective_to")))
    )
    key = ["geography_id", "property_type", "period", "frequency"]
    counted = matched.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("definition_id").alias("definition_id"))
    out = rows.join(counted, key, "left")
    problem = F.when(F.col("__n").isNull(), "missing_market_definition").when(F.col("__n") > 1, "ambiguous_market_definition")
    return out.withColumns({"problem": problem, "definition_id": F.when(problem.isNull(), F.col("definition_id"))}).drop("__n")


def overlapping_definitions(definitions: DataFrame) -> DataFrame:
    """JN-22: approved definitions of one market whose effective ranges overlap.

    Sorted by start, a range overlaps an earlier one exactly when it starts no later than the
    running maximum end, so no pairs are enumerated.  A market has few definitions.
    """
    far = F.lit("9999-12-31").cast("date")
    rows = definitions.filter("review_status = 'analyst_approved'").withColumn("__end", F.coalesce("effective_to", far))
    window = Window.partitionBy("market_id", "property_type").orderBy("effective_from", "definition_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"earlier_end": F.max("__end").over(window), "earlier_id": F.max_by("definition_id", "__end").over(window)})
    return marked.filter(F.col("effective_from") <= F.col("earlier_end")).select("market_id", "property_type", "definition_id", "earlier_id", "effective_from", "earlier_end")


def weighted_features(components: DataFrame, values: DataFrame, aggregation: DataFrame) -> DataFrame:
    """AGG-11: county values to market values; missing inputs stay missing, nothing is reweighted.

    ``components``: definition_id, county_fips, weight.  ``values``: feature_name,
    geography_id, period_start, value, available_at.  ``aggregation``: feature_name, rule.
    """
    sizes = components.groupBy("definition_id").agg(F.count(F.lit(1)).alias("counties"))
    rows = components.join(values, components.county_fips == values.geography_id).drop("geography_id")
    grouped = rows.groupBy("definition_id", "feature_name", "period_start").agg(
        F.count("value").alias("present"), F.sum(F.col("value") * F.col("weight").cast("double")).alias("weighted"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.max("available_at").alias("available_at"), F.count("available_at").alias("dated"),
    ).join(sizes, "definition_id").join(aggregation, "feature_name")
    whole = F.col("present") == F.col("counties")
    spread = F.col("high") - F.col("low") > 1e-12
    value = F.when(whole & (F.col("rule") == "portfolio_weighted_mean"), F.col("weighted")).when(whole & (F.col("rule") == "broadcast") & ~spread, F.col("low"))
    return grouped.select(
        "definition_id", "feature_name", "period_start", value.alias("value"), F.when(F.col("dated") == F.col("counties"), F.col("available_at")).alias("available_at"),
        (whole & (F.col("rule") == "broadcast") & spread).alias("broadcast_conflict"),
    )


def county_weights(inventory: DataFrame) -> DataFrame:
    """AGG-28: share of units per county, or of properties where no property states units.

    A market with units on only some properties has no consistent basis and gets no weights.
    Weights are rounded down to 12 places and the last county takes the residual, so they sum
    to exactly one.
    """
    per = inventory.groupBy("market_id", "county_fips").agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("properties"), F.count("units").alias("with_units"))
    totals = per.groupBy("market_id").agg(F.sum("units").alias("all_units"), F.sum("properties").alias("all_properties"), F.sum("with_units").alias("all_with"), F.max("county_fips").alias("last"))
    joined = per.join(totals, "market_id").filter("all_with = all_properties OR all_with = 0")
    by_units = F.col("all_with") == F.col("all_properties")
    part = F.when(by_units, F.col("units")).otherwise(F.col("properties")).cast("decimal(20,0)")
    whole = F.when(by_units, F.col("all_units")).otherwise(F.col("all_properties")).cast("decimal(20,0)")
    # Exact floor at 12 places: integer division of the scaled numerator.
    scaled = F.expr("CAST(CAST(__part AS DECIMAL(26,0)) * CAST(1000000000000 AS DECIMAL(13,0)) AS DECIMAL(38,0)) div CAST(__whole AS DECIMAL(38,0))")
    rounded = joined.withColumns({"__part": part, "__whole": whole}).withColumn("__floor", (scaled.cast("decimal(14,0)") * F.lit("0.000000000001").cast("decimal(13,12)")).cast("decimal(28,12)"))
    others = rounded.filter("county_fips <> last").groupBy("market_id").agg(F.sum("__floor").cast("decimal(14,12)").alias("__others"))
    final = rounded.join(others, "market_id", "left")
    one = F.lit(1).cast("decimal(14,12)")
    weight = F.when(F.col("county_fips") == F.col("last"), one - F.coalesce(F.col("__others"), F.lit(0).cast("decimal(14,12)"))).otherwise(F.col("__floor"))
    return final.select("market_id", "county_fips", weight.cast("decimal(28,12)").alias("weight"), F.when(by_units, "units").otherwise("properties").alias("basis"))


def definition_coverage(markets: DataFrame, definitions: DataFrame) -> DataFrame:
    """AGG-30: definition counts per market and the first reason that excludes it from features."""
    approved = F.col("review_status") == "analyst_approved"
    counts = definitions.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("definitions"), F.count_if(approved).alias("approved"), F.max(F.when(approved, F.col("weight_sum"))).alias("weight_sum"),
    )
    out = markets.select(F.col("geography_id").alias("market_id")).distinct().join(counts, "market_id", "left").fillna(0, ["definitions", "approved"])
    reason = (
        F.when(F.col("definitions") == 0, "missing").when(F.col("approved") == 0, "not_approved").when(F.col("approved") > 1, "multiple_approved")
        .when(F.coalesce(F.col("weight_sum") != 1, F.lit(True)), "weights_do_not_total_one")
    )
    return out.withColumns({"reason": reason, "feature_eligible": reason.isNull()}).drop("weight_sum")


def join_features(targets: DataFrame, cbsa_panel: DataFrame, county_panel: DataFrame, market_panel: DataFrame, features: list[str]) -> DataFrame:
    """JN-09/10, TGT-04: features by CBSA, else county, else weighted market; a missing period is labelled.

    Panels hold one row per (geography_id or definition_id, period) with value and
    availability columns per feature.
    """
    columns = [c for f in features for c in (f, f"{f}__available_at")]
    area, county = F.col("cbsa"), F.coalesce(F.col("county_fips"), F.when(F.col("geography_type") == "county", F.col("geography_id")))
    kind = F.when(area.isNotNull(), "cbsa").when(county.isNotNull(), "county").when(F.col("definition_id").isNotNull(), "market_weighted_counties")
    keyed_rows = targets.withColumns({"feature_geography_type": kind, "feature_geography_id": F.coalesce(area, county, F.col("definition_id"))}).filter("feature_geography_type IS NOT NULL")
    lookup = None
    for name, panel, id_column in (("cbsa", cbsa_panel, "geography_id"), ("county", county_panel, "geography_id"), ("market_weighted_counties", market_panel, "definition_id")):
        part = panel.select(F.lit(name).alias("feature_geography_type"), F.col(id_column).alias("feature_geography_id"), "period", F.lit(True).alias("__found"), *columns)
        lookup = part if lookup is None else lookup.unionByName(part)
    joined = keyed_rows.join(lookup, ["feature_geography_type", "feature_geography_id", "period"], "left")
    return joined.withColumn("problem", F.when(F.col("__found").isNull(), "missing_feature_period")).drop("__found")


def feature_edges(rows: DataFrame, values: DataFrame, components: DataFrame, features: list[str], id_column: str = "target_id") -> DataFrame:
    """JN-10, TGT-04: (lineage_id, parent_id, parent_kind, weight) from target rows to the feature values behind them.

    ``rows`` are what ``join_features`` returns.  A row by area or county has one value per feature, of weight one;
    a row by weighted counties has one per county of its definition, with the county's weight.  Edges are rows, so
    neither a market of many counties nor a row of many features becomes a long list.
    """
    kept = rows.filter("problem IS NULL").select(F.col(id_column).alias("lineage_id"), "feature_geography_type", "feature_geography_id", "period")
    known = values.filter(F.col("feature_name").isin(features)).select(
        F.col("geography_type").alias("__type"), F.col("geography_id").alias("__place"), periods.quarter_label("period_start").alias("__period"), F.col("lineage_id").alias("parent_id")
    )
    shares = components.select(F.col("definition_id").alias("__definition"), "county_fips", F.col("weight").cast("double").alias("weight"))
    by_county = F.col("feature_geography_type") == "market_weighted_counties"
    direct = kept.filter(~by_county).select("lineage_id", F.col("feature_geography_type").alias("type"), F.col("feature_geography_id").alias("place"), "period", F.lit(1.0).alias("weight"))
    weighted = kept.filter(by_county).join(shares, F.col("feature_geography_id") == F.col("__definition")).select(
        "lineage_id", F.lit("county").alias("type"), F.col("county_fips").alias("place"), "period", "weight"
    )
    asked = direct.unionByName(weighted)
    met = (F.col("type") == F.col("__type")) & (F.col("place") == F.col("__place")) & (F.col("period") == F.col("__period"))
    return asked.join(known, met).select("lineage_id", "parent_id", F.lit("feature").alias("parent_kind"), "weight")


def horizon_pairs(df: DataFrame, horizon: int, *, target: str = "target") -> DataFrame:
    """TGT-06, JN-11: each origin row with the target exactly ``horizon`` quarters later."""
    if horizon not in (1, 2, 4):
        raise ValueError("horizon must be 1, 2 or 4 quarters")
    rows = df.withColumn("__idx", periods.quarter_index("period"))
    future = rows.select("market_id", (F.col("__idx") - horizon).alias("__idx"), F.col("period").alias("target_period"), F.col(target).alias("future_target"))
    return rows.join(future, ["market_id", "__idx"]).drop("__idx").withColumn("horizon", F.lit(horizon))
