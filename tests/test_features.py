"""Feature panel on a two-county mini warehouse with hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelflow.operators import features, lineage
from parcelflow.plans import feature_panel

D = dt.date


def _row(metric, geo, day, value, source, period="annual", kind="county", subtype=None, cbsa=None, as_of=None, quality="high"):
    return (
        f"{metric}:{geo}:{day}:{subtype or ''}", source, "d", metric, "1", as_of or D(day.year, 12, 31), kind, geo, geo[:2] if kind == "county" else None,
        geo if kind == "county" else None, cbsa, subtype, day, period, metric, float(value), "u", quality,
    )


SCHEMA = (
    "observation_id string, source_id string, source_dataset string, source_series string, source_version string, as_of_date date, geography_type string, geography_id string, state_fips string,"
    " county_fips string, cbsa string, property_subtype string, observation_date date, period_type string, metric string, value double, unit string, quality_level string"
)


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    population = {"01001": (100, 110, 121, 133.1), "01003": (200, 220, 242, 266.2)}
    permits = {"01001": (10, 12, 14, 16), "01003": (20, 22, 24, 26)}
    for geo in population:
        for i, year in enumerate(range(2020, 2024)):
            day = D(year, 1, 1)
            rows.append(_row("population", geo, day, population[geo][i], "census_acs"))
            rows.append(_row("households", geo, day, population[geo][i] * 0.5, "census_acs"))
            rows.append(_row("housing_units", geo, day, population[geo][i] * 0.6, "census_acs"))
            rows.append(_row("multifamily_5_plus_units_authorized", geo, day, permits[geo][i], "census_bps"))
        rows.append(_row("county_cbsa_membership", geo, D(2023, 7, 21), 1, "census_cbsa_crosswalk", "irregular", cbsa="12345"))
    for i, rent in enumerate((900, 945, 1000, 1050)):
        rows.append(_row("fair_market_rent", "01001", D(2020 + i, 1, 1), rent, "hud_public", subtype="two_bedroom"))
    for year, (first, last) in zip(range(2020, 2024), ((1.0, 1.2), (1.5, 1.7), (2.0, 2.3), (3.5, 4.0))):
        rows.append(_row("treasury_10y", "US", D(year, 1, 2), first, "fred_public", "daily", "national"))
        rows.append(_row("treasury_10y", "US", D(year, 12, 31), last, "fred_public", "daily", "national"))
    for year, cpi in zip(range(2020, 2024), (100, 110, 121, 133.1)):
        rows.append(_row("cpi", "US", D(year, 12, 1), cpi, "fred_public", "monthly", "national"))
    return spark.createDataFrame(rows, SCHEMA)


def test_annual_county_panel(facts):
    built = feature_panel.build(facts, geography="county", frequency="annual")
    panel = {(r.geography_id, r.period_start.year): r for r in built.panel.collect()}
    assert len(panel) == 8
    row = panel["01001", 2021]
    assert row.population_growth_yoy == pytest.approx(0.1)
    assert row.multifamily_permits_per_1000_population == pytest.approx(12 / 110 * 1000)
    assert row.cpi_growth_yoy == pytest.approx(0.1)
    assert row.treasury_10y_mean == pytest.approx(1.6) and row.treasury_10y_period_end == pytest.approx(1.7)
    assert panel["01001", 2023].population_growth_3y_cagr == pytest.approx(1.331 ** (1 / 3) - 1)
    assert panel["01001", 2022].population_growth_yoy_lag_1y == pytest.approx(0.1)
    assert panel["01001", 2020].population_growth_yoy is None
    assert panel["01003", 2021].fair_market_rent_2br is None
    profile = features.profile_panel(built.values, "annual").first()
    assert profile.duplicate_feature_keys == 0 and profile.feature_values == profile.unique_lineage_ids


def test_quarterly_carry_forward_keeps_availability_and_nulls(facts):
    built = feature_panel.build(facts, geography="county", frequency="quarterly")
    row = built.panel.filter("geography_id = '01001' AND period_start = DATE'2021-04-01'").first()
    assert row.population == 110 and row.population__available_at == D(2021, 12, 31)
    assert row.treasury_10y_mean is None
    change = built.values.filter("feature_name = 'treasury_10y_change_2q' AND geography_id = '01001'").count()
    assert change == 0  # only first and fourth quarters hold a rate, two quarters apart never match


def test_cbsa_sum_and_lineage(facts):
    from parcelflow.operators import warehouse

    crosswalk = warehouse.current_crosswalk(facts)
    built = feature_panel.build(facts, geography="cbsa", frequency="annual", crosswalk=crosswalk)
    root = built.values.filter("feature_name = 'population' AND geography_type = 'cbsa' AND period_start = DATE'2021-01-01'")
    assert root.first().value == 330
    nodes = lineage.trace(built.edges, root.select("lineage_id"), values=built.values)
    kinds = {r.node_kind: r["count"] for r in nodes.groupBy("node_kind").count().collect()}
    assert kinds == {"feature": 3, "observation": 4}


def test_conflicting_sources_never_publish(facts, spark):
    clash = facts.filter("metric = 'population'").withColumns({"value": F.col("value") + 1, "observation_id": F.concat("observation_id", F.lit("x"))})
    with pytest.raises(feature_panel.FeatureConflict):
        feature_panel.build(facts.unionByName(clash), geography="county", frequency="annual")


def test_exact_duplicate_collapses(facts):
    doubled = facts.unionByName(facts.filter("metric = 'population'").withColumn("observation_id", F.concat("observation_id", F.lit("copy"))))
    built = feature_panel.build(doubled, geography="county", frequency="annual", only=["population"])
    row = built.values.filter("geography_id = '01001' AND period_start = DATE'2020-01-01'").first()
    assert row.value == 100 and row.transformation.endswith("exact_duplicate_collapse=2")


def test_rebuild_is_order_and_partition_independent(facts):
    ids = lambda df: {r.lineage_id for r in feature_panel.build(df, geography="county", frequency="annual").values.select("lineage_id").collect()}
    assert ids(facts) == ids(facts.repartition(7).orderBy(F.rand(3)))


def test_broken_lineage_is_an_error(facts):
    built = feature_panel.build(facts, geography="county", frequency="annual", only=["population_growth_yoy"])
    roots = built.values.filter("feature_name = 'population_growth_yoy'").select("lineage_id")
    with pytest.raises(lineage.BrokenLineage):
        lineage.trace(built.edges, roots, values=built.values.filter("feature_name <> 'population'"))


def test_registry_rules():
    with pytest.raises(ValueError):
        features.FeatureSpec("market_rent", "source", metric="fair_market_rent", source_ids=("hud_public",))
    with pytest.raises(ValueError):
        features.levels([features.FeatureSpec("a", "growth", inputs=("b",)), features.FeatureSpec("b", "growth", inputs=("a",))])
    assert len(features.REGISTRY) == 36
