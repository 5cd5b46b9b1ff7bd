"""Published panel versions: what is rewritten, what a reader verifies, and that nothing half-built is visible."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from parcelflow.plans import feature_panel, feature_queries as q, panel_versions as p
from parcelflow.sources.store import StoreError

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    return q.facts(spark, SF).cache()


def put(facts, root, geography="county", specs=q.SPECS, **more):
    return p.publish(facts, str(root), geography=geography, frequency="quarterly", specs=specs, **more)


def test_only_what_changed_is_rewritten(spark, facts, tmp_path):
    first = put(facts, tmp_path)
    assert first["outcome"] == "published" and len(first["rebuilt"]) == len(q.SPECS)
    assert put(facts.repartition(3), tmp_path) == {"version": first["version"], "outcome": "unchanged", "rebuilt": []}
    other = tuple(replace(s, lag=2) if s.name == "revenue_growth_yoy_lag_1" else s for s in q.SPECS)
    assert put(facts, tmp_path, specs=other)["rebuilt"] == ["revenue_growth_yoy_lag_1"]
    grown = facts.withColumn("value", F.when(F.col("metric") == "quantity", F.col("value") + 1).otherwise(F.col("value")))
    assert put(grown, tmp_path)["rebuilt"] == ["quantity", "revenue_per_1000_units"]
    shown = {r.version: r for r in p.versions(spark, str(tmp_path)).collect()}
    assert len(shown) == 3 and sum(r.active for r in shown.values()) == 1 and shown[first["version"]].nodes == 11

    built = feature_panel.build(facts, geography="county", frequency="quarterly", specs=q.SPECS, check=False)
    got = p.open_version(spark, str(tmp_path), geography="county", frequency="quarterly", version=first["version"])
    for part in ("values", "edges"):
        want, have = getattr(built, part), getattr(got, part)
        assert have.columns == want.columns and have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    assert got.panel.count() == built.panel.count()


def test_area_panel_reuses_nothing_of_another_geography(spark, facts, tmp_path):
    put(facts, tmp_path)
    area = put(facts, tmp_path, "cbsa", crosswalk=q.regions(spark, SF))
    assert area["outcome"] == "published"
    built = feature_panel.build(facts, geography="cbsa", frequency="quarterly", specs=q.SPECS, crosswalk=q.regions(spark, SF), check=False)
    got = p.open_version(spark, str(tmp_path), geography="cbsa", frequency="quarterly")
    assert got.values.exceptAll(built.values).isEmpty() and built.values.exceptAll(got.values).isEmpty()
    moved = q.regions(spark, SF).withColumn("cbsa", F.lit("00000"))
    again = put(facts, tmp_path, "cbsa", crosswalk=moved)
    assert "revenue" in again["rebuilt"] and again["version"] != area["version"]


def test_reader_refuses_what_differs_from_the_manifest(spark, facts, tmp_path):
    put(facts, tmp_path)
    row = p.manifest(spark, str(tmp_path)).filter("feature_name = 'revenue_cagr_3y'").first()
    values = f"{row.folder}/values/feature_name=revenue_cagr_3y"
    spark.read.parquet(values).limit(1).write.mode("append").parquet(values)
    p.open_version(spark, str(tmp_path), geography="county", frequency="quarterly", verify=False)
    with pytest.raises(StoreError, match="revenue_cagr_3y"):
        p.open_version(spark, str(tmp_path), geography="county", frequency="quarterly")


def test_nothing_is_visible_before_the_gates(spark, facts, tmp_path):
    twice = facts.unionByName(facts.filter("metric = 'revenue'").withColumn("value", F.col("value") + 1))
    with pytest.raises(feature_panel.FeatureConflict, match="revenue"):
        put(twice, tmp_path)
    broken = facts.withColumn("value", F.when(F.col("metric") == "quantity", F.lit(float("nan"))).otherwise(F.col("value")))
    with pytest.raises(StoreError, match="gate"):
        put(broken, tmp_path)
    assert p.manifest(spark, str(tmp_path)).isEmpty()
    with pytest.raises(StoreError):
        p.open_version(spark, str(tmp_path), geography="county", frequency="quarterly")
