"""FEA-11: dependency-ordered build of the long value table and the lineage edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.operators import features
from parcelflow.session import checkpointed


class FeatureConflict(ValueError):
    """Distinct source variants share one feature key; nothing may be published."""


@dataclass(frozen=True)
class FeatureTables:
    values: DataFrame
    edges: DataFrame
    panel: DataFrame


def refuse_conflicts(groups: DataFrame) -> None:
    """Raise with the number of ambiguous keys of every feature that has any; one row per feature reaches the driver."""
    clashes = groups.filter("conflict").groupBy("feature_name").count().collect()
    if clashes:
        raise FeatureConflict(f"ambiguous source observations: {sorted((r[0], r[1]) for r in clashes)}")


def needed(specs, names) -> list[features.FeatureSpec]:
    """Specs required to produce the named features, inputs included."""
    by_name = {s.name: s for s in specs}
    wanted, stack = set(), list(names)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack += list(by_name[name].inputs)
    return [s for s in specs if s.name in wanted]


def build(
    facts: DataFrame, *, geography: str, frequency: str, specs=features.REGISTRY, crosswalk: DataFrame | None = None,
    only: list[str] | None = None, stage: Callable[[DataFrame], DataFrame] = checkpointed, check: bool = True,
) -> FeatureTables:
    """Build one feature table.

    A level reads only the pieces that hold its inputs, so the plan stays a chain and not a
    tree.  ``only`` restricts the build to some features and their inputs.  ``stage``
    materialises a piece that later levels read again (a checkpoint or a written table).
    """
    chosen = features.specs_for(needed(specs, only) if only else specs, frequency, geography)
    sources = {s.metric: s.source_ids for s in chosen if s.metric}
    facts = facts.filter(F.col("metric").isin(list(sources)))
    groups = stage(features.source_groups(facts, chosen))
    if check:
        refuse_conflicts(groups)
    county = features.source_features(groups, frequency)
    edges, pieces, national = [observation_edges(facts, chosen, groups, frequency)], [], []
    names = {s.name for s in chosen if s.kind == "source"}
    if geography == "cbsa":
        if crosswalk is None:
            raise ValueError("a cbsa panel needs a crosswalk")
        sums = stage(features.cbsa_sums(county, crosswalk, chosen))
        edges.append(sum_edges(county, sums, crosswalk))
        national.append(county)
        pieces.append(({s.name for s in chosen if s.cbsa_sum}, sums))
    else:
        pieces.append((names, county))
    spine = features.panel_spine(pieces[0][1], geography)
    macro_names = {s.name for s in chosen if s.kind in ("period_mean", "period_end")}
    if macro_names:
        macro = stage(features.macro_values(facts, chosen, frequency))
        local = features.broadcast_macro(macro, spine, geography)
        edges += [macro_edges(facts, chosen, macro, frequency), parent_edges(local)]
        national.append(macro)
        pieces.append((macro_names, local.drop("parents")))
    for level in features.levels(chosen):
        inputs = {i for s in level for i in s.inputs}
        values = reduce(lambda a, b: a.unionByName(b), [piece for held, piece in pieces if held & inputs])
        derived = stage(features.derive(values, level, geography, frequency, spine))
        edges.append(parent_edges(derived))
        pieces.append(({s.name for s in level}, derived.drop("parents")))
    local_values = reduce(lambda a, b: a.unionByName(b), [piece for _, piece in pieces])
    values = reduce(lambda a, b: a.unionByName(b), [local_values, *national])
    panel = features.pivot_panel(local_values, [s.name for s in chosen], geography, frequency)
    return FeatureTables(values.select(*features.VALUE_COLUMNS), reduce(lambda a, b: a.unionByName(b), edges).select(*features.EDGE_COLUMNS), panel)


def parent_edges(rows: DataFrame) -> DataFrame:
    return rows.select("feature_name", "lineage_id", F.explode("parents").alias("parent_id"), F.lit("feature").alias("parent_kind"))


def observation_edges(facts, specs, groups, frequency) -> DataFrame:
    sources = [(s.metric, source, s.subtype, s.name) for s in specs if s.kind == "source" for source in s.source_ids]
    dim = F.broadcast(facts.sparkSession.createDataFrame(sources, "metric string, source_id string, wanted_subtype string, feature_name string"))
    subtype = F.col("property_subtype") if "property_subtype" in facts.columns else F.lit(None).cast("string")
    rows = facts.filter("geography_type = 'county' AND period_type = 'annual'").join(dim, ["metric", "source_id"])
    rows = rows.filter(F.col("wanted_subtype").isNull() | F.coalesce(subtype == F.col("wanted_subtype"), F.lit(False)))
    rows = rows.select("feature_name", "geography_id", F.year("observation_date").alias("year"), F.col("observation_id").alias("parent_id"))
    nodes = features.source_features(groups, frequency).select("feature_name", "geography_id", F.year("period_start").alias("year"), "lineage_id")
    return nodes.join(rows, ["feature_name", "geography_id", "year"]).select("feature_name", "lineage_id", "parent_id", F.lit("observation").alias("parent_kind"))


def macro_edges(facts, specs, macro, frequency) -> DataFrame:
    rows = [(s.metric, source, s.name, s.kind) for s in specs if s.kind in ("period_mean", "period_end") for source in s.source_ids]
    dim = F.broadcast(facts.sparkSession.createDataFrame(rows, "metric string, source_id string, feature_name string, kind string"))
    unit = "year" if frequency == "annual" else "quarter"
    used = facts.join(dim, ["metric", "source_id"]).withColumn("period_start", F.to_date(F.date_trunc(unit, "observation_date")))
    last = used.filter("kind = 'period_end'").groupBy("feature_name", "period_start").agg(
        F.max_by("observation_id", F.struct("observation_date", "observation_id")).alias("parent_id"))
    every = used.filter("kind = 'period_mean'").select("feature_name", "period_start", F.col("observation_id").alias("parent_id"))
    nodes = macro.select("feature_name", "period_start", "lineage_id")
    return nodes.join(every.unionByName(last), ["feature_name", "period_start"]).select("feature_name", "lineage_id", "parent_id", F.lit("observation").alias("parent_kind"))


def sum_edges(values, sums, crosswalk) -> DataFrame:
    members = crosswalk.select("county_fips", F.col("cbsa").alias("area"), "observation_id") if "observation_id" in crosswalk.columns else crosswalk.select(
        "county_fips", F.col("cbsa").alias("area"), F.lit(None).cast("string").alias("observation_id"))
    children = values.filter("geography_type = 'county'").select("feature_name", "county_fips", "period_start", F.col("lineage_id").alias("child_id")).join(members, "county_fips")
    nodes = sums.select("feature_name", F.col("geography_id").alias("area"), "period_start", "lineage_id")
    joined = nodes.join(children, ["feature_name", "area", "period_start"])
    feature = joined.select("feature_name", "lineage_id", F.col("child_id").alias("parent_id"), F.lit("feature").alias("parent_kind"))
    member = joined.filter("observation_id IS NOT NULL").select("feature_name", "lineage_id", F.col("observation_id").alias("parent_id"), F.lit("observation").alias("parent_kind"))
    return feature.unionByName(member)
