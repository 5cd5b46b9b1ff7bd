"""FEA-11, SNK-03, PRJ-02, WIN-03, VAL-07: feature panels published as versions of definition-hashed nodes.

A node is one feature of one geography: the values and lineage edges of a source, a macro series, a roll-up or a
derived feature.  Its hash covers its spec, geography, frequency and the hashes of what it reads: the content of
its metric's observations, of the crosswalk or of the geography-period spine, or the nodes it is derived
from.  A build writes only nodes whose hash the store does not hold, so a changed spec rewrites that
feature and its descendants, and a changed metric rewrites what reads it.

Nothing is visible before the manifest rows of the version are appended, in one file, after the gate over all of
its values has passed.  A reader pins one version and recounts what it reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import hashing, keyed
from parcelflow.operators import features
from parcelflow.plans import feature_panel
from parcelflow.sources.store import StoreError, _exists
from parcelflow.session import checkpointed

#: Part of every node's identity: raise it when a rule of the build changes.
RULES = "1"
MANIFEST = (
    "version string, geography string, frequency string, role string, feature_name string, node_hash string, folder string, rows long, edge_rows long,"
    " content_hash string, edges_hash string, rebuilt boolean, created_at timestamp, entry_hash string"
)
SIGNED = ("version", "geography", "frequency", "role", "feature_name", "node_hash", "folder", "rows", "edge_rows", "content_hash", "edges_hash", "rebuilt")
VALUES = (
    "geography_type string, geography_id string, state_fips string, county_fips string, cbsa string, period_start date, value double, unit string,"
    " transformation string, available_at date, quality_level string, lineage_id string, feature_name string"
)
EDGES = "lineage_id string, parent_id string, parent_kind string, feature_name string"
GATES = ("non_finite_values", "forbidden_imputation_labels", "invalid_period_starts", "duplicate_feature_keys")


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if _exists(spark, path) else spark.createDataFrame([], MANIFEST)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """WIN-03: every published version with its time, nodes and rebuilt nodes; ``active`` is the newest of its geography
    and frequency."""
    rows = manifest(spark, root).groupBy("geography", "frequency", "version").agg(
        F.min("created_at").alias("created_at"), F.count_if(F.expr("role NOT IN ('panel', 'spine')")).alias("nodes"), F.count_if(F.expr("rebuilt AND role NOT IN ('panel', 'spine')")).alias("rebuilt")
    )
    newest = keyed.newest(rows, ["geography", "frequency"], [F.col("created_at").desc(), F.col("version").desc()]).select("geography", "frequency", F.col("version").alias("__v"))
    return rows.join(newest, ["geography", "frequency"]).withColumn("active", F.col("version") == F.col("__v")).drop("__v")


@dataclass
class Build:
    """One build: the nodes it needs, those the store holds, and those it writes."""

    spark: SparkSession
    root: str
    geography: str
    frequency: str
    folder: str = ""
    nodes: dict[tuple[str, str], dict] = field(default_factory=dict)

    def __post_init__(self):
        self.folder = f"{self.root}/builds/{uuid.uuid4().hex}"

    def hash_of(self, spec: features.FeatureSpec | None, role: str, *inputs: str) -> str:
        return digest(RULES, self.geography, self.frequency, role, asdict(spec) if spec else None, inputs)

    def held(self, wanted: dict[tuple[str, str], str]) -> dict[tuple[str, str], str]:
        """Takes known nodes over and returns the (role, name) and hash of the missing ones."""
        found = {r["node_hash"]: r.asDict() for r in manifest(self.spark, self.root).filter(F.col("node_hash").isin(list(wanted.values()))).collect()}
        for key, value in wanted.items():
            if value in found:
                self.nodes[key] = {**found[value], "rebuilt": False}
        return {key: value for key, value in wanted.items() if value not in found}

    def write(self, role: str, missing: dict[tuple[str, str], str], values: DataFrame, edges: DataFrame) -> None:
        """Values and edges of missing nodes of one role, partitioned by feature, then recounted from the files."""
        names = [name for r, name in missing if r == role]
        if not names:
            return
        folder = f"{self.folder}/{role}-{len(self.nodes)}"
        for name, df, schema in (("values", values.select(*features.VALUE_COLUMNS), VALUES), ("edges", edges.select("feature_name", *features.EDGE_COLUMNS), EDGES)):
            df.filter(F.col("feature_name").isin(names)).write.partitionBy("feature_name").option("compression", "zstd").parquet(f"{folder}/{name}")
        counts = {r["feature_name"]: r for r in recounted(self.spark, folder)}
        for name in names:
            r = counts.get(name)
            if r is None:
                raise StoreError(f"feature {name} has no values")
            self.nodes[role, name] = {
                "role": role, "feature_name": name, "node_hash": missing[role, name], "folder": folder, "rebuilt": True,
                "rows": r["rows"], "edge_rows": r["edge_rows"], "content_hash": r["content_hash"], "edges_hash": r["edges_hash"],
            }

    def read(self, *keys: tuple[str, str]) -> DataFrame:
        return read_nodes(self.spark, [self.nodes[k] for k in keys], "values", VALUES).select(*features.VALUE_COLUMNS)


def recounted(spark: SparkSession, folder: str) -> list:
    """Rows and order-free digests per feature of one folder of nodes, from its files."""
    values = hashing.dataset_hash(spark.read.schema(VALUES).parquet(f"{folder}/values"), ["feature_name"])
    edges = hashing.dataset_hash(spark.read.schema(EDGES).parquet(f"{folder}/edges"), ["feature_name"], "edges_hash").withColumnRenamed("rows", "edge_rows")
    return values.join(edges, "feature_name", "left").fillna(0, ["edge_rows"]).fillna("", ["edges_hash"]).collect()


def read_nodes(spark: SparkSession, nodes: list[dict], part: str, schema: str) -> DataFrame:
    """Rows of some nodes: one scan per folder, pruned to their features."""
    by_folder: dict[str, list[str]] = {}
    for n in nodes:
        by_folder.setdefault(n["folder"], []).append(n["feature_name"])
    scans = [spark.read.schema(schema).parquet(f"{f}/{part}").filter(F.col("feature_name").isin(names)) for f, names in sorted(by_folder.items())]
    return reduce(lambda a, b: a.unionByName(b), scans)


def publish(
    facts: DataFrame, root: str, *, geography: str, frequency: str, specs=features.REGISTRY, crosswalk: DataFrame | None = None, only: list[str] | None = None
) -> dict:
    """Builds what is missing and publishes the version; a version that is there already is ``unchanged``."""
    spark = facts.sparkSession
    chosen = features.specs_for(feature_panel.needed(specs, only) if only else specs, frequency, geography)
    facts = facts.filter(F.col("metric").isin([s.metric for s in chosen if s.metric]))
    build = Build(spark, root, geography, frequency)
    content = {r["metric"]: r["content_hash"] for r in hashing.dataset_hash(facts, ["metric"]).collect()}
    sources, macros = [s for s in chosen if s.kind == "source"], [s for s in chosen if s.kind in ("period_mean", "period_end")]
    hashes = {("base", s.name): build.hash_of(s, "base", content.get(s.metric, "")) for s in [*sources, *macros]}
    missing = build.held(hashes)
    fresh = [s for s in sources if ("base", s.name) in missing]
    parts = []
    if fresh:
        groups = checkpointed(features.source_groups(facts, fresh))
        feature_panel.refuse_conflicts(groups)
        parts.append((features.source_features(groups, frequency), feature_panel.observation_edges(facts, fresh, groups, frequency)))
    late = [s for s in macros if ("base", s.name) in missing]
    if late:
        values = checkpointed(features.macro_values(facts, late, frequency))
        parts.append((values, feature_panel.macro_edges(facts, late, values, frequency)))
    for values, edges in parts:
        names = {r["feature_name"] for r in values.select("feature_name").distinct().collect()}
        build.write("base", {k: h for k, h in missing.items() if k[1] in names}, values, edges)
    absent = [k[1] for k in hashes if k not in build.nodes]
    if absent:
        raise StoreError(f"no observations for {sorted(absent)}")
    local = {s.name: ("base", s.name) for s in sources}
    if geography == "cbsa":
        if crosswalk is None:
            raise ValueError("a cbsa panel needs a crosswalk")
        members = hashing.dataset_hash(crosswalk).first()["content_hash"]
        summed = [s for s in sources if s.cbsa_sum]
        wanted = {("local", s.name): build.hash_of(s, "local", hashes["base", s.name], members) for s in summed}
        hashes |= wanted
        todo = build.held(wanted)
        again = [s for s in summed if ("local", s.name) in todo]
        if again:
            county = build.read(*[("base", s.name) for s in again])
            sums = checkpointed(features.cbsa_sums(county, crosswalk, again))
            build.write("local", todo, sums, feature_panel.sum_edges(county, sums, crosswalk))
        local = {s.name: ("local", s.name) for s in summed}
    if not local:
        raise ValueError("a panel needs a source feature, which gives its geographies and periods")
    spine = features.panel_spine(build.read(*local.values()), geography)
    places = build.hash_of(None, "spine", *sorted(hashes[k] for k in local.values()))
    if build.held({("spine", ""): places}):
        spine = checkpointed(spine)
        r = hashing.dataset_hash(spine).first()
        build.nodes["spine", ""] = {
            "role": "spine", "feature_name": "", "node_hash": places, "folder": "", "rebuilt": True, "rows": r["rows"], "edge_rows": 0, "content_hash": r["content_hash"], "edges_hash": "",
        }
    where = build.nodes["spine", ""]["content_hash"]
    wanted = {("local", s.name): build.hash_of(s, "local", hashes["base", s.name], where) for s in macros}
    hashes |= wanted
    todo = build.held(wanted)
    if todo:
        spread = checkpointed(features.broadcast_macro(build.read(*[("base", name) for _, name in todo]), spine, geography))
        build.write("local", todo, spread.drop("parents"), feature_panel.parent_edges(spread))
    local |= {s.name: ("local", s.name) for s in macros}
    for level in features.levels(chosen):
        wanted = {("derived", s.name): build.hash_of(s, "derived", *[hashes[local[i]] for i in s.inputs], where if s.kind == "lag" else "") for s in level}
        hashes |= wanted
        todo = build.held(wanted)
        again = [s for s in level if ("derived", s.name) in todo]
        if again:
            inputs = sorted({local[i] for s in again for i in s.inputs})
            derived = checkpointed(features.derive(build.read(*inputs), again, geography, frequency, spine))
            build.write("derived", todo, derived.drop("parents"), feature_panel.parent_edges(derived))
        local |= {s.name: ("derived", s.name) for s in level}
    version = digest(geography, frequency, sorted((*k, n["node_hash"]) for k, n in build.nodes.items()))[:24]
    if not manifest(spark, root).filter(F.col("version") == version).isEmpty():
        return {"version": version, "outcome": "unchanged", "rebuilt": []}
    counters = features.profile_panel(build.read(*[k for k in build.nodes if k[0] != "spine"]), frequency).first()
    failed = {g: counters[g] for g in GATES if counters[g]}
    if failed:
        raise StoreError(f"the panel does not pass its gate: {failed}")
    rebuilt = sorted({name for (_, name), n in build.nodes.items() if n["rebuilt"] and name})
    wide = features.pivot_panel(build.read(*local.values()), [s.name for s in chosen if s.name in local], geography, frequency)
    wide.write.option("compression", "zstd").parquet(f"{build.folder}/panel")
    r = hashing.dataset_hash(spark.read.parquet(f"{build.folder}/panel")).first()
    build.nodes["panel", ""] = {
        "role": "panel", "feature_name": "", "node_hash": version, "folder": f"{build.folder}/panel", "rebuilt": True, "rows": r["rows"], "edge_rows": 0, "content_hash": r["content_hash"], "edges_hash": "",
    }
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [{**n, "version": version, "geography": geography, "frequency": frequency, "created_at": now} for n in build.nodes.values()]
    rows = [{**r, "entry_hash": digest([r[c] for c in SIGNED])} for r in rows]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return {"version": version, "outcome": "published", "rebuilt": rebuilt}


def open_version(spark: SparkSession, root: str, *, geography: str, frequency: str, version: str | None = None, verify: bool = True) -> feature_panel.FeatureTables:
    """PRJ-02, VAL-07: the values, edges and panel of one version, the newest where none is named.

    What is verified is read once for it: manifest entries by their digest, nodes and panel by rows and content.
    """
    rows = manifest(spark, root).filter((F.col("geography") == geography) & (F.col("frequency") == frequency))
    if version is None:
        newest = rows.agg(F.max(F.struct("created_at", "version")).alias("n")).first()["n"]
        version = newest["version"] if newest else None
    entries = [r.asDict() for r in rows.filter(F.col("version") == version).collect()]
    panels = [r for r in entries if r["role"] == "panel"]
    if not panels:
        raise StoreError("no published panel version matches")
    nodes = [r for r in entries if r["role"] not in ("panel", "spine")]
    if verify:
        if any(r["entry_hash"] != digest([r[c] for c in SIGNED]) for r in entries):
            raise StoreError("a manifest entry was changed")
        for folder in sorted({n["folder"] for n in nodes}):
            counts = {r["feature_name"]: r for r in recounted(spark, folder)}
            for n in nodes:
                r = counts.get(n["feature_name"])
                if n["folder"] == folder and (r is None or any(r[c] != n[c] for c in ("rows", "edge_rows", "content_hash", "edges_hash"))):
                    raise StoreError(f"stored values of {n['feature_name']} differ from the manifest")
        r = hashing.dataset_hash(spark.read.parquet(panels[0]["folder"])).first()
        if r is None or r["content_hash"] != panels[0]["content_hash"]:
            raise StoreError("the stored panel differs from the manifest")
    return feature_panel.FeatureTables(
        read_nodes(spark, nodes, "values", VALUES).select(*features.VALUE_COLUMNS), read_nodes(spark, nodes, "edges", EDGES).select(*features.EDGE_COLUMNS), spark.read.parquet(panels[0]["folder"])
    )
