"""Queries, profiles and version selection over canonical observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import keyed
from parcelflow.schemas import OBSERVATION_COLUMNS

MAX_LIMIT = 100_000


def query_observations(df: DataFrame, *, metrics=None, geography_id=None, columns=None, limit: int | None = None) -> DataFrame:
    """PRJ-01/02: whitelisted columns, equality filters; with a limit, the first rows by (date, id)."""
    columns = list(columns or [c for c in df.columns if c in OBSERVATION_COLUMNS])
    unknown = set(columns) - set(OBSERVATION_COLUMNS)
    if not columns or unknown:
        raise ValueError(f"columns must be canonical observation columns: {sorted(unknown)}")
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    if metrics is not None:
        df = df.filter(F.col("metric").isin(list(metrics)))
    if geography_id is not None:
        df = df.filter(F.col("geography_id") == geography_id)
    return (df if limit is None else df.orderBy("observation_date", "observation_id").limit(limit)).select(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str], constants: dict | None = None) -> DataFrame:
    """PRJ-03: project source columns to new names and add constants."""
    return df.select(
        *[F.col(source).alias(target) for source, target in mapping.items()],
        *[F.lit(value).alias(name) for name, value in (constants or {}).items()],
    )


def summary(df: DataFrame) -> DataFrame:
    """AGG-01: files, rows, distinct metrics and date range."""
    return df.agg(
        F.countDistinct("source_file").alias("files"), F.count(F.lit(1)).alias("rows"),
        F.countDistinct("metric").alias("metrics"),
        F.min("observation_date").alias("earliest"), F.max("observation_date").alias("latest"),
    )


def coverage(df: DataFrame, approximate: bool = False) -> DataFrame:
    """AGG-02: range, rows and distinct geographies by source, metric, geography and period type."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy("source_id", "metric", "geography_type", "period_type").agg(
        F.min("observation_date").alias("earliest"), F.max("observation_date").alias("latest"),
        F.count(F.lit(1)).alias("observations"), distinct("geography_id").alias("geographies"),
        distinct("source_dataset").alias("datasets"),
    )


def profile(df: DataFrame) -> DataFrame:
    """AGG-03: one row of quality counters."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"), F.countDistinct("observation_id").alias("unique_observation_ids"),
        F.count_if(F.col("value").isNull()).alias("null_values"),
        F.min("observation_date").alias("earliest"), F.max("observation_date").alias("latest"),
        F.countDistinct("geography_id").alias("geographies"), F.countDistinct("metric").alias("metrics"),
        F.count_if(F.col("value") < 0).alias("negative_values_review"),
    ).withColumns({
        "duplicate_observations": F.col("rows") - F.col("unique_observation_ids"),
        "null_percentage": F.try_divide(F.col("null_values").cast("double"), F.col("rows").cast("double")) * 100,
    })


def active_versions(ledger: DataFrame) -> DataFrame:
    """WIN-02/03: the newest validated version per (source, dataset)."""
    if "status" in ledger.columns:
        ledger = ledger.filter("status = 'validated'")
    return keyed.newest(
        ledger, ["source_id", "source_dataset"], [F.col("created_at").desc(), F.col("source_version").desc()]
    )


def active_observations(df: DataFrame, ledger: DataFrame, columns: tuple[str, ...] = ("manifest_hash",)) -> DataFrame:
    """JN-01: facts of active versions; the ledger side is one row per dataset, so AQE may broadcast it."""
    keys = ["source_id", "source_dataset", "source_version"]
    return df.join(active_versions(ledger).select(*keys, *columns), keys)


def union_versions(*frames: DataFrame) -> DataFrame:
    """SET-01/SRC-21: union by column name; columns absent in a version become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drifted_labels(df: DataFrame, key: str, label: str, expected: list[str]) -> DataFrame:
    """SET-02: labels of each key missing from or foreign to the expected set."""
    wanted = F.array(*[F.lit(e) for e in expected])
    seen = df.groupBy(key, label).count().groupBy(key).agg(F.collect_set(label).alias("seen"))
    return seen.select(
        key,
        F.array_join(F.array_sort(F.array_except(wanted, "seen")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("seen", wanted)), ",").alias("unexpected"),
    )


def spine(df: DataFrame) -> DataFrame:
    """SET-03: distinct geography and period pairs."""
    return df.select("geography_id", "period_start").distinct()


def collapse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """SET-04: one row per key with the number of collapsed copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """SET-05: case-folded substring search; no character is a wildcard."""
    needle = F.lit(term.lower())
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in columns])
    return df.filter(hit)


def page(df: DataFrame, *, sort: str, allowed: tuple[str, ...], tie: str, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """TOP-01: whitelisted sort, nulls last, id tie-break, at most 200 rows per page."""
    if sort not in allowed:
        raise ValueError(f"sort must be one of {sorted(allowed)}")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset non-negative")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(order, F.col(tie).asc()).offset(offset).limit(limit)


def next_page(df: DataFrame, *, sort: str, tie: str, after: tuple | None = None, limit: int = 50) -> DataFrame:
    """TOP-01 keyset form: deep pages cost the same as the first one."""
    if after is not None:
        value, last_id = after
        later = (F.col(sort) > F.lit(value)) | ((F.col(sort) == F.lit(value)) & (F.col(tie) > F.lit(last_id)))
        df = df.filter(later | F.col(sort).isNull() if value is not None else F.col(sort).isNull() & (F.col(tie) > F.lit(last_id)))
    return df.orderBy(F.col(sort).asc_nulls_last(), F.col(tie).asc()).limit(limit)


def clustered_for_write(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """TOP-02: range-partitioned and sorted by (geography, period, feature) for clustered files."""
    keys = ["geography_id", "period_start", "feature_name"]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def current_crosswalk(df: DataFrame) -> DataFrame:
    """WIN-01: latest membership per county."""
    return keyed.newest(
        df.filter((F.col("metric") == "county_cbsa_membership") & F.col("cbsa").isNotNull()),
        ["county_fips"], [F.col("observation_date").desc(), F.col("source_version").desc()],
    )


def crosswalk_as_of(requests: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """JN-07: for each (county_fips, on_date) the latest membership effective by that date."""
    lookups = requests.select("county_fips", "on_date").distinct()
    eligible = lookups.join(crosswalk, "county_fips").filter(F.col("observation_date") <= F.col("on_date"))
    found = eligible.groupBy("county_fips", "on_date").agg(
        F.max_by(F.struct("cbsa", "observation_date"), F.struct("observation_date", "source_version")).alias("m")
    )
    return found.select("county_fips", "on_date", "m.cbsa", F.col("m.observation_date").alias("effective_date"))


def annual_growth(df: DataFrame, metric: str, years: int = 1) -> DataFrame:
    """FEA-13: exact compound growth between annual observations, with both input ids."""
    rows = df.filter((F.col("metric") == metric) & (F.col("period_type") == "annual"))
    key = ["geography_type", "geography_id"]
    current = rows.select(*key, F.year("observation_date").alias("year"), F.col("value").cast("double").alias("current"), F.col("observation_id").alias("current_id"))
    prior = rows.select(*key, (F.year("observation_date") + years).alias("year"), F.col("value").cast("double").alias("prior"), F.col("observation_id").alias("prior_id"))
    joined = current.join(prior, [*key, "year"]).filter("prior <> 0 AND current / prior > 0")
    return joined.select(
        *key, "year", (F.pow(F.col("current") / F.col("prior"), F.lit(1.0 / years)) - 1).alias("value"), "prior_id", "current_id"
    )


def observation_versions(df: DataFrame, ledger: DataFrame, observation_ids: DataFrame) -> DataFrame:
    """LIN-01: every stored version of the requested observations with its manifest."""
    keys = ["source_id", "source_dataset", "source_version"]
    wanted = observation_ids.select("observation_id").distinct()
    return df.join(wanted, "observation_id", "left_semi").join(ledger.select(*keys, "manifest_hash", "created_at"), keys)
