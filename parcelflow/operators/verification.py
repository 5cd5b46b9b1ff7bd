"""Verification, reconciliation, as-of selection and derivations of target observations.

Every check reduces its keys with a partial aggregate, keeps the offending keys, and joins
those back to the rows, so the full rows are never shuffled into one task per key.
Findings are a long table (code, severity, finding_id, observation_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import keyed, numbers, periods
from parcelflow.schemas import BLOCKING_FINDINGS, SOURCE_RELIABILITY
from parcelflow.session import checkpointed, stored

NATURAL = ["geography_type", "geography_id", "period", "frequency", "property_type", "property_subtype", "metric"]
SERIES = ["geography_type", "geography_id", "frequency", "property_type", "property_subtype", "metric", "methodology", "source_name"]
RELEASE = ["geography_type", "geography_id", "period", "frequency", "property_type", "property_subtype", "source_name", "vintage"]
COPY = [*NATURAL, "source_name", "source_identifier", "vintage", "methodology"]
CONFLICT_TOLERANCE = 0.05
WARNING, ERROR, INFO = "warning", "error", "info"
#: Every code, in the order of a list of codes; a set of codes is a number with one bit per code.
CODES = (
    "duplicate_observation", "frequency_mismatch", "market_geography_mismatch", "methodology_change", "methodology_mismatch", "missing_periods", "noi_margin_mismatch",
    "occupancy_vacancy_mismatch", "operating_identity_mismatch", "operating_unit_mismatch", "proxy_not_institutional_target", "revised_observation", "source_conflict", "stale_retrieval",
    "sudden_jump", "unconfirmed_verification",
)
BITS = {code: 1 << place for place, code in enumerate(CODES)}
#: Rows of one period of one series that stay in one piece.
PERIOD_PIECE = 262144


def _emit(rows: DataFrame, code: str, severity: str, keys: list[str]) -> DataFrame:
    group = F.sha2(F.concat_ws("|", F.lit(code), *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]), 256)
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), group.alias("finding_id"), "observation_id")


def _by_key(rows, code, severity, keys, having: Column, *aggregates) -> DataFrame:
    return _emit(keyed.rows_of_groups(rows, keys, having, *aggregates), code, severity, keys)


def duplicates(rows: DataFrame) -> DataFrame:
    """VER-01.  Hashes of the keys are counted first; only rows whose hash occurs more often are compared by their keys."""
    return _by_key(_alike(rows), "duplicate_observation", ERROR, COPY, F.col("__n") > 1, F.count(F.lit(1)).alias("__n"))


def _alike(rows: DataFrame) -> DataFrame:
    """Rows whose hash of the keys of a duplicate occurs more often; among them are all duplicates."""
    hashed = rows.select(*COPY, "observation_id", F.xxhash64(*COPY).alias("__hash"))
    often = stored(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__hash"))
    return hashed.join(often, "__hash", "left_semi")


def _mixed(rows: DataFrame, code: str, severity: str, keys: list[str], column: str) -> DataFrame:
    """Rows of the keys that hold more than one value.  The distinct values come first, by hashing; texts in the state of
    an aggregate would have all rows sorted."""
    kinds = rows.select(*keys, column).distinct().groupBy(*keys).agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    return _rows_of(rows, code, severity, keys, kinds.filter("__low <> __high"))


def _rows_of(rows: DataFrame, code: str, severity: str, keys: list[str], bad: DataFrame) -> DataFrame:
    return _emit(keyed.null_safe_join(rows, stored(bad.select(*keys)), keys), code, severity, keys)


def methodology_mismatch(rows: DataFrame) -> DataFrame:
    """VER-02."""
    return _mixed(rows, "methodology_mismatch", WARNING, NATURAL, "methodology")


def source_conflicts(rows: DataFrame) -> DataFrame:
    """VER-03: the largest pairwise difference of a group is reached by its extremes.

    For rates that is max-min.  For levels of one sign 1-min/max is largest for the extremes,
    and any pair of opposite signs already differs by more than its larger magnitude.
    """
    gap = numbers.governed_difference(F.col("__min"), F.col("__max"), F.col("__rate"))
    having = (F.col("__s1") != F.col("__s2")) & (F.round(gap, 12) > CONFLICT_TOLERANCE)
    value = F.col("value").cast("double")
    by_source = rows.groupBy(*NATURAL, "source_name").agg(F.min(value).alias("__min"), F.max(value).alias("__max"), F.first("is_rate").alias("__rate"))
    groups = by_source.groupBy(*NATURAL).agg(
        F.min("source_name").alias("__s1"), F.max("source_name").alias("__s2"), F.min("__min").alias("__min"), F.max("__max").alias("__max"), F.first("__rate").alias("__rate"),
    )
    return _rows_of(rows, "source_conflict", WARNING, NATURAL, groups.filter(having))


def revisions(rows: DataFrame) -> DataFrame:
    """VER-04."""
    keys = [*NATURAL, "source_name", "methodology"]
    having = (F.col("__v1") != F.col("__v2")) & (F.col("__a") != F.col("__b"))
    by_vintage = rows.groupBy(*keys, "vintage").agg(F.min("value").alias("__a"), F.max("value").alias("__b"))
    groups = by_vintage.groupBy(*keys).agg(F.min("vintage").alias("__v1"), F.max("vintage").alias("__v2"), F.min("__a").alias("__a"), F.max("__b").alias("__b"))
    return _rows_of(rows, "revised_observation", INFO, keys, groups.filter(having))


def frequency_mismatch(rows: DataFrame) -> DataFrame:
    """VER-05."""
    keys = ["geography_type", "geography_id", "property_type", "property_subtype", "metric", "methodology", "source_name"]
    return _mixed(rows, "frequency_mismatch", WARNING, keys, "frequency")


def methodology_change(rows: DataFrame) -> DataFrame:
    """VER-06."""
    keys = ["geography_type", "geography_id", "property_type", "property_subtype", "metric", "source_name"]
    return _mixed(rows, "methodology_change", WARNING, keys, "methodology")


def _sides(rows: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Per release key with two metrics or more that occur once: count and (only meaningful when single) value, unit and
    id of each metric.  Rows are counted first, by hashing, and units and ids are taken from the rows of such keys."""
    rows = rows.filter(F.col("metric").isin(list(metrics)))
    held = rows.groupBy(*RELEASE).agg(*[F.count_if(F.col("metric") == metric).alias(f"__{name}") for metric, name in metrics.items()])
    singles = reduce(lambda a, b: a + b, [(F.col(f"__{name}") == 1).cast("int") for name in metrics.values()])
    rows = keyed.null_safe_join(rows, stored(held.filter(singles >= 2).select(*RELEASE)), RELEASE)
    aggregates = []
    for metric, name in metrics.items():
        hit = F.col("metric") == metric
        aggregates += [
            F.count_if(hit).alias(f"{name}_n"), F.max(F.when(hit, F.col("value").cast("double"))).alias(name),
            F.max(F.when(hit, F.col("unit"))).alias(f"{name}_unit"), F.max(F.when(hit, F.col("observation_id"))).alias(f"{name}_id"),
        ]
    return rows.groupBy(*RELEASE).agg(*aggregates)


def _pair_findings(sides: DataFrame, code: str, bad: Column, ids: list[str]) -> DataFrame:
    hits = sides.filter(bad).withColumn("observation_id", F.explode(F.array(*ids)))
    return _emit(hits, code, ERROR, RELEASE)


def complement_mismatch(rows: DataFrame) -> DataFrame:
    """VER-07."""
    sides = _sides(rows, {"occupancy_rate": "occ", "vacancy_rate": "vac"})
    bad = (F.col("occ_n") == 1) & (F.col("vac_n") == 1) & (F.abs(F.col("occ") + F.col("vac") - 1) > 0.000001)
    return _pair_findings(sides, "occupancy_vacancy_mismatch", bad, ["occ_id", "vac_id"])


def operating_mismatches(rows: DataFrame) -> DataFrame:
    """VER-08/09/10 from one aggregate per release."""
    sides = _sides(rows, {"same_store_revenue": "rev", "same_store_operating_expense": "exp", "same_store_noi": "noi", "noi_margin": "mar"})
    three = (F.col("rev_n") == 1) & (F.col("exp_n") == 1) & (F.col("noi_n") == 1)
    one_unit = (F.col("rev_unit") == F.col("exp_unit")) & (F.col("exp_unit") == F.col("noi_unit"))
    identity = F.abs(F.col("rev") - F.col("exp") - F.col("noi")) > 1
    margin = (F.col("rev_n") == 1) & (F.col("noi_n") == 1) & (F.col("mar_n") == 1) & (F.col("rev") > 0)
    off = F.abs(numbers.ratio(F.col("noi"), F.col("rev")) - F.col("mar")) > 0.0001
    return _pair_findings(sides, "operating_unit_mismatch", three & ~one_unit, ["rev_id", "exp_id", "noi_id"]).unionByName(
        _pair_findings(sides, "operating_identity_mismatch", three & one_unit & identity, ["rev_id", "exp_id", "noi_id"])
    ).unionByName(_pair_findings(sides, "noi_margin_mismatch", margin & off, ["rev_id", "noi_id", "mar_id"]))


def geography_mismatch(rows: DataFrame, governed: DataFrame) -> DataFrame:
    """VER-11, JN-17/18: market rows without a governed definition."""
    markets = rows.filter(F.col("geography_type").isin("market", "submarket"))
    return _emit(markets.join(governed.select("geography_id").distinct(), "geography_id", "left_anti"), "market_geography_mismatch", ERROR, ["observation_id"])


def proxies(rows: DataFrame) -> DataFrame:
    """VER-12."""
    other = ~F.coalesce(F.col("target_classification") == "institutional_target", F.lit(False))
    return _emit(rows.filter(other), "proxy_not_institutional_target", INFO, ["observation_id"])


def series_steps(rows: DataFrame) -> DataFrame:
    """Adjacent rows of each series in period order; rows of one period are ordered by id digest.

    A period of a series is one unit of work, and where one holds many rows the digest splits all periods into
    pieces.  Rows meet their neighbour inside their unit; units meet by their first and last rows.
    """
    needed = [*SERIES, "period", "value", "is_rate", "jump_threshold", "observation_id"]
    ordered = rows.select(*needed).withColumn("__idx", periods.period_index("period", "frequency")).filter("__idx IS NOT NULL")
    pieces = _pieces(ordered)
    unit, order = [*SERIES, "__idx"], ["__idx"]
    if pieces > 1:
        ordered = ordered.withColumn("__part", F.floor(F.conv(F.substring(F.md5("observation_id"), 1, 3), 16, 10).cast("int") * pieces / 4096).cast("int"))
        unit, order = [*unit, "__part"], [*order, "__part"]
    along = Window.partitionBy(*unit).orderBy("__tie", "value")
    now = F.struct(F.col("__idx").alias("idx"), F.col("value").cast("double").alias("value"), "observation_id", "period")
    placed = ordered.repartition(*unit).withColumns({"__tie": F.md5("observation_id"), "__now": now}).withColumn("__before", F.lag("__now").over(along))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = placed.withColumn("__last", F.last("__now").over(whole)).filter("__before IS NULL")
    across = first.withColumn("__before", F.lag("__last").over(Window.partitionBy(*SERIES).orderBy(*order))).drop("__last")
    stepped = placed.filter("__before IS NOT NULL").unionByName(across.filter("__before IS NOT NULL"))
    return stepped.withColumns({
        "gap": F.col("__idx") - F.col("__before.idx"), "previous_value": F.col("__before.value"), "previous_id": F.col("__before.observation_id"),
        "previous_period": F.col("__before.period"),
        "change": numbers.governed_difference(F.col("__before.value"), F.col("value").cast("double"), F.col("is_rate")),
    }).drop("__idx", "__tie", "__now", "__before", "__part")


def _pieces(ordered: DataFrame, series: list[str] = SERIES) -> int:
    """Pieces of a period, from the largest count among a 64th of the ids; it decides the spread alone, never a result."""
    some = ordered.filter(F.pmod(F.xxhash64("observation_id"), F.lit(64)) == 0)
    largest = some.groupBy(*series, "__idx").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return min(4096, 1 << (largest * 64 // PERIOD_PIECE).bit_length())


def _step_codes(gap: str | Column = "gap", change: str | Column = "change", threshold: str | Column = "jump_threshold") -> dict[str, Column]:
    gap, threshold = (F.col(c) if isinstance(c, str) else c for c in (gap, threshold))
    return {"missing_periods": gap > 1, "sudden_jump": F.coalesce(F.round(change, 12) > threshold, F.lit(False))}


def gaps_and_jumps(rows: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """VER-13/14, WIN-04/05."""
    steps = series_steps(rows) if steps is None else steps
    codes = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in _step_codes().items()]), lambda c: c.isNotNull())
    hits = steps.select(F.explode(codes).alias("code"), "observation_id", "previous_id")
    group = F.sha2(F.concat_ws("|", "code", "previous_id", "observation_id"), 256)
    return hits.withColumn("finding_id", group).select(
        "code", F.lit(WARNING).alias("severity"), "finding_id", F.explode(F.array("previous_id", "observation_id")).alias("observation_id")
    )


def step_hits(rows: DataFrame) -> DataFrame:
    """VER-13/14: pairs of neighbours that fail, with their codes as bits."""
    return series_steps(rows).select("previous_id", "observation_id", _bits(_step_codes()).alias("codes")).filter("codes <> 0")


def _bits(checks: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(bad, F.lit(BITS[code])).otherwise(F.lit(0)) for code, bad in checks.items()])


def retrieval_findings(rows: DataFrame, evaluated_on: str, confirmed: bool) -> DataFrame:
    """VER-15/16."""
    age = F.datediff(F.lit(evaluated_on).cast("date"), F.col("retrieved_on"))
    stale = _emit(rows.filter(age > 730), "stale_retrieval", WARNING, ["observation_id"])
    if confirmed:
        return stale
    claimed = rows.filter("verification_status = 'analyst_verified'")
    return stale.unionByName(_emit(claimed, "unconfirmed_verification", WARNING, ["observation_id"]))


def retrieval_totals(rows: DataFrame, evaluated_on: str, confirmed: bool) -> DataFrame:
    """Findings, rows and observations per code of ``retrieval_findings``, whose findings are the observations: an id moves
    once with its codes as bits, and no finding ids are formed."""
    checks = {"stale_retrieval": F.datediff(F.lit(evaluated_on).cast("date"), F.col("retrieved_on")) > 730}
    if not confirmed:
        checks["unconfirmed_verification"] = F.col("verification_status") == "analyst_verified"
    held = lambda code: F.col("codes").bitwiseAND(BITS[code]) != 0
    marks = rows.select("observation_id", _bits(checks).alias("codes")).filter("codes <> 0")
    ids = marks.groupBy("observation_id").agg(F.bit_or("codes").alias("codes"), *[F.count_if(held(c)).alias(f"__{c}") for c in checks])
    known = F.col("observation_id").isNotNull()
    counts = ids.agg(*[x for c in checks for x in (F.count_if(held(c)).alias(f"f_{c}"), F.sum(f"__{c}").alias(f"r_{c}"), F.count_if(held(c) & known).alias(f"o_{c}"))])
    each = [F.struct(F.lit(c).alias("code"), F.lit(WARNING).alias("severity"), *[F.col(f"{k}_{c}").alias(n) for k, n in (("f", "findings"), ("r", "rows"), ("o", "observations"))]) for c in checks]
    return counts.select(F.inline(F.array(*each))).filter("rows > 0")


def code_counts(found: DataFrame, by: list[str]) -> DataFrame:
    """Distinct findings, rows and distinct observations of rows of findings, each counted on its own: an id of an
    observation does not move with the id of its finding."""
    ids = found.groupBy(*by, "observation_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("observation_id").alias("observations"))
    findings = found.select(*by, "finding_id").distinct().groupBy(*by).agg(F.count("finding_id").alias("findings"))
    joined = keyed.null_safe_join(ids, findings, by) if by else ids.crossJoin(findings)
    return joined.select(*by, "findings", "rows", "observations")


METHOD = [*NATURAL, "source_name", "methodology"]
SERIES_METHOD = ["geography_type", "geography_id", "property_type", "property_subtype", "metric", "methodology", "source_name"]
SERIES_SOURCE = [k for k in SERIES_METHOD if k != "methodology"]


def group_flags(rows: DataFrame, stage=stored, every: bool = False) -> DataFrame:
    """VER-02..06 per (natural key, source, methodology): which of the group checks its rows fail; with ``every``, also
    the groups that fail none.

    The rows are aggregated once, to that key.  Natural keys, series and series across methodologies
    are coarser, so their statistics are aggregates of the first aggregate.
    """
    value = F.col("value").cast("double")
    by_vintage = rows.groupBy(*METHOD, "vintage").agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.first("is_rate").alias("__rate"))
    base = stage(by_vintage.groupBy(*METHOD).agg(
        F.min("vintage").alias("__v1"), F.max("vintage").alias("__v2"), F.min("__a").alias("__a"), F.max("__b").alias("__b"), F.first("__rate").alias("__rate"),
    ))
    extremes = lambda c: (F.min(c).alias("__low"), F.max(c).alias("__high"))
    mixed = (F.col("__low") != F.col("__high"))
    gap = numbers.governed_difference(F.col("__a"), F.col("__b"), F.col("__rate"))
    natural = base.groupBy(*NATURAL).agg(
        *extremes("methodology"), F.min("source_name").alias("__s1"), F.max("source_name").alias("__s2"), F.min("__a").alias("__a"), F.max("__b").alias("__b"),
        F.first("__rate").alias("__rate"),
    ).select(*NATURAL, mixed.alias("__mismatch"), ((F.col("__s1") != F.col("__s2")) & (F.round(gap, 12) > CONFLICT_TOLERANCE)).alias("__conflict"))
    frequency = base.groupBy(*SERIES_METHOD).agg(*extremes("frequency")).filter(mixed).select(*SERIES_METHOD, F.lit(True).alias("__frequency"))
    change = base.groupBy(*SERIES_SOURCE).agg(*extremes("methodology")).filter(mixed).select(*SERIES_SOURCE, F.lit(True).alias("__change"))
    revised = (F.col("__v1") != F.col("__v2")) & (F.col("__a") != F.col("__b"))
    flags = base.select(*METHOD, revised.alias("__revised"))
    flags = keyed.null_safe_join(flags, natural.filter("__mismatch OR __conflict"), NATURAL, "left")
    flags = keyed.null_safe_join(keyed.null_safe_join(flags, frequency, SERIES_METHOD, "left"), change, SERIES_SOURCE, "left")
    return stage(flags if every else flags.filter("__revised OR __mismatch OR __conflict OR __frequency OR __change"))


def release_findings(rows: DataFrame) -> DataFrame:
    """VER-07..10 from one aggregate per release, of the checks whose metrics occur."""
    metrics = {
        "occupancy_rate": "occ", "vacancy_rate": "vac", "same_store_revenue": "rev", "same_store_operating_expense": "exp", "same_store_noi": "noi", "noi_margin": "mar",
    }
    present = {metrics[r.metric] for r in rows.filter(F.col("metric").isin(list(metrics))).select("metric").distinct().collect()}
    single = lambda *names: reduce(lambda a, b: a & b, [F.col(f"{n}_n") == 1 for n in names])
    one_unit = (F.col("rev_unit") == F.col("exp_unit")) & (F.col("exp_unit") == F.col("noi_unit"))
    off = F.abs(numbers.ratio(F.col("noi"), F.col("rev")) - F.col("mar")) > 0.0001
    checks = (
        ("occupancy_vacancy_mismatch", single("occ", "vac") & (F.abs(F.col("occ") + F.col("vac") - 1) > 0.000001), ("occ", "vac")),
        ("operating_unit_mismatch", single("rev", "exp", "noi") & ~one_unit, ("rev", "exp", "noi")),
        ("operating_identity_mismatch", single("rev", "exp", "noi") & one_unit & (F.abs(F.col("rev") - F.col("exp") - F.col("noi")) > 1), ("rev", "exp", "noi")),
        ("noi_margin_mismatch", single("rev", "noi", "mar") & (F.col("rev") > 0) & off, ("rev", "noi", "mar")),
    )
    checks = [check for check in checks if present.issuperset(check[2])]
    if not checks:
        nothing = "code string, severity string, finding_id string, observation_id string"
        return rows.sparkSession.createDataFrame([], nothing)
    asked = {name for _, _, names in checks for name in names}
    sides = _sides(rows.filter(F.col("metric").isin([m for m, name in metrics.items() if name in asked])), metrics)
    found = F.array(*[F.when(bad, F.struct(*_named(code, ERROR, RELEASE), F.array(*[f"{n}_id" for n in ids]).alias("ids"))) for code, bad, ids in checks])
    hits = sides.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return hits.select("f.code", "f.severity", "f.finding_id", F.explode("f.ids").alias("observation_id"))


def _named(code: str, severity: str, keys: list[str]) -> tuple[Column, Column, Column]:
    group = F.sha2(F.concat_ws("|", F.lit(code), *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]), 256)
    return F.lit(code).alias("code"), F.lit(severity).alias("severity"), group.alias("finding_id")


def all_findings(
    rows: DataFrame, *, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None, stage=stored
) -> DataFrame:
    """Every check.  Group checks come from one aggregate and one join back, and go into one list per row with
    the checks of single rows; duplicates, releases, series steps and geographies have keys of their own."""
    age = F.datediff(F.lit(evaluated_on).cast("date"), F.col("retrieved_on"))
    other = ~F.coalesce(F.col("target_classification") == "institutional_target", F.lit(False))
    claimed = (F.col("verification_status") == "analyst_verified") & F.lit(not confirmed)
    own = ["observation_id"]
    checks = (
        (F.col("__mismatch"), "methodology_mismatch", WARNING, NATURAL), (F.col("__conflict"), "source_conflict", WARNING, NATURAL),
        (F.col("__revised"), "revised_observation", INFO, METHOD), (F.col("__frequency"), "frequency_mismatch", WARNING, SERIES_METHOD),
        (F.col("__change"), "methodology_change", WARNING, SERIES_SOURCE), (other, "proxy_not_institutional_target", INFO, own),
        (age > 730, "stale_retrieval", WARNING, own), (claimed, "unconfirmed_verification", WARNING, own),
    )
    found = F.array(*[F.when(bad, F.struct(*_named(code, severity, keys))) for bad, code, severity, keys in checks])
    flagged = keyed.null_safe_join(rows, group_flags(rows, stage), METHOD, "left")
    listed = flagged.select("observation_id", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("f.*", "observation_id")
    parts = [listed, duplicates(rows), release_findings(rows), gaps_and_jumps(rows)]
    if governed is not None:
        parts.append(geography_mismatch(rows, governed))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _row_marks(rows: DataFrame, flags: DataFrame, *, evaluated_on: str, confirmed: bool, governed: DataFrame | None) -> DataFrame:
    """The checks of groups and of single rows as bits, one number per row that fails any."""
    flagged = keyed.null_safe_join(rows, flags, METHOD, "left")
    return _with_own_codes(flagged, evaluated_on, confirmed, governed).select("observation_id", "codes").filter("codes <> 0")


def _with_own_codes(flagged: DataFrame, evaluated_on: str, confirmed: bool, governed: DataFrame | None) -> DataFrame:
    """Adds ``codes``: the checks of groups, whose flags the rows hold, and of single rows."""
    age = F.datediff(F.lit(evaluated_on).cast("date"), F.col("retrieved_on"))
    checks = {
        "methodology_mismatch": F.col("__mismatch"), "source_conflict": F.col("__conflict"), "revised_observation": F.col("__revised"), "frequency_mismatch": F.col("__frequency"),
        "methodology_change": F.col("__change"), "proxy_not_institutional_target": ~F.coalesce(F.col("target_classification") == "institutional_target", F.lit(False)),
        "stale_retrieval": age > 730,
    }
    if not confirmed:
        checks["unconfirmed_verification"] = F.col("verification_status") == "analyst_verified"
    if governed is not None:
        flagged = flagged.join(governed.select("geography_id", F.lit(True).alias("__governed")).distinct(), "geography_id", "left")
        checks["market_geography_mismatch"] = F.col("geography_type").isin("market", "submarket") & F.col("__governed").isNull()
    return flagged.withColumn("codes", _bits(checks)).drop("__governed", "__mismatch", "__conflict", "__revised", "__frequency", "__change")


def _recurring(rows: DataFrame) -> DataFrame:
    """Hashes of observation ids that occur twice; by chance also of a few that do not."""
    hashes = rows.filter("observation_id IS NOT NULL").select(F.xxhash64("observation_id").alias("__again"))
    return stored(hashes.groupBy("__again").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__again"))


def _coded(rows: DataFrame, *, evaluated_on: str, confirmed: bool, governed: DataFrame | None, agreement: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with ``codes``, those of all rows of the same id, and for totals ``own``, the row's own codes, ``first``, whether
    it is the first of its id, and ``step`` and ``pair``, the codes of the step that leads to it and of its pair of ids;
    beside them the groups, the flagged groups, the keys of duplicates and the findings of releases.  With an ``agreement``
rows hold their ``peer_distance`` too.

    The rows move once, to their series and period, and only those whose id recurs move again.  A number stands there
    for the keys of a group (``__group``), which come back by a join with the table of groups.
    """
    flags = group_flags(rows, every=True)
    series = stored(flags.select(*SERIES).distinct().withColumn("__series", F.monotonically_increasing_id()))
    numbered = keyed.null_safe_join(flags, series, SERIES).withColumn("__idx", periods.period_index("period", "frequency"))
    groups = stored(numbered.withColumn("__group", F.monotonically_increasing_id()))
    own = _with_own_codes(keyed.null_safe_join(rows, groups, METHOD), evaluated_on, confirmed, governed)

    copies = stored(_alike(rows).groupBy("__hash", *COPY).agg(F.count(F.lit(1)).alias("__n")))
    mixed = copies.groupBy("__hash").agg(F.count(F.lit(1)).alias("__kinds"))
    keys = F.when(F.col("__kinds") > 1, F.struct(*COPY))
    repeated = stored(copies.join(mixed, "__hash").filter("__n > 1").select(F.col("__hash").alias("__of"), keys.alias("__keys")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__keys.{k}")) for k in COPY])
    own = own.join(repeated, (F.xxhash64(*COPY) == F.col("__of")) & (F.col("__keys").isNull() | same), "left")
    own = own.withColumn("codes", F.col("codes").bitwiseOR(F.when(F.col("__of").isNotNull(), BITS["duplicate_observation"]).otherwise(0))).drop("__of", "__keys")

    released = stored(release_findings(rows))
    bit = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    ids = released.groupBy("observation_id").agg(F.bit_or(bit[F.col("code")]).alias("__released"))
    own = own.join(ids, "observation_id", "left").withColumn("codes", F.col("codes").bitwiseOR(F.coalesce("__released", F.lit(0)))).drop("__released")

    own = own.join(_recurring(rows), F.xxhash64("observation_id") == F.col("__again"), "left").withColumn("__again", F.col("__again").isNotNull())
    if agreement is not None:
        named = groups.select("__group", "__series", "__idx", *NATURAL, "source_name")
        agreement = keyed.null_safe_join(named, agreement, [*NATURAL, "source_name"]).select("__group", "__series", "__idx", "value", "peer_distance")
    stepped = _with_step_codes(own.drop(*METHOD), agreement)
    return stepped, groups.select("__group", *METHOD), flags, copies.filter("__n > 1"), released


def _with_distances(rows: DataFrame, agreement: DataFrame, unit: list[str], pieces: int) -> DataFrame:
    """Rows in their units with the distance of their group and value.  The distances come as rows of their own, so the
    rows move no more than they would without them."""
    parts = F.concat(F.sequence(F.lit(0), F.lit(pieces - 1)), F.array(F.lit(None).cast("int")))  # rows without an id have none
    other = agreement.withColumn("__part", F.explode(parts)) if pieces > 1 else agreement
    value = F.col("value").cast("double")
    kept = rows.columns
    both = rows.withColumns({"__value": value, "peer_distance": F.lit(None).cast("double"), "__peer": F.lit(False)}).unionByName(
        other.withColumns({"__value": value, "__peer": F.lit(True)}).drop("value"), allowMissingColumns=True
    )
    alike = Window.partitionBy(*unit, "__group", "__value")
    found = both.repartition(*unit).withColumn("peer_distance", F.max("peer_distance").over(alike))
    return found.filter("NOT __peer").select(*kept, "peer_distance")


def _with_step_codes(rows: DataFrame, agreement: DataFrame | None = None) -> DataFrame:
    """Adds the step codes of each row's two steps to ``codes``; ``step`` holds those of the step that leads to it.
    The order is that of ``series_steps``."""
    unit, order = ["__series", "__idx"], ["__idx"]
    pieces = _pieces(rows, ["__series"])
    if pieces > 1:
        rows = rows.withColumn("__part", F.floor(F.conv(F.substring(F.md5("observation_id"), 1, 3), 16, 10).cast("int") * pieces / 4096).cast("int"))
        unit, order = [*unit, "__part"], [*order, "__part"]
    along = Window.partitionBy(*unit).orderBy("__tie", "value", "observation_id")
    now = F.struct(
        F.col("__idx").alias("idx"), F.col("value").cast("double").alias("value"), F.col("jump_threshold").alias("threshold"), F.col("is_rate").alias("rate"), F.col("observation_id").alias("id"),
    )
    rows = rows.repartition(*unit) if agreement is None else _with_distances(rows, agreement, unit, pieces)
    placed = rows.withColumns({"__tie": F.md5("observation_id"), "__now": now})
    placed = placed.withColumns({"__before": F.lag("__now").over(along), "__after": F.lead("__now").over(along)}).drop("__tie")
    inside = F.col("__idx").isNull() | (F.col("__before").isNotNull() & F.col("__after").isNotNull())

    def codes(a: str, b: str) -> Column:
        gap = F.col(f"{b}.idx") - F.col(f"{a}.idx")
        change = numbers.governed_difference(F.col(f"{a}.value"), F.col(f"{b}.value"), F.col(f"{b}.rate"))
        return F.when(F.col("__idx").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull(), _bits(_step_codes(gap, change, F.col(f"{b}.threshold")))).otherwise(0)

    def judged(df: DataFrame) -> DataFrame:
        df = df.withColumn("step", codes("__before", "__now"))
        return df.withColumn("own", F.col("codes").bitwiseOR(F.col("step")).bitwiseOR(codes("__now", "__after")))

    plain = judged(placed.filter(inside & ~F.col("__again"))).withColumns({"codes": F.col("own"), "first": F.lit(True), "pair": F.col("step")})
    ends = Window.partitionBy("__series", "__inside").orderBy(*order, F.col("__before").isNotNull())
    rest = placed.filter(~inside | F.col("__again")).withColumn("__inside", inside)
    rest = rest.withColumns({"__lag": F.lag("__now").over(ends), "__lead": F.lead("__now").over(ends)})
    rest = judged(rest.withColumns({c: F.when(F.col("__inside"), F.col(c)).otherwise(F.coalesce(c, near)) for c, near in (("__before", "__lag"), ("__after", "__lead"))}))
    alike, paired = Window.partitionBy("observation_id"), Window.partitionBy("observation_id", "__before.id")
    one = lambda w: F.row_number().over(w.orderBy("own")) == 1
    rest = rest.withColumns({"codes": F.bit_or("own").over(alike), "first": one(alike), "pair": F.when(one(paired), F.bit_or("step").over(paired)).otherwise(0)})
    spare = ("__now", "__before", "__after", "__series", "__idx", "__part", "__again", "__inside", "__lag", "__lead")
    return plain.drop(*spare).unionByName(rest.drop(*spare))


def code_names(codes: Column) -> Column:
    return F.filter(F.array(*[F.when(codes.bitwiseAND(bit) != 0, F.lit(code)) for code, bit in BITS.items()]), lambda c: c.isNotNull())


def verified(rows: DataFrame, *, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None) -> DataFrame:
    """``judge`` with the ``code_sets`` of the same rows, which carry their codes along and are not joined by their ids."""
    coded, groups = _coded(rows, evaluated_on=evaluated_on, confirmed=confirmed, governed=governed)[:2]
    found = _judged_codes(coded.join(groups, "__group"), confirmed).withColumn("value", F.col("value").cast("double"))
    return found.withColumn("verification_findings", code_names(F.col("codes"))).select(*rows.columns, "verification_findings", "model_eligible")


def verified_scores(
    rows: DataFrame, agreement: DataFrame, *, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None, keys: bool = True
) -> DataFrame:
    """``with_confidence`` of the ``verified`` rows and the agreement of peers, which meets the rows where their steps are
    judged.  Without ``keys`` the columns of METHOD do not come back."""
    coded, groups = _coded(rows, evaluated_on=evaluated_on, confirmed=confirmed, governed=governed, agreement=agreement)[:2]
    found = _judged_codes(coded, confirmed).withColumn("value", F.col("value").cast("double")).withColumn("verification_findings", code_names(F.col("codes")))
    found = _confident(found, evaluated_on, confirmed)
    columns = rows.columns if keys else [c for c in rows.columns if c not in METHOD]
    return (found.join(groups, "__group") if keys else found).select(*columns, "verification_findings", "model_eligible", "confidence")


def _judged_codes(coded: DataFrame, confirmed: bool) -> DataFrame:
    """Rows without an id hold no codes; adds whether a row may enter a model."""
    coded = coded.withColumn("codes", F.when(F.col("observation_id").isNotNull(), F.col("codes")).otherwise(0))
    blocked = F.col("codes").bitwiseAND(reduce(lambda a, b: a | b, [BITS[c] for c in BLOCKING_FINDINGS])) != 0
    verified = (F.col("verification_status") == "analyst_verified") & F.lit(confirmed)
    return coded.withColumn("model_eligible", verified & ~((F.col("verification_status") == "rejected") | blocked))


def verified_counts(
    rows: DataFrame, by: list[str | Column], *also: Column, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None
) -> DataFrame:
    """Rows of ``verified`` counted (``n``, beside the aggregates of ``also``) per ``METHOD`` and ``by``, where ``codes`` is the
    set of codes as bits.  The rows are counted before the keys of their group come back, so they do not move for
    these keys."""
    coded, groups = _coded(rows, evaluated_on=evaluated_on, confirmed=confirmed, governed=governed)[:2]
    counts = _judged_codes(coded, confirmed).groupBy("__group", *by).agg(F.count(F.lit(1)).alias("n"), *also)
    return counts.join(groups, "__group").drop("__group")


def _marks(listed: DataFrame, repeated: DataFrame, released: DataFrame, hits: DataFrame) -> DataFrame:
    """(observation_id, codes as bits), once for every row and finding."""
    bit = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    ends = hits.select(F.explode(F.array("previous_id", "observation_id")).alias("observation_id"), "codes")
    parts = [repeated.select("observation_id", F.lit(BITS["duplicate_observation"]).alias("codes")), released.select("observation_id", bit[F.col("code")].alias("codes")), ends]
    return reduce(lambda a, b: a.unionByName(b), parts, listed)


def code_sets(rows: DataFrame, *, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None) -> DataFrame:
    """``all_findings`` as one sorted list of codes per observation id, for what asks no finding ids: a finding moves as a bit."""
    listed = _row_marks(rows, group_flags(rows), evaluated_on=evaluated_on, confirmed=confirmed, governed=governed)
    marks = _marks(listed, duplicates(rows), release_findings(rows), step_hits(rows))
    sets = marks.groupBy("observation_id").agg(F.bit_or("codes").alias("codes"))
    return sets.select("observation_id", code_names(F.col("codes")).alias("verification_findings"))


def finding_totals(rows: DataFrame, *, evaluated_on: str, confirmed: bool = False, governed: DataFrame | None = None) -> DataFrame:
    """Findings, rows and distinct observations per code of ``all_findings``, without a row per finding.

    A finding of a group is a key of the group flags, one of a single row is its observation, and one of a step is
    its pair of rows.
    """
    coded, _, flags, copies, released = _coded(rows, evaluated_on=evaluated_on, confirmed=confirmed, governed=governed)
    steps = ("missing_periods", "sudden_jump")
    releases = released.groupBy("code").agg(F.countDistinct("finding_id").alias("__findings"), F.count(F.lit(1)).alias("__rows"))
    known = F.col("observation_id").isNotNull()
    held = lambda column, code: F.col(column).bitwiseAND(BITS[code]) != 0
    counts = coded.agg(
        *[F.count_if(held("own", c)).alias(f"r_{c}") for c in CODES], *[F.count_if(held("codes", c) & F.col("first") & known).alias(f"o_{c}") for c in CODES],
        *[F.coalesce(F.max((held("codes", c) & ~known).cast("int")), F.lit(0)).alias(f"n_{c}") for c in CODES],
        *[F.count_if(held("step", c)).alias(f"s_{c}") for c in steps], *[F.count_if(held("pair", c)).alias(f"p_{c}") for c in steps],
    )
    listed = {c: (F.col(f"s_{c}") * 2, F.col(f"p_{c}")) if c in steps else (F.col(f"r_{c}"), F.col(f"o_{c}") + F.col(f"n_{c}")) for c in CODES}
    each = [F.struct(F.lit(c).alias("code"), n.alias("rows"), f.alias("findings"), F.col(f"o_{c}").alias("observations")) for c, (n, f) in listed.items()]
    totals = counts.select(F.inline(F.array(*each)))
    grouped = {
        "methodology_mismatch": ("__mismatch", NATURAL), "source_conflict": ("__conflict", NATURAL), "revised_observation": ("__revised", METHOD),
        "frequency_mismatch": ("__frequency", SERIES_METHOD), "methodology_change": ("__change", SERIES_SOURCE),
    }
    keys = [flags.filter(flag).select(*names).distinct().agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("__findings")) for code, (flag, names) in grouped.items()]
    keys.append(copies.agg(F.lit("duplicate_observation").alias("code"), F.count(F.lit(1)).alias("__findings")))
    found = reduce(lambda a, b: a.unionByName(b), [k.withColumn("__rows", F.lit(None).cast("long")) for k in keys], releases)
    return totals.filter("rows > 0").join(found, "code", "left").select(
        "code", F.coalesce("__findings", "findings").alias("findings"), F.coalesce("__rows", "rows").alias("rows"), "observations"
    )


def peer_agreement(rows: DataFrame) -> DataFrame:
    """Median distance to other sources of the same natural key, per (natural key, source, value)."""
    return keyed.peer_median_distance(rows, NATURAL, "source_name", "value", ~F.col("is_rate"), stage=stored)


def judge(rows: DataFrame, findings: DataFrame, *, confirmed: bool = False) -> DataFrame:
    """VER-18: the codes of each row and whether it may enter a model, which rests on them alone.

    ``findings`` are rows of ``all_findings`` or the lists of ``code_sets``."""
    codes = _as_sets(findings)
    judged = rows.withColumn("value", F.col("value").cast("double")).join(codes, "observation_id", "left").withColumn(
        "verification_findings", F.coalesce("verification_findings", F.array().cast("array<string>"))
    )
    verified = (F.col("verification_status") == "analyst_verified") & F.lit(confirmed)
    blocking = (F.col("verification_status") == "rejected") | F.arrays_overlap("verification_findings", F.array(*[F.lit(c) for c in BLOCKING_FINDINGS]))
    return judged.withColumn("model_eligible", verified & ~blocking)


def _as_sets(findings: DataFrame) -> DataFrame:
    if "verification_findings" in findings.columns:
        return findings
    return findings.groupBy("observation_id").agg(F.array_sort(F.collect_set("code")).alias("verification_findings"))


def score(rows: DataFrame, findings: DataFrame, *, evaluated_on: str, confirmed: bool = False, agreement: DataFrame | None = None) -> DataFrame:
    """VER-17: ``judge`` and a weighted confidence, to which the agreement with other sources belongs."""
    agreement = peer_agreement(rows) if agreement is None else agreement
    return with_confidence(judge(rows, findings, confirmed=confirmed), agreement, evaluated_on=evaluated_on, confirmed=confirmed)


def with_confidence(judged: DataFrame, agreement: DataFrame, *, evaluated_on: str, confirmed: bool = False) -> DataFrame:
    """The weighted confidence of judged rows."""
    return _confident(keyed.null_safe_join(judged, agreement, [*NATURAL, "source_name", "value"], "left"), evaluated_on, confirmed)


def _confident(scored: DataFrame, evaluated_on: str, confirmed: bool) -> DataFrame:
    age = F.greatest(F.datediff(F.lit(evaluated_on).cast("date"), F.col("retrieved_on")), F.lit(0))
    agree = F.when(F.col("peer_distance").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("peer_distance") / 0.10))
    recency = F.when(age <= 365, 1.0).when(age <= 730, 0.75).when(age <= 1825, 0.5).otherwise(0.25)
    present = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "unknown"), 0.0).otherwise(1.0)
    completeness = (present("release_date") + present("sample_count") + present("notes") + present("redistribution_permitted")) / 4
    verified = (F.col("verification_status") == "analyst_verified") & F.lit(confirmed)
    status = F.when(verified, 1.0).when(F.col("verification_status") == "rejected", 0.0).otherwise(0.45)
    odd = F.arrays_overlap("verification_findings", F.array(F.lit("duplicate_observation"), F.lit("sudden_jump")))
    reliability = F.create_map(*[F.lit(v) for pair in SOURCE_RELIABILITY.items() for v in pair])[F.col("source_class")]
    confidence = (
        reliability * 0.25 + F.lit(0.15) + agree * 0.15 + recency * 0.10 + completeness * 0.10 + status * 0.15 + F.when(odd, 0.0).otherwise(1.0) * 0.10
    )
    return scored.withColumn("confidence", F.round(confidence, 6)).drop("peer_distance")


def summarize(scored: DataFrame, findings: DataFrame, confirmed: bool = False) -> DataFrame:
    """VER-19: one row of counts; finding and row counts meet on a constant key.

    ``findings`` are rows of ``all_findings`` or the counts of ``finding_totals``."""
    counts = scored.agg(
        F.count(F.lit(1)).alias("observations"), F.count_if("model_eligible").alias("model_eligible"),
        F.count_if((F.col("verification_status") == "analyst_verified") & F.lit(confirmed)).alias("verified"),
        F.count_if(F.col("verification_status") == "unverified").alias("unverified"), F.count_if(F.col("verification_status") == "rejected").alias("rejected"),
    ).withColumn("__one", F.lit(1))
    totals = findings if "findings" in findings.columns else findings.groupBy("code").agg(F.countDistinct("finding_id").alias("findings"))
    found = totals.agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.sum(F.when(F.col("code") == "source_conflict", F.col("findings"))), F.lit(0)).alias("conflicts")
    ).withColumn("__one", F.lit(1))
    return counts.join(found, "__one").drop("__one")


def available_as_of(rows: DataFrame, origin: str) -> DataFrame:
    """VER-20: availability date, its basis and whether the row was known at the origin."""
    available = F.coalesce(F.col("release_date"), F.col("retrieved_on"))
    basis = F.when(F.col("release_date").isNotNull(), "release_date").otherwise("retrieved_at_conservative_fallback")
    return rows.withColumns({"available_date": available, "basis": basis, "included": available <= F.lit(origin).cast("date")})


def reconcile(scored: DataFrame, priority: list[str]) -> DataFrame:
    """VER-21: one eligible row per natural key by priority, confidence, recency, id; never averaged."""
    if not priority or len(set(priority)) != len(priority):
        raise ValueError("source priority must be a unique non-empty list")
    rank = F.create_map(*[F.lit(v) for i, s in enumerate(priority) for v in (s, i)])[F.col("source_name")]
    ranked = scored.withColumn("__rank", F.when(F.col("model_eligible"), rank))
    eligible = F.col("__rank").isNotNull()
    order = F.struct("__rank", (-F.col("confidence")).alias("c"), (-F.unix_date("retrieved_on")).alias("r"), "observation_id")
    picked = F.min_by(F.struct("observation_id", "value", "source_name"), F.when(eligible, order))
    return (
        ranked.groupBy(*NATURAL).agg(picked.alias("pick"), F.count(F.lit(1)).alias("__n"), F.count_if(eligible).alias("__eligible"))
        .filter("__eligible > 0")
        .select(*NATURAL, F.col("pick.observation_id").alias("selected_observation_id"), "pick.value", "pick.source_name", (F.col("__n") - 1).alias("alternatives"))
    )


def alternatives(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """VER-21: the rows passed over, long form."""
    joined = keyed.null_safe_join(rows, selected.select(*NATURAL, "selected_observation_id"), NATURAL)
    return joined.filter("observation_id <> selected_observation_id").select("selected_observation_id", "observation_id", "source_name")


def canonicalize(scored: DataFrame) -> DataFrame:
    """VER-22: publishable targets (not rejected, not duplicated) with a quality bucket from confidence."""
    quality = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.65, "moderate").otherwise("low")
    duplicated = F.array_contains("verification_findings", "duplicate_observation")
    return scored.filter((F.col("verification_status") != "rejected") & ~duplicated).select(
        "observation_id", F.col("source_name").alias("source_id"), "geography_type", "geography_id", "property_type", "property_subtype",
        periods.period_start("period").alias("observation_date"), F.col("frequency").alias("period_type"), "metric", "value", "unit",
        F.coalesce("release_date", "retrieved_on").alias("as_of_date"), quality.alias("quality_level"), "methodology",
    )


RENT_SERIES = ["geography_type", "geography_id", "property_type", "property_subtype", "metric", "unit", "methodology", "source_name"]


def derive_rent_growth(rows: DataFrame) -> DataFrame:
    """VER-23: exact four-quarter growth where both quarters hold exactly one row."""
    rents = rows.filter(F.col("metric").isin("asking_rent", "effective_rent") & (F.col("frequency") == "quarterly"))
    rents = rents.withColumn("__idx", periods.quarter_index("period"))
    single = rents.groupBy(*RENT_SERIES, "__idx").agg(
        F.count(F.lit(1)).alias("__n"), F.max("value").cast("double").alias("value"), F.max("observation_id").alias("observation_id"), F.max("period").alias("period"),
    ).filter("__n = 1")
    prior = single.filter("value <> 0").select(*RENT_SERIES, (F.col("__idx") + 4).alias("__idx"), F.col("value").alias("__prior"), F.col("observation_id").alias("prior_id"))
    joined = keyed.null_safe_join(single, prior, [*RENT_SERIES, "__idx"])
    return joined.select(
        *[c for c in RENT_SERIES if c not in ("metric", "unit", "methodology")], "period", F.lit("rent_growth_yoy").alias("metric"),
        (F.col("value") / F.col("__prior") - 1).alias("value"), F.lit("decimal_fraction").alias("unit"),
        F.when(F.col("metric") == "asking_rent", "asking_rent_yoy").otherwise("effective_rent_yoy").alias("methodology"),
        F.concat_ws(":", F.lit("derived"), "prior_id", "observation_id").alias("source_identifier"),
    )


def derive_vacancy(rows: DataFrame) -> DataFrame:
    """VER-24: vacancy as the exact complement of occupancy, methodology mapped."""
    kept = rows.filter((F.col("metric") == "occupancy_rate") & F.col("methodology").isin("physical_occupancy", "economic_occupancy"))
    return kept.withColumns({
        "metric": F.lit("vacancy_rate"), "value": F.lit(1).cast("decimal(28,12)") - F.col("value").cast("decimal(28,12)"),
        "methodology": F.when(F.col("methodology") == "physical_occupancy", "physical_vacancy").otherwise("economic_vacancy"),
        "source_identifier": F.concat(F.lit("derived:"), F.col("observation_id")), "verification_status": F.lit("unverified"),
    })


def derive_noi_margin(rows: DataFrame) -> DataFrame:
    """VER-25: NOI over revenue from one unambiguous same-source pair."""
    keys = ["geography_type", "geography_id", "period", "property_type", "property_subtype", "source_name", "unit"]
    revenue, noi = F.col("metric") == "same_store_revenue", F.col("metric") == "same_store_noi"
    value = F.col("value").cast("double")
    pairs = rows.filter(revenue | noi).groupBy(*keys).agg(
        F.count_if(revenue).alias("r_n"), F.count_if(noi).alias("n_n"), F.max(F.when(revenue, value)).alias("revenue"), F.max(F.when(noi, value)).alias("noi"),
        F.max(F.when(revenue, F.col("observation_id"))).alias("revenue_id"), F.max(F.when(noi, F.col("observation_id"))).alias("noi_id"),
    )
    pairs = pairs.filter("r_n = 1 AND n_n = 1 AND revenue > 0")
    return pairs.select(
        *[k for k in keys if k != "unit"], F.lit("noi_margin").alias("metric"), (F.col("noi") / F.col("revenue")).alias("value"),
        F.lit("same_store_noi_margin").alias("methodology"), F.concat_ws(":", F.lit("derived"), "revenue_id", "noi_id").alias("source_identifier"),
    )


def review_select(rows: DataFrame, findings: DataFrame | None, *, markets=None, metrics=None, first=None, last=None) -> DataFrame:
    """VER-26: the chosen slice, each row flagged when a blocking finding refuses it; ``verified`` rows need no findings."""
    chosen = rows
    if markets:
        chosen = chosen.filter(F.col("geography_id").isin(list(markets)))
    if metrics:
        chosen = chosen.filter(F.col("metric").isin(list(metrics)))
    index = periods.period_index("period", "frequency")
    if first:
        chosen = chosen.filter(index >= periods.period_index(F.lit(first), F.col("frequency")))
    if last:
        chosen = chosen.filter(index <= periods.period_index(F.lit(last), F.col("frequency")))
    if findings is None:
        return chosen.withColumn("refused", F.arrays_overlap("verification_findings", F.array(*[F.lit(c) for c in BLOCKING_FINDINGS])))
    if "verification_findings" in findings.columns:
        refused = findings.filter(F.arrays_overlap("verification_findings", F.array(*[F.lit(c) for c in BLOCKING_FINDINGS])))
    else:
        refused = findings.filter(F.col("code").isin(*BLOCKING_FINDINGS))
    blocked = refused.select("observation_id", F.lit(True).alias("__blocked")).distinct()
    return chosen.join(blocked, "observation_id", "left").withColumn("refused", F.coalesce("__blocked", F.lit(False))).drop("__blocked")


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """VER-27: exclusions by observation, by market-period and by metric-period."""
    excluded = decisions.filter("decision = 'exclude'")
    kept = rows
    for scope, keys in (("observation", ["observation_id"]), ("market_period", ["geography_id", "period"]), ("metric_period", ["metric", "period"])):
        kept = kept.join(excluded.filter(F.col("scope") == scope).select(*keys).distinct(), keys, "left_anti")
    return kept


def warning_table(rows: DataFrame) -> DataFrame:
    """VER-28: previous, current and change for every gap or jump warning."""
    steps = series_steps(rows)
    jump = F.coalesce(F.round("change", 12) > F.col("jump_threshold"), F.lit(False))
    codes = F.filter(F.array(F.when(F.col("gap") > 1, F.lit("missing_periods")), F.when(jump, F.lit("sudden_jump"))), lambda c: c.isNotNull())
    return steps.withColumn("code", F.explode(codes)).select(
        "code", *SERIES, "previous_period", "period", "previous_value", F.col("value").cast("double").alias("current_value"), "change", "observation_id"
    )


def evidence_roots(rows: DataFrame) -> DataFrame:
    """VER-29: follow ``derived:`` identifiers to the source documents behind each row, however long the chain.

    A fragment behind ``#`` is not part of a document's name.  Where a chain names a row that is not there, the
    documents of rows with the same source, geography and period stand in (if these columns are given and
    there are any), else the identifier itself; a chain that closes a circle ends with the identifier that
    closes it.  ``depth`` is the number of rows passed.
    """
    peers_by = [c for c in ("source_name", "geography_id", "period") if c in rows.columns]
    is_derived = F.col("source_identifier").startswith("derived:")
    parent = F.when(is_derived, F.substring("source_identifier", 9, 2**31 - 1))
    named = rows.select("observation_id", "source_identifier", parent.alias("parent"))
    known = rows.select(F.col("observation_id").alias("__known")).distinct()
    cited = named.filter("parent IS NOT NULL").join(known, F.col("parent") == F.col("__known"), "left")
    ends = named.filter("parent IS NULL").withColumn("__known", F.lit(None).cast("string"))  # in the join they would be one key
    links = checkpointed(cited.unionByName(ends).withColumnRenamed("observation_id", "at"))
    front = rows.select(F.col("observation_id").alias("root_id"), F.col("observation_id").alias("at")).distinct().withColumn("depth", F.lit(0))
    passed, ended, lost = None, None, None
    add = lambda whole, part: part if whole is None else whole.unionByName(part)
    while not front.isEmpty():
        here = front.join(links, "at")
        ended = add(ended, here.filter("parent IS NULL").select("root_id", F.regexp_replace("source_identifier", "#.*$", "").alias("source_identifier"), "depth"))
        lost = add(lost, here.filter("parent IS NOT NULL AND __known IS NULL").select("root_id", "source_identifier", "depth"))
        moved = checkpointed(here.filter("__known IS NOT NULL").select("root_id", F.col("parent").alias("at"), "source_identifier", (F.col("depth") + 1).alias("depth")))
        if passed is not None:
            seen = passed.select("root_id", "at")
            ended = add(ended, moved.join(seen, ["root_id", "at"], "left_semi").select("root_id", "source_identifier", (F.col("depth") - 1).alias("depth")))
            moved = moved.join(seen, ["root_id", "at"], "left_anti")
        front = checkpointed(moved.select("root_id", "at", "depth"))
        passed = add(passed, front)
    if lost is None:
        return rows.select(F.col("observation_id").alias("root_id"), "source_identifier", F.lit(0).alias("depth")).limit(0)
    if len(peers_by) == 3:
        documents = rows.filter(~is_derived).select(*[F.col(c).alias(f"__{c}") for c in peers_by], F.regexp_replace("source_identifier", "#.*$", "").alias("__document")).distinct()
        keyed_roots = lost.join(rows.select(F.col("observation_id").alias("root_id"), *peers_by), "root_id")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in peers_by]
        lost = keyed_roots.join(documents, reduce(lambda a, b: a & b, same), "left").select("root_id", F.coalesce("__document", "source_identifier").alias("source_identifier"), "depth")
    return ended.unionByName(lost).groupBy("root_id", "source_identifier").agg(F.min("depth").alias("depth"))
