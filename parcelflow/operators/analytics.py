"""Descriptive analytics over long market observations.

A series is (metric, property_type, geography_type, geography_id).  Positions along a series
are dense and computed per calendar year, so no window spans a whole series of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import keyed, numbers

SERIES = ["metric", "property_type", "geography_type", "geography_id"]
SCOPE = ["property_type", "geography_type", "geography_id"]


def prepare(df: DataFrame) -> DataFrame:
    return df.withColumns({"property_type": F.coalesce("property_type", F.lit("all")), "value": F.col("value").cast("double")})


def positioned(df: DataFrame) -> DataFrame:
    """Rows of each series with their 0-based observed position (date, then value)."""
    return keyed.dense_positions(prepare(df), SERIES, ["observation_date", "value"], F.year("observation_date"))


def with_previous(df: DataFrame) -> DataFrame:
    return keyed.lag_positions(positioned(df), SERIES, "position", {"previous": ("value", 1)})


def benchmark_matrix(df: DataFrame) -> DataFrame:
    """AGG-19: quartiles, first/last and mean change per observed period."""
    rows = prepare(df)
    order = F.struct("observation_date", "value")
    stats = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("count"), F.min("observation_date").alias("start_date"), F.max("observation_date").alias("end_date"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("latest"),
        F.countDistinct("observation_date").alias("periods"),
    )
    quartiles = keyed.grouped_quantiles(rows, SERIES, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    change = (F.col("latest") - F.col("first")) / F.greatest(F.col("periods") - 1, F.lit(1))
    return stats.join(quartiles, SERIES).withColumn("mean_change_per_period", change).drop("first", "periods")


def change_factors(df: DataFrame, lags: tuple[int, ...] = (4, 12)) -> DataFrame:
    """WIN-06: period, percent and n-observed-period changes, long form."""
    wanted = {"previous": ("value", 1), **{f"__l{n}": ("value", n) for n in lags}}
    rows = keyed.lag_positions(positioned(df), SERIES, "position", wanted)
    relative = lambda c: numbers.ratio(F.col("value"), F.col(c)) - 1
    entries = [("period_change", F.col("value") - F.col("previous")), ("period_percent_change", relative("previous"))]
    entries += [(f"change_{n}_observed_periods", relative(f"__l{n}")) for n in lags]
    factors = F.array(*[F.struct(F.lit(name).alias("factor"), value.alias("change")) for name, value in entries])
    return rows.select(
        *SERIES, F.col("observation_date").alias("period"), (F.col("position") + 1).alias("samples_to_date"), F.inline(factors)
    ).filter("change IS NOT NULL")


def time_series_diagnostics(df: DataFrame) -> DataFrame:
    """WIN-07: trend, change volatility, drawdown from the running peak, latest z-score."""
    rows = keyed.running_max(with_previous(df), SERIES, "position", "value", "peak")
    rows = rows.withColumns({
        "change": F.col("value") - F.col("previous"),
        "drawdown": F.coalesce(numbers.ratio(F.col("value") - F.col("peak"), F.abs("peak")), F.lit(0.0)),
    })
    latest = F.max_by("value", "position")
    stats = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("periods"), F.min("observation_date").alias("start_date"), F.max("observation_date").alias("end_date"), latest.alias("latest"),
        F.regr_slope("value", F.col("position").cast("double")).alias("slope"), F.avg("change").alias("mean_change"), F.stddev_samp("change").alias("volatility"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("maximum_drawdown"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"),
    )
    spread = F.when(F.coalesce("deviation", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("deviation"))
    z = F.when(F.col("periods") > 1, (F.col("latest") - F.col("mean")) / spread).otherwise(0.0)
    return stats.withColumns({
        "slope": F.coalesce("slope", F.lit(0.0)), "mean_change": F.coalesce("mean_change", F.lit(0.0)), "volatility": F.coalesce("volatility", F.lit(0.0)),
        "latest_z_score": z, "latest_is_outlier": F.abs(z) >= 3,
    }).drop("mean", "deviation")


def stress_bands(df: DataFrame) -> DataFrame:
    """WIN-08: empirical p10/p50/p90 of observed changes for series of three or more points."""
    rows = with_previous(df).withColumn("change", F.col("value") - F.col("previous")).filter("change IS NOT NULL")
    ends = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("changes"), F.min("change").alias("worst"), F.max("change").alias("best")).filter("changes >= 2")
    bands = keyed.grouped_quantiles(rows, SERIES, "change", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return ends.join(bands, SERIES)


def metric_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One value per metric and key; a repeated metric keeps its largest (value) row."""
    return prepare(df).groupBy(*keys, "metric").agg(F.max("value").alias("value"))


def correlation_pairs(df: DataFrame) -> DataFrame:
    """ASM-01, JN-20: metric pairs on exact date, geography and type; no variance gives 0.0."""
    keys = ["observation_date", *SCOPE]
    rows = metric_by_key(df, keys)
    left = rows.select(*keys, F.col("metric").alias("left_metric"), F.col("value").alias("x"))
    right = rows.select(*keys, F.col("metric").alias("right_metric"), F.col("value").alias("y"))
    pairs = left.join(right, keys).filter("left_metric < right_metric")
    return pairs.groupBy("left_metric", "right_metric").agg(
        F.count(F.lit(1)).alias("pairs"), numbers.safe_corr("x", "y", 0.0).alias("correlation")
    ).filter("pairs >= 3")


def lead_lag(df: DataFrame, maximum: int = 4) -> DataFrame:
    """WIN-09: strongest absolute correlation over observed-period lags; ties go to the larger lag.

    Positions count the distinct dates of a scope.  The lagged side is exploded over the
    2*maximum+1 lags and met by an equi-join on (scope, position).
    """
    rows = metric_by_key(df, ["observation_date", *SCOPE])
    dates = rows.select(*SCOPE, "observation_date").distinct()
    placed = keyed.dense_positions(dates, SCOPE, ["observation_date"], F.year("observation_date"))
    rows = rows.join(placed, [*SCOPE, "observation_date"])
    left = rows.select(*SCOPE, "position", F.col("metric").alias("leading_metric"), F.col("value").alias("x"))
    right = rows.select(*SCOPE, F.col("position").alias("other"), F.col("metric").alias("lagging_metric"), F.col("value").alias("y"))
    right = right.withColumn("lag", F.explode(F.sequence(F.lit(-maximum), F.lit(maximum)))).withColumn("position", F.col("other") - F.col("lag"))
    pairs = left.join(right, [*SCOPE, "position"]).filter("leading_metric < lagging_metric")
    per = pairs.groupBy(*SCOPE, "leading_metric", "lagging_metric", "lag").agg(
        F.count(F.lit(1)).alias("pairs"), numbers.safe_corr("x", "y", 0.0).alias("correlation")
    ).filter("pairs >= 4")
    best = F.max_by(F.struct("lag", "correlation", "pairs"), F.struct(F.round(F.abs("correlation"), 12), "lag"))
    return per.groupBy(*SCOPE, "leading_metric", "lagging_metric").agg(best.alias("b")).select(
        *SCOPE, "leading_metric", "lagging_metric", F.col("b.lag").alias("strongest_lag"), "b.correlation", "b.pairs"
    )


def cadence(df: DataFrame) -> DataFrame:
    """WIN-10: calendar gaps of each series: lower-median typical gap and gaps above 1.75 times it."""
    dates = prepare(df).select(*SERIES, "observation_date").distinct()
    placed = keyed.dense_positions(dates, SERIES, ["observation_date"], F.year("observation_date"))
    gaps = keyed.lag_positions(placed, SERIES, "position", {"before": ("observation_date", 1)}).filter("before IS NOT NULL")
    gaps = gaps.withColumn("days", F.datediff("observation_date", "before").cast("long"))
    counts = gaps.groupBy(*SERIES, "days").agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct gap length, so the window is bounded by the calendar span in days.
    window = Window.partitionBy(*SERIES).orderBy("days")
    running = counts.withColumn("upto", F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.groupBy(*SERIES).agg(F.sum("n").alias("gaps"), F.min("days").alias("minimum_gap"), F.max("days").alias("maximum_gap"), F.count(F.lit(1)).alias("lengths"))
    joined = running.join(total, SERIES)
    middle = F.floor((F.col("gaps") - 1) / 2)
    typical = joined.filter(F.col("upto") > middle).groupBy(*SERIES).agg(F.min("days").alias("typical_gap"))
    large = counts.join(typical, SERIES).groupBy(*SERIES).agg(
        F.coalesce(F.sum(F.when((F.col("typical_gap") > 0) & (F.col("days") > F.col("typical_gap") * 1.75), F.col("n"))), F.lit(0)).alias("large_gaps")
    )
    return total.filter("gaps >= 2").join(typical, SERIES).join(large, SERIES).select(
        *SERIES, (F.col("gaps") + 1).alias("periods"), "typical_gap", "minimum_gap", "maximum_gap", (F.col("lengths") > 1).alias("irregular"), "large_gaps"
    )


def large_gaps(df: DataFrame) -> DataFrame:
    """WIN-10: the flagged gaps themselves."""
    dates = prepare(df).select(*SERIES, "observation_date").distinct()
    placed = keyed.dense_positions(dates, SERIES, ["observation_date"], F.year("observation_date"))
    gaps = keyed.lag_positions(placed, SERIES, "position", {"after": ("observation_date", 1)}).filter("after IS NOT NULL")
    typical = cadence(df).select(*SERIES, "typical_gap")
    gaps = gaps.withColumn("days", F.datediff("observation_date", "after").cast("long")).join(typical, SERIES)
    return gaps.filter((F.col("typical_gap") > 0) & (F.col("days") > F.col("typical_gap") * 1.75)).select(
        *SERIES, "after", F.col("observation_date").alias("before"), "days"
    )


SCORE_FIELDS = ("latest", "momentum", "mean_change", "volatility", "downside_deviation")


def factor_scorecards(df: DataFrame) -> DataFrame:
    """WIN-11: unitless statistics ranked within (metric, property type, geography type).

    Percentile is position/(n-1) with ties by geography id.  Ranks come from dense positions
    over value pieces, so a bucket holding most geographies is still split.
    """
    rows = with_previous(df).withColumn("change", F.col("value") - F.col("previous"))
    stats = rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("periods"), F.max("observation_date").alias("end_date"), F.max_by("value", "position").alias("latest"),
        (F.max_by("value", "position") - F.min_by("value", "position")).alias("momentum"), F.avg("change").alias("mean_change"),
        F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("volatility"),
        F.sqrt(F.avg(F.when(F.col("change").isNotNull(), F.pow(F.least("change", F.lit(0.0)), F.lit(2))))).alias("downside_deviation"),
    ).filter("periods >= 3")
    bucket = ["metric", "property_type", "geography_type"]
    sizes = stats.groupBy(*bucket).agg(F.count(F.lit(1)).alias("peers"))
    long = stats.unpivot(SERIES, list(SCORE_FIELDS), "field", "score").withColumn("score", F.round("score", 12))
    key = [*bucket, "field"]
    split = keyed.value_chunks(long, key, "score", 16)
    ranked = keyed.dense_positions(split, key, ["score", "geography_id"], F.col("__piece")).drop("__piece")
    wide = ranked.groupBy(*SERIES).agg(*[F.max(F.when(F.col("field") == f, F.col("position"))).alias(f"__{f}") for f in SCORE_FIELDS])
    out = stats.join(wide, SERIES).join(sizes, bucket)
    for f in SCORE_FIELDS:
        out = out.withColumn(f"{f}_percentile", F.round(F.col(f"__{f}") / F.greatest(F.col("peers") - 1, F.lit(1)), 6)).drop(f"__{f}")
    return out


def regimes(df: DataFrame) -> DataFrame:
    """WIN-12: per period regime from rent growth and the change of vacancy since the last joint period."""
    rows = metric_by_key(df.filter(F.col("metric").isin("rent_growth_12m", "vacancy_rate")), ["observation_date", *SCOPE])
    both = rows.groupBy(*SCOPE, "observation_date").agg(
        F.max(F.when(F.col("metric") == "rent_growth_12m", F.col("value"))).alias("growth"), F.max(F.when(F.col("metric") == "vacancy_rate", F.col("value"))).alias("vacancy"),
    ).filter("growth IS NOT NULL AND vacancy IS NOT NULL")
    placed = keyed.dense_positions(both, SCOPE, ["observation_date"], F.year("observation_date"))
    placed = keyed.lag_positions(placed, SCOPE, "position", {"before": ("vacancy", 1), "growth_before": ("growth", 1), "before2": ("vacancy", 2)})
    change = F.col("vacancy") - F.col("before")
    return placed.withColumns({
        "vacancy_change": change, "regime": _regime(F.col("growth"), change),
        "previous_regime": F.when(F.col("before").isNotNull(), _regime(F.col("growth_before"), F.col("before") - F.col("before2"))),
    }).drop("before", "growth_before", "before2", "position")


def _regime(growth, change):
    return (
        F.when(change.isNull(), "initial").when((growth > 0) & (change <= 0), "favorable").when((growth < 0) & (change > 0), "adverse").otherwise("mixed")
    )


def regime_transitions(df: DataFrame) -> DataFrame:
    """WIN-12: transition counts per scope."""
    rows = regimes(df).filter("previous_regime IS NOT NULL")
    return rows.groupBy(*SCOPE, F.concat_ws("->", "previous_regime", "regime").alias("transition")).agg(F.count(F.lit(1)).alias("count"))


def baseline_backtest(df: DataFrame, minimum: int = 3) -> DataFrame:
    """WIN-13: persistence and mean-change forecasts without look-ahead.

    The mean of past changes telescopes to (last - first) / (n - 1), so one lag and the first
    value of the series give every expanding forecast.
    """
    rows = with_previous(df)
    first = rows.groupBy(*SERIES).agg(F.min_by("value", "position").alias("first"))
    rows = rows.join(first, SERIES).filter(F.col("position") >= minimum)
    drift = (F.col("previous") - F.col("first")) / (F.col("position") - 1)
    forecasts = F.array(
        F.struct(F.lit("persistence").alias("baseline"), F.col("previous").alias("forecast")),
        F.struct(F.lit("mean_change").alias("baseline"), (F.col("previous") + drift).alias("forecast")),
    )
    judged = rows.select(*SERIES, "observation_date", "value", "previous", F.inline(forecasts))
    error = F.col("value") - F.col("forecast")
    hit = (F.col("forecast") - F.col("previous")) * (F.col("value") - F.col("previous")) > 0
    return judged.groupBy(*SERIES, "baseline").agg(
        F.count(F.lit(1)).alias("tests"), F.min("observation_date").alias("test_start"), F.max("observation_date").alias("test_end"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), F.avg(hit.cast("double")).alias("directional_accuracy"),
    )


LOGICAL_KEY = ["metric", "observation_date", "geography_type", "geography_id", "property_type", "property_subtype"]


def revision_conflicts(df: DataFrame) -> DataFrame:
    """AGG-22: logical keys reported by two or more snapshots, with their spread."""
    value = F.col("value").cast("double")
    grouped = df.groupBy(*LOGICAL_KEY).agg(
        F.countDistinct("snapshot_id").alias("snapshots"), F.countDistinct("source_label").alias("sources"), F.countDistinct(value).alias("distinct_values"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    ).filter("snapshots >= 2")
    spread = F.col("maximum") - F.col("minimum")
    return grouped.withColumns({
        "absolute_spread": spread, "relative_spread": numbers.ratio(spread, F.abs("minimum")), "conflict": F.col("distinct_values") > 1,
    })


def profile_metrics(df: DataFrame, as_of: str) -> DataFrame:
    """AGG-20: per metric profile."""
    value = F.col("value").cast("double")
    return df.groupBy("metric").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("observation_date").alias("periods"), F.min("observation_date").alias("start_date"),
        F.max("observation_date").alias("end_date"), F.countDistinct("geography_type", "geography_id").alias("geographies"),
        F.countDistinct("source_label").alias("sources"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    ).withColumn("stale", F.datediff(F.lit(as_of).cast("date"), "end_date") > 730)


def assumption_coverage(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """AGG-20: which catalogued assumptions have observations."""
    counts = df.groupBy("metric").agg(F.count(F.lit(1)).alias("observations"))
    joined = catalog.join(counts, "metric", "left")
    return joined.select("assumption", "metric", F.col("observations").isNotNull().alias("available"), F.coalesce("observations", F.lit(0)).alias("observations"))


def source_scorecards(df: DataFrame, snapshots: DataFrame) -> DataFrame:
    """AGG-21: per snapshot counts; a snapshot without observations keeps zeros."""
    counts = df.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("metric").alias("metrics"), F.countDistinct("geography_type", "geography_id").alias("geographies"),
        F.countDistinct("property_type").alias("property_types"), F.count_if(F.col("quality_level") == "high").alias("high_quality"),
        F.count_if(F.col("invalid")).alias("invalid_observations"),
    )
    zeros = {c: 0 for c in counts.columns if c != "snapshot_id"}
    return snapshots.join(counts, "snapshot_id", "left").fillna(zeros)
