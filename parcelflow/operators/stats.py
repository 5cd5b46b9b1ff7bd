"""Panel regression from distributed sufficient statistics.

Rows are reduced to moment sums by Spark; only k x k systems are solved, one small matrix
per model, origin or held-out entity, inside tasks.  All operators accept ``group`` keys, so
many models are fitted in one job.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import hashing, keyed, numbers, periods
from parcelflow.operators.validate import errors
from parcelflow.session import checkpointed

PIVOT_TOLERANCE = 1e-12
MOST_SOURCES = 1000


def prepare_panel(df: DataFrame, target: str, features: list[str], *, entity="market_id", period="period", property_type: str | None = None) -> DataFrame:
    """TGT-05: complete cases as doubles, with entity, label and calendar index."""
    if not features or target in features:
        raise ValueError("at least one feature is required and the target cannot be one of them")
    if property_type is not None:
        df = df.filter(F.lower(F.trim("property_type")) == property_type.lower())
    for name in (target, *features):
        df = df.withColumn(name, F.col(name).cast("string").try_cast("double") if dict(df.dtypes)[name] == "string" else F.col(name).cast("double"))
    complete = reduce(lambda a, b: a & b, [numbers.finite(F.col(c)) for c in (target, *features)])
    frequency = F.when(F.length(period) == 4, "annual").when(F.substring(period, 5, 2) == "-Q", "quarterly").otherwise("monthly")
    return df.filter(complete).withColumns({"entity": F.trim(F.col(entity).cast("string")), "label": F.col(period), "idx": periods.period_index(period, frequency)})


def panel_findings(df: DataFrame, *, entity="market_id", period="period") -> DataFrame:
    """TGT-05: duplicate keys and mixed property types as counts, to gate a fit."""
    keys = df.groupBy(entity, period).agg(F.count(F.lit(1)).alias("n"), F.min("property_type").alias("lo"), F.max("property_type").alias("hi"))
    return keys.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count(F.lit(1)).alias("keys"), (F.min("lo") != F.max("hi")).alias("mixed_property_types"),
    )


def panel_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """TGT-05: order-free content hash of the prepared rows."""
    return hashing.dataset_hash(df.select(*columns))


def _products(columns: list[Column]) -> Column:
    return F.array(*[F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]])


def _square(flat, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = flat
    return out + np.triu(out, 1).T


def _solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Solve, or None when the system is singular at the absolute pivot tolerance."""
    if not np.all(np.isfinite(gram)) or np.min(np.abs(np.linalg.svd(gram, compute_uv=False))) < PIVOT_TOLERANCE:
        return None
    return np.linalg.solve(gram, right)


def _solver(k: int):
    def run(batches):
        for batch in batches:
            beta = [_solve(_square(g, k), np.asarray(r, dtype=float)) for g, r in zip(batch["gram"], batch["right"])]
            yield batch.drop(columns=["gram", "right"]).assign(beta=[None if b is None else b.tolist() for b in beta])

    return run


def solve(df: DataFrame, k: int) -> DataFrame:
    """Add ``beta`` from columns ``gram`` (upper triangle) and ``right``; other columns are kept."""
    kept = [c for c in df.columns if c not in ("gram", "right")]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", beta array<double>"
    return df.mapInPandas(_solver(k), schema)


def _dot(beta: str, columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.element_at(beta, i + 1) * c for i, c in enumerate(columns)])


def fit_ols(
    df: DataFrame, target: str, features: list[str], *, group: list[str] | None = None, entity_effects: bool = False, time_effects: bool = False,
    covariance: str = "hc1",
) -> DataFrame:
    """REG-01/02: one row per (group, term) with coefficient, standard error, p-value and fit diagnostics.

    Entity effects use within-demeaning; the parameter count includes the dummies, so standard
    errors equal those of the dummy-variable model.  Time effects become one explicit dummy per
    period after the first; the period labels are bounded by the calendar.
    """
    if covariance not in ("classical", "hc1", "cluster_entity"):
        raise ValueError("covariance must be classical, hc1 or cluster_entity")
    if time_effects:
        labels = sorted(r[0] for r in df.select("label").distinct().collect())[1:]
        df = df.withColumns({f"time[{t}]": (F.col("label") == t).cast("double") for t in labels})
        features = [*features, *[f"time[{t}]" for t in labels]]
    rows = df if group else df.withColumn("__model", F.lit(1))
    group = list(group or ["__model"])
    p = len(features)
    centre = [*group, "entity"] if entity_effects else group
    means = [F.avg(c).alias(f"__m_{c}") for c in (target, *features)]
    overall = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), *[F.avg(c).alias(f"__o_{c}") for c in (target, *features)]
    )
    rows = keyed.null_safe_join(keyed.with_group_stats(rows, centre, *means), overall, group)
    x = [F.col(c) - F.col(f"__m_{c}") for c in features]
    y = F.col(target) - F.col(f"__m_{target}")
    names = [f"__x{i}" for i in range(p)]
    rows = rows.select(
        *group, "entity", "n", "entities", target, F.col(f"__o_{target}").alias("__oy"), *[F.col(f"__o_{c}") for c in features],
        y.alias("__y"), *[c.alias(n) for c, n in zip(x, names)],
    )
    xs = [F.col(n) for n in names]
    solved = solve(rows.groupBy(*group).agg(_products(xs).alias("gram"), F.array(*[F.sum(c * F.col("__y")) for c in xs]).alias("right")), p)
    fitted = keyed.null_safe_join(rows, solved, group).withColumn("__e", F.col("__y") - _dot("beta", xs))
    if covariance == "cluster_entity":
        scores = fitted.groupBy(*group, "entity").agg(*[F.sum(c * F.col("__e")).alias(f"__s{i}") for i, c in enumerate(xs)], F.sum("__e").alias("__s"))
        design = [*[F.col(f"__s{i}") for i in range(p)], F.col("__s")]
        meat = scores.groupBy(*group).agg(_products(design).alias("meat"))
    else:
        design = [*xs, F.lit(1.0)]
        meat = fitted.groupBy(*group).agg(_products([c * F.col("__e") for c in design]).alias("meat"))
    error = F.col("__e")
    stats = fitted.groupBy(*group).agg(
        F.first("n").alias("n"), F.first("entities").alias("entities"), F.first("beta").alias("beta"), _products(xs).alias("gram"),
        F.array(F.first("__oy"), *[F.first(f"__o_{c}") for c in features]).alias("centre"), F.sum(error * error).alias("sse"),
        F.sum(F.pow(F.col(target) - F.col("__oy"), 2)).alias("sst"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
    )
    joined = keyed.null_safe_join(stats, meat, group)
    types = dict(joined.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in group) + (
        ", term string, coefficient double, standard_error double, p_value double, n long, parameters long, r_squared double, adjusted_r_squared double,"
        " mae double, rmse double, bias double"
    )
    return joined.mapInPandas(_inference(group, list(features), entity_effects, covariance), schema).drop("__model")


def _inference(group, features, entity_effects, covariance):
    p = len(features)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["beta"] is None:
                    continue
                n, entities = int(row["n"]), int(row["entities"])
                k = p + (entities if entity_effects else 1)
                if n <= k:
                    continue
                bread = np.linalg.inv(_square(row["gram"], p))
                full = np.zeros((p + 1, p + 1))
                full[:p, :p] = bread
                full[p, p] = 1.0 / n
                if covariance == "classical":
                    cov = full * row["sse"] / (n - k)
                else:
                    meat = _square(row["meat"], p + 1)
                    scale = n / (n - k) if covariance == "hc1" else entities / (entities - 1) * (n - 1) / (n - k)
                    cov = full @ meat @ full * scale
                beta, centre = np.asarray(row["beta"]), np.asarray(row["centre"])
                pick = np.append(-centre[1:], 1.0)
                terms = [(f, beta[i], cov[i, i]) for i, f in enumerate(features)]
                if not entity_effects:
                    terms.append(("intercept", centre[0] - centre[1:] @ beta, pick @ cov @ pick))
                r2 = None if row["sst"] == 0 else 1 - row["sse"] / row["sst"]
                for name, value, variance in terms:
                    se = math.sqrt(max(0.0, variance))
                    out.append({
                        **{g: row[g] for g in group}, "term": name, "coefficient": value, "standard_error": se,
                        "p_value": math.erfc(abs(value / se) / math.sqrt(2)) if se > 0 else 0.0, "n": n, "parameters": k, "r_squared": r2,
                        "adjusted_r_squared": None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k), "mae": row["mae"], "rmse": row["rmse"], "bias": row["bias"],
                    })
            columns = [*group, "term", "coefficient", "standard_error", "p_value", "n", "parameters", "r_squared", "adjusted_r_squared", "mae", "rmse", "bias"]
            yield pd.DataFrame(out, columns=columns)

    return run


def predict(df: DataFrame, coefficients: DataFrame, features: list[str], group: list[str], effects: DataFrame | None = None) -> DataFrame:
    """REG-04: coefficient table (group, term, coefficient) applied to rows, with optional entity effects."""
    wide = coefficients.groupBy(*group).agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"__b_{t}") for t in [*features, "intercept"]])
    rows = keyed.null_safe_join(df, wide, group)
    if effects is not None:
        rows = rows.join(effects.select(*group, "entity", F.col("effect").alias("__effect")), [*group, "entity"], "left")
    else:
        rows = rows.withColumn("__effect", F.coalesce("__b_intercept", F.lit(0.0)))
    value = reduce(lambda a, b: a + b, [F.col(f) * F.col(f"__b_{f}") for f in features]) + F.col("__effect")
    return rows.withColumn("prediction", value).drop("__effect", *[f"__b_{t}" for t in [*features, "intercept"]])


def entity_effects(df: DataFrame, coefficients: DataFrame, target: str, features: list[str], group: list[str]) -> DataFrame:
    """REG-04: effect of each entity: mean target less mean features times slopes."""
    wide = coefficients.groupBy(*group).agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"__b_{t}") for t in features])
    means = df.groupBy(*group, "entity").agg(F.avg(target).alias("__y"), *[F.avg(f).alias(f"__m_{f}") for f in features])
    joined = keyed.null_safe_join(means, wide, group)
    value = F.col("__y") - reduce(lambda a, b: a + b, [F.col(f"__m_{f}") * F.col(f"__b_{f}") for f in features])
    return joined.select(*group, "entity", value.alias("effect"))


def diagnostics(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """REG-05: Pearson matrix (long form) and variance inflation from one moments aggregate."""
    columns = [*features, target]
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[numbers.safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    vif_of = {(f, f): i for i, f in enumerate(features)}
    k = len(features)
    matrix = F.array(*[F.col(f"c{pairs.index((a, b))}") for a in features for b in features])
    inverted = row.withColumn("matrix", matrix).mapInPandas(_vif(k), ", ".join(f"{c} {t}" for c, t in row.dtypes) + ", vif array<double>")
    entries = [
        F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"), F.when(F.col("n") >= 3, F.col(f"c{i}")).alias("correlation"),
                 (F.element_at("vif", vif_of[a, b] + 1) if (a, b) in vif_of else F.lit(None).cast("double")).alias("vif"))
        for i, (a, b) in enumerate(pairs)
    ]
    return inverted.select(F.col("n").alias("sample_size"), F.inline(F.array(*entries)))


def _vif(k):
    def run(batches):
        for batch in batches:
            out = []
            for flat in batch["matrix"]:
                m = np.asarray(flat, dtype=float).reshape(k, k)
                if k == 1:
                    out.append([1.0])
                elif np.isnan(m).any() or np.min(np.abs(np.linalg.svd(m, compute_uv=False))) < 1e-10:
                    out.append([None] * k)
                else:
                    out.append(np.diag(np.linalg.inv(m)).tolist())
            yield batch.drop(columns=["matrix"]).assign(vif=out)

    return run


def prediction_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """REG-06."""
    error = F.col("actual") - F.col("prediction")
    hit = (F.col("prediction") - F.col("prior_actual")) * (F.col("actual") - F.col("prior_actual")) > 0
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"),
        F.avg(hit.cast("double")).alias("directional_accuracy"),
    )


def origin_states(df: DataFrame, target: str, features: list[str], *, group: list[str], minimum_training: int, frequency: str, enforce_features: bool = False) -> DataFrame:
    """REG-07: for each (group, entity, origin) the moments and history known at that origin.

    A row enters training at the first origin that is later than its period and not earlier
    than its availability.  The window runs over one entity's own periods and origins, which
    the unique (entity, period) key bounds by the calendar.
    """
    available = F.col("target_available_at") if "target_available_at" in df.columns else F.lit(None).cast("date")
    if enforce_features:
        available = F.greatest(available, *[F.col(f"{f}__available_at") for f in features])
    months = {"annual": 12, "quarterly": 3, "monthly": 1}[frequency]
    start_idx = periods.date_index(available, frequency)
    unit = {"annual": "year", "quarterly": "quarter", "monthly": "month"}[frequency]
    first_open = F.when(available.isNull(), F.lit(-(10**6))).otherwise(start_idx + F.when(F.to_date(F.date_trunc(unit, available)) < available, 1).otherwise(0))
    entry = F.greatest(F.col("idx") + 1, first_open)
    origins = df.groupBy(*group).agg(F.array_sort(F.collect_set("idx")).alias("o")).select(*group, F.slice("o", minimum_training + 1, F.greatest(F.size("o"), F.lit(1))).alias("origins"))
    keys = [*group, "entity"]
    moment_names = ["__n", "__sy", *[f"__sx{i}" for i in range(len(features))]]
    values = [F.lit(1.0), F.col(target), *[F.col(f) for f in features]]
    pairs = [(f"__xx{i}_{j}", F.col(a) * F.col(b)) for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    pairs += [(f"__xy{i}", F.col(a) * F.col(target)) for i, a in enumerate(features)]
    columns = dict(zip(moment_names, values)) | dict(pairs)
    training = df.select(*keys, entry.alias("at"), F.lit(0).alias("kind"), *[c.alias(n) for n, c in columns.items()], F.struct(F.col("idx").alias("idx"), F.col(target).alias("y")).alias("point"))
    entities = keyed.null_safe_join(df.select(*keys).distinct(), origins, group)
    marks = entities.select(*keys, F.explode("origins").alias("at")).select(
        *keys, "at", F.lit(1).alias("kind"), *[F.lit(0.0).alias(n) for n in columns], F.lit(None).cast(training.schema["point"].dataType).alias("point")
    )
    window = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = training.unionByName(marks)
    states = merged.withColumns({**{n: F.sum(n).over(window) for n in columns}, "history": F.collect_list("point").over(window)})
    return states.filter("kind = 1 AND __n > 0").withColumn("history", F.array_sort("history")).withColumnRenamed("at", "origin").drop("kind", "point")


def walk_forward(
    df: DataFrame, target: str, features: list[str], *, group: list[str] | None = None, minimum_training: int = 4, frequency: str = "quarterly",
    enforce_features: bool = False, entity_effects: bool = True,
) -> DataFrame:
    """REG-07/08: model and six baseline predictions for every test row of every origin, long form."""
    # Both are read by every branch below.  A model column that is stored is no constant, so joins on it stay joins on keys.
    rows = checkpointed(df if group else df.withColumn("__model", F.lit(1)))
    group = list(group or ["__model"])
    p = len(features)
    states = checkpointed(origin_states(rows, target, features, group=group, minimum_training=minimum_training, frequency=frequency, enforce_features=enforce_features))
    at = [*group, "origin"]
    within = lambda total, a, b: total - (a * b / F.col("__n") if entity_effects else F.lit(0.0))
    sx = [F.col(f"__sx{i}") for i in range(p)]
    if entity_effects:
        gram = F.array(*[F.sum(within(F.col(f"__xx{i}_{j}"), sx[i], sx[j])) for i in range(p) for j in range(i, p)])
        right = F.array(*[F.sum(within(F.col(f"__xy{i}"), sx[i], F.col("__sy"))) for i in range(p)])
        k = p
    else:
        total_n, total_y = F.sum("__n"), F.sum("__sy")
        sums = [F.sum(s) for s in sx]
        gram = F.array(*[F.sum(f"__xx{i}_{j}") - sums[i] * sums[j] / total_n for i in range(p) for j in range(i, p)])
        right = F.array(*[F.sum(f"__xy{i}") - sums[i] * total_y / total_n for i in range(p)])
        k = p
    pair = _ar_pairs(F.col("history"))
    per_origin = states.groupBy(*at).agg(
        gram.alias("gram"), right.alias("right"), F.sum("__n").alias("train_n"), F.sum("__sy").alias("train_sy"), F.array(*[F.sum(s) for s in sx]).alias("train_sx"),
        *[F.sum(pair[n]).alias(f"ar_{n}") for n in ("n", "x", "y", "xx", "xy")],
    )
    solved = checkpointed(solve(per_origin, k))
    medians = _origin_medians(rows, states, target, group)
    peers = _peer_medians(states, at)
    state = states.select(*at, "entity", "__n", "__sy", *[f"__sx{i}" for i in range(p)], "history")
    tests = rows.withColumn("origin", F.col("idx"))
    if enforce_features:
        start = periods.period_start("label")
        tests = tests.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{f}__available_at") <= start, F.lit(False)) for f in features]))
    joined = keyed.null_safe_join(tests.select(*at, "entity", "label", F.col(target).alias("actual"), *features), state, [*at, "entity"])
    joined = keyed.null_safe_join(joined, solved, at)
    joined = keyed.null_safe_join(joined, medians, at)
    joined = keyed.null_safe_join(joined, peers, [*at, "entity"], "left")
    last = F.element_at("history", -1)["y"]
    recent = F.slice("history", F.greatest(F.size("history") - (11 if frequency == "quarterly" else 2), F.lit(1)), 12 if frequency == "quarterly" else 3)
    mean_of = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, h: acc + h["y"]) / F.size(arr)
    base_y = F.col("__sy") / F.col("__n") if entity_effects else F.col("train_sy") / F.col("train_n")
    base_x = [F.col(f"__sx{i}") / F.col("__n") if entity_effects else F.element_at("train_sx", i + 1) / F.col("train_n") for i in range(p)]
    model = base_y + _dot("beta", [F.col(f) - b for f, b in zip(features, base_x)])
    spread = F.col("ar_xx") - F.col("ar_x") * F.col("ar_x") / F.col("ar_n")
    slope = F.coalesce(F.try_divide(F.col("ar_xy") - F.col("ar_x") * F.col("ar_y") / F.col("ar_n"), F.when(F.abs(spread) > 1e-15, spread)), F.lit(0.0))
    pooled = F.when(F.col("ar_n") >= 3, F.col("ar_y") / F.col("ar_n") + slope * (last - F.col("ar_x") / F.col("ar_n"))).otherwise(last)
    forecasts = [
        ("model", model), ("last_observation", last), ("entity_mean", F.col("__sy") / F.col("__n")), ("historical_median", F.col("history_median")),
        ("recent_3_year_mean", mean_of(recent)), ("peer_market_median", F.coalesce("peer_median", "history_median")), ("simple_autoregressive", pooled),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("method"), v.alias("prediction")) for n, v in forecasts])
    return joined.select(*group, "entity", "label", "actual", last.alias("prior_actual"), F.inline(entries)).drop("__model")


def _ar_pairs(history: Column) -> dict[str, Column]:
    """Sums over consecutive history pairs (x = earlier value, y = later value)."""
    left = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
    right = F.slice(history, F.lit(2), F.greatest(F.size(history) - 1, F.lit(0)))
    total = lambda f: F.aggregate(F.zip_with(left, right, f), F.lit(0.0), lambda acc, v: acc + v)
    return {
        "n": F.greatest(F.size(history) - 1, F.lit(0)).cast("double"), "x": total(lambda a, b: a["y"]), "y": total(lambda a, b: b["y"]),
        "xx": total(lambda a, b: a["y"] * a["y"]), "xy": total(lambda a, b: a["y"] * b["y"]),
    }


def _origin_medians(rows: DataFrame, states: DataFrame, target: str, group: list[str]) -> DataFrame:
    at = [*group, "origin"]
    points = states.select(*at, F.explode("history").alias("h")).select(*at, F.col("h.y").alias("y"))
    return keyed.grouped_quantiles(points, at, "y", {"history_median": 0.5})


def _peer_medians(states: DataFrame, at: list[str]) -> DataFrame:
    """Median of the other entities' latest values: own rank tells which middle ranks to read."""
    latest = states.select(*at, "entity", F.element_at("history", -1)["y"].alias("v"))
    placed = keyed.dense_positions(keyed.value_chunks(latest, at, "v", 16), at, ["v", "entity"], F.col("__piece"), "rank").drop("__piece")
    sizes = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    asked = keyed.null_safe_join(placed, sizes, at)
    for name, rank in (("low", F.floor((F.col("size") - 2) / 2)), ("high", F.floor((F.col("size") - 1) / 2))):
        wanted = (rank + F.when(rank >= F.col("rank"), 1).otherwise(0)).cast("long")
        lookup = placed.select(*at, F.col("rank").alias("__want"), F.col("v").alias(f"__{name}"))
        asked = keyed.null_safe_join(asked.withColumn("__want", wanted), lookup, [*at, "__want"]).drop("__want")
    return asked.select(*at, "entity", ((F.col("__low") + F.col("__high")) / 2).alias("peer_median"))


def market_holdout(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """REG-09: each entity predicted by a fit on all others: total moments minus the entity's own."""
    p = len(features)
    one = F.lit(1.0)
    z = [one, *[F.col(f) for f in features]]
    moments = [F.sum(a * b) for i, a in enumerate(z) for b in z[i:]] + [F.sum(a * F.col(target)) for a in z]
    names = [f"__g{i}" for i in range(len(moments))]
    own = checkpointed(df.groupBy("entity").agg(*[m.alias(n) for m, n in zip(moments, names)]))
    total = own.agg(*[F.sum(n).alias(n) for n in names]).first()  # one row
    split = (p + 1) * (p + 2) // 2
    left = [F.lit(total[n]).cast("double") - F.col(n) for n in names]
    solved = solve(own.select("entity", F.array(*left[:split]).alias("gram"), F.array(*left[split:]).alias("right")), p + 1)
    rows = df.join(solved, "entity").withColumn("prediction", _dot("beta", z))
    window = Window.partitionBy("entity").orderBy("idx")  # bounded: one row per period of the entity
    return rows.select("entity", "label", F.col(target).alias("actual"), "prediction", F.lag(target).over(window).alias("prior_actual"))


def lagged(df: DataFrame, feature: str, lags: list[int]) -> DataFrame:
    """JN-12: exploded by lag; value of the feature exactly ``lag`` periods earlier, else null."""
    past = df.select("entity", F.col("idx").alias("__idx"), F.col(feature).alias("lagged"))
    rows = df.drop(feature).withColumn("lag", F.explode(F.array(*[F.lit(n) for n in lags]))).withColumn("__idx", F.col("idx") - F.col("lag"))
    return rows.join(past, ["entity", "__idx"], "left").drop("__idx")


def lag_search(df: DataFrame, target: str, feature: str, lags: list[int], *, minimum_training: int = 4, frequency: str = "quarterly") -> DataFrame:
    """REG-10: lags ranked by walk-forward error, all lags fitted in one job."""
    rows = lagged(df, feature, lags).filter("lagged IS NOT NULL")
    scored = walk_forward(rows, target, ["lagged"], group=["lag"], minimum_training=minimum_training, frequency=frequency)
    metrics = prediction_metrics(scored, ["lag", "method"])
    best = metrics.groupBy("lag").agg(
        F.max(F.when(F.col("method") == "model", F.col("mae"))).alias("model_mae"), F.min(F.when(F.col("method") != "model", F.col("mae"))).alias("best_baseline_mae"),
        F.max(F.when(F.col("method") == "model", F.col("sample_size"))).alias("sample_size"),
    )
    association = rows.groupBy("lag").agg(numbers.safe_corr("lagged", target).alias("correlation"))
    return best.join(association, "lag").withColumn("beats_baseline", F.col("model_mae") < F.col("best_baseline_mae"))


def stability(df: DataFrame, target: str, features: list[str], *, entity_effects: bool = True, covariance: str = "cluster_entity") -> DataFrame:
    """REG-11: coefficients over trailing windows starting at the first, quarter and middle period."""
    known = [r["idx"] for r in df.select("idx").distinct().orderBy("idx").collect()]  # periods of the calendar
    starts = sorted({known[0], known[len(known) // 4], known[len(known) // 2]}) if known else []
    rows = df.withColumn("window_start", F.explode(F.array(*[F.lit(s) for s in starts]).cast(f"array<{df.schema['idx'].dataType.simpleString()}>"))).filter("idx >= window_start")
    fits = fit_ols(rows, target, features, group=["window_start"], entity_effects=entity_effects, covariance=covariance)
    return fits.filter("term <> 'intercept'").select("window_start", "term", "coefficient", "n")


def sign_stability(windows: DataFrame) -> DataFrame:
    """REG-11: sign agreement across windows."""
    return windows.groupBy("term").agg(
        F.count(F.lit(1)).alias("windows"), F.min("coefficient").alias("minimum"), F.max("coefficient").alias("maximum"),
        (F.min(F.signum("coefficient")) == F.max(F.signum("coefficient"))).alias("sign_consistent"),
    )


def performance(predictions: DataFrame, windows: list[tuple[str, str | None, str | None]], *, period: str = "label") -> DataFrame:
    """REG-11: prediction metrics by market and by named period range, in one pass: (kind, name, and the metrics).

    A range may be open at either end; a row counts in every range that holds it, so ranges may overlap.
    """
    held = [
        F.when((F.lit(start is None) | (F.col(period) >= F.lit(start or ""))) & (F.lit(end is None) | (F.col(period) <= F.lit(end or ""))), F.struct(F.lit("era").alias("kind"), F.lit(name).alias("name")))
        for name, start, end in windows
    ]
    market = F.struct(F.lit("market").alias("kind"), F.col("entity").cast("string").alias("name"))
    parts = F.filter(F.array(market, *held), lambda x: x.isNotNull() & x["name"].isNotNull())
    return prediction_metrics(predictions.select("actual", "prediction", "prior_actual", F.inline(parts)), ["kind", "name"])


def availability_rate(df: DataFrame, features: list[str]) -> DataFrame:
    """REG-11: share of rows whose feature states when it became available, per feature."""
    row = df.agg(*[F.avg(F.col(f"{f}__available_at").isNotNull().cast("double")).alias(f) for f in features])
    return row.unpivot([], features, "feature", "availability_rate")


def cross_source(df: DataFrame, target: str, features: list[str], source: str = "source_company") -> DataFrame:
    """REG-12: train on one source, test on each other source; one fit per source."""
    fits = fit_ols(df.withColumn("train_source", F.col(source)), target, features, group=["train_source"])
    wide = fits.groupBy("train_source").agg(F.array(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))) for t in ["intercept", *features]]).alias("beta"))
    # Every row meets the fit of every other source; that is what is asked for, and it has a bound.
    names = [r[0] for r in df.select(source).distinct().limit(MOST_SOURCES + 1).collect() if r[0] is not None]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to test against one another")
    tests = F.explode(F.array(*[F.lit(n) for n in sorted(names)]).cast(f"array<{df.schema[source].dataType.simpleString()}>"))
    pairs = wide.withColumn("test_source", tests).filter("train_source <> test_source")
    rows = df.withColumnRenamed(source, "test_source").join(pairs, "test_source")
    window = Window.partitionBy("train_source", "entity").orderBy("idx")
    return rows.select(
        "train_source", "test_source", "entity", "label", F.col(target).alias("actual"), _dot("beta", [F.lit(1.0), *[F.col(f) for f in features]]).alias("prediction"),
        F.lag(target).over(window).alias("prior_actual"),
    )


def company_bias(predictions: DataFrame) -> DataFrame:
    """AGG-25: mean residual per tested source."""
    return predictions.groupBy("test_source").agg(F.count(F.lit(1)).alias("observations"), F.avg(F.col("actual") - F.col("prediction")).alias("mean_residual"))


def forecast(rows: DataFrame, coefficients: DataFrame, predictions: DataFrame, features: list[str]) -> DataFrame:
    """REG-13: estimate, per-driver contributions and an empirical p25/p75 residual range."""
    wide = coefficients.agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias(f"__b_{t}") for t in ["intercept", *features]]).first()
    errors_of = checkpointed(predictions.select(F.lit(1).alias("__all"), (F.col("actual") - F.col("prediction")).alias("error")))
    band = keyed.grouped_quantiles(errors_of, ["__all"], "error", {"low_error": 0.25, "high_error": 0.75}).first()
    number = lambda row, c: F.lit(row[c] if row is not None else None).cast("double").alias(c)
    joined = rows.select("*", *[number(wide, c) for c in wide.asDict()], *[number(band, c) for c in ("low_error", "high_error")])
    contributions = {f"{f}__contribution": F.col(f) * F.col(f"__b_{f}") for f in features}
    out = joined.withColumns(contributions).withColumn("estimate", reduce(lambda a, b: a + b, [F.col(c) for c in contributions], F.col("__b_intercept")))
    return out.withColumns({"low": F.col("estimate") + F.col("low_error"), "high": F.col("estimate") + F.col("high_error")}).drop(
        "low_error", "high_error", *[f"__b_{t}" for t in ["intercept", *features]]
    )


def promotion_gates(models: DataFrame, *, minimum_sample: int = 30, minimum_markets: int = 3, minimum_periods: int = 8, maximum_mae: float | None = None) -> DataFrame:
    """REG-14: failed gates per model row."""
    checks = {
        "sample_size_below_minimum": F.col("sample_size") < minimum_sample, "market_count_below_minimum": F.col("markets") < minimum_markets,
        "period_count_below_minimum": F.col("periods") < minimum_periods, "market_depth_below_minimum": F.col("deep_markets") < minimum_markets,
        "look_ahead_not_excluded": ~F.coalesce(~F.col("look_ahead"), F.lit(False)), "no_predictions": F.coalesce("predictions", F.lit(0)) == 0,
        "baseline_not_beaten": ~F.coalesce(F.col("model_mae") < F.col("baseline_mae"), F.lit(False)), "market_holdout_missing": F.coalesce("holdout_predictions", F.lit(0)) == 0,
        "severe_instability": F.coalesce("severe_instability", F.lit(False)),
    }
    if maximum_mae is not None:
        checks["error_above_threshold"] = F.coalesce(F.col("model_mae") > maximum_mae, F.lit(True))
    judged = models.withColumn("failures", errors(checks))
    real = F.coalesce(F.col("data_status") == "real", F.lit(False))
    status = F.when(F.size("failures") > 0, "rejected").when((F.col("model_mode") == "validated_production") & real, "validated").when(F.col("model_mode") == "governed_candidate", "candidate").otherwise("research")
    return judged.withColumn("status", status)


def result_digest(fits: DataFrame, group: list[str], digits: int = 9) -> DataFrame:
    """REG-16: order-free digest of rounded coefficients per model."""
    rows = fits.select(*group, F.sha2(F.concat_ws("|", "term", F.format_number("coefficient", digits)), 256).alias("d"))
    return rows.groupBy(*group).agg(hashing.order_free_digest(F.col("d")).alias("digest"))


def reproduce(df: DataFrame, target: str, features: list[str], stored: DataFrame, group: list[str]) -> DataFrame:
    """REG-16: refit every stored model and compare digests."""
    fresh = result_digest(fit_ols(df, target, features, group=group), group)
    joined = stored.select(*group, F.col("digest").alias("stored_digest")).join(fresh, group, "left")
    return joined.withColumn("reproduced", F.coalesce(F.col("digest") == F.col("stored_digest"), F.lit(False)))
