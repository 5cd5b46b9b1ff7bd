"""Keyed aggregates, ranks, lags and quantiles that never hold one whole key in a task.

A window partitioned by a business key sends the whole key to one task, which fails when a
single key owns a large share of the rows.  The helpers here split a key by a monotone
``chunk`` expression (or by dense position) and stitch the pieces with per-chunk
aggregates, so the largest unit of work is one chunk of one key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION_BLOCK = 16384
SMALL_GROUP = 256
#: Groups of up to this many times ``SMALL_GROUP`` rows are searched inside a task.
TASK_GROUPS = 256


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null matches null; key columns are kept once, from the left."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(and_, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], *aggregates: Column, how: str = "inner") -> DataFrame:
    """Attach group aggregates to every row: partial aggregation, then a join AQE can split."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys, how)


def rows_of_groups(df: DataFrame, keys: list[str], having: Column, *aggregates: Column) -> DataFrame:
    """Rows whose group satisfies ``having``; only the offending keys take part in the join."""
    bad = df.groupBy(*keys).agg(*aggregates).filter(having)
    return null_safe_join(df, bad, keys)


def dense_positions(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "position") -> DataFrame:
    """0-based position of each row within its key, ordered by ``order``.

    ``chunk`` must not decrease along ``order``.  Rows are numbered inside a chunk and
    shifted by the number of rows in earlier chunks of the same key.
    """
    split = df.withColumn("__chunk", chunk)
    inside = split.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1)
    before = (
        split.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__rows").over(
                    Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("__rows")
    )
    return (
        null_safe_join(inside, before, [*keys, "__chunk"])
        .withColumn(out, (F.col("__before") + F.col("__n")).cast("long"))
        .drop("__chunk", "__n", "__before")
    )


def lag_positions(
    df: DataFrame, keys: list[str], position: str, lags: dict[str, tuple[str, int]], block: int = POSITION_BLOCK
) -> DataFrame:
    """``lag(column, k)`` by dense position: each block also receives the tail of the block before it."""
    reach = max(k for _, k in lags.values())
    if reach >= block:
        raise ValueError("block must exceed the largest lag")
    home = F.floor(F.col(position) / block)
    copies = F.when(F.col(position) % block >= block - reach, F.array(home, home + 1)).otherwise(F.array(home))
    window = Window.partitionBy(*keys, "__block").orderBy(position)
    out = df.withColumn("__block", F.explode(copies))
    out = out.withColumns({name: F.lag(column, k).over(window) for name, (column, k) in lags.items()})
    return out.filter(F.col("__block") == home).drop("__block")


def running_max(df: DataFrame, keys: list[str], position: str, column: str, out: str, block: int = POSITION_BLOCK) -> DataFrame:
    """Running maximum along dense positions: block maxima first, then inside each block."""
    split = df.withColumn("__block", F.floor(F.col(position) / block))
    earlier = (
        split.groupBy(*keys, "__block").agg(F.max(column).alias("__m"))
        .withColumn(
            "__earlier",
            F.max("__m").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .drop("__m")
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(split.withColumn("__in", F.max(column).over(inside)), earlier, [*keys, "__block"])
        .withColumn(out, F.greatest("__in", "__earlier"))
        .drop("__block", "__in", "__earlier")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column, column: str, out: str) -> DataFrame:
    """Inclusive running sum along ``order`` with the key split by ``chunk``."""
    split = df.withColumn("__chunk", chunk)
    earlier = (
        split.groupBy(*keys, "__chunk").agg(F.sum(column).alias("__s"))
        .withColumn(
            "__earlier",
            F.coalesce(
                F.sum("__s").over(
                    Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("__s")
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(split.withColumn("__in", F.sum(column).over(inside)), earlier, [*keys, "__chunk"])
        .withColumn(out, F.col("__in") + F.col("__earlier"))
        .drop("__chunk", "__in", "__earlier")
    )


def value_chunks(df: DataFrame, keys: list[str], column: str, pieces: int = 64) -> DataFrame:
    """Add ``__piece``: a monotone piece number of ``column`` within its key, from a bounded sketch."""
    cuts = [i / pieces for i in range(1, pieces)]
    sketch = df.groupBy(*keys).agg(F.percentile_approx(column, cuts, 1000).alias("__cuts"))
    joined = null_safe_join(df, sketch, keys)
    return joined.withColumn(
        "__piece", F.size(F.filter("__cuts", lambda c: c < F.col(column)))
    ).drop("__cuts")


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, fractions: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of every key, without gathering a key's values.

    Equal values collapse to one row with a count, counts are accumulated in value order
    over pieces of the key, and only the two order statistics around each target rank are
    kept.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    split = value_chunks(counts, keys, "__v")
    ranked = running_sum(split, keys, ["__v"], F.col("__piece"), "__c", "__upto").drop("__piece")
    ranked = null_safe_join(ranked, totals, keys)
    aggregates = []
    for name, fraction in fractions.items():
        target = F.lit(float(fraction)) * (F.col("__total") - 1)
        low, high = F.floor(target), F.ceil(target)
        covers = lambda rank: (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
        aggregates += [
            F.max(F.when(covers(low), F.col("__v"))).alias(f"__{name}_low"),
            F.max(F.when(covers(high), F.col("__v"))).alias(f"__{name}_high"),
            F.max(target - low).alias(f"__{name}_w"),
        ]
    out = ranked.groupBy(*keys).agg(*aggregates)
    return out.select(
        *keys,
        *[
            (F.col(f"__{n}_low") * (1 - F.col(f"__{n}_w")) + F.col(f"__{n}_high") * F.col(f"__{n}_w")).alias(n)
            for n in fractions
        ],
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per key; Spark prunes to ``limit`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The single first row per key under ``order``."""
    return top_rows(df, keys, order, 1, "__newest").drop("__newest")


def peer_median_distance(
    df: DataFrame, group: list[str], source: str, value: str, relative: Column, out: str = "peer_distance",
    stage=lambda df: df,
) -> DataFrame:
    """Median distance from each (group, source, value) to the values of the other sources.

    Distance is ``|a-b|`` or, where ``relative``, ``|a-b| / max(|a|,|b|)``.  Groups of at most
    ``SMALL_GROUP`` rows are compared inside one array, those of at most ``TASK_GROUPS`` times as many are
    searched by halving inside a task (unless relative distances meet values that are not positive), and
    larger groups go through ranks, which give the same distances for any signs and never pair or gather
    the rows of a group.  Returns one row per distinct (group, source, value) that has at least one peer.
    """
    base = df.select(
        *group, F.col(source).alias("__source"), F.col(value).cast("double").alias("__v"), relative.alias("__rel")
    ).filter("__v IS NOT NULL")
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"), F.min("__v").alias("__least"), F.first("__rel").alias("__r"))
    most = F.when(F.col("__r") & (F.col("__least") <= 0), SMALL_GROUP).otherwise(SMALL_GROUP * TASK_GROUPS)
    way = F.when(F.col("__size") <= SMALL_GROUP, 0).when(F.col("__size") <= most, 1).otherwise(2)
    ways = stage(sizes.select(*group, way.alias("__way")))
    taken = sorted(r["__way"] for r in ways.select("__way").distinct().collect())
    parts = []
    for number in taken:
        rows = base if len(taken) == 1 else null_safe_join(base, ways.filter(F.col("__way") == number).select(*group), group, "left_semi")
        if number == 0:
            parts.append(_peer_distance_in_arrays(rows, group, source, value, out))
        elif number == 1:
            parts.append(_peer_distance_in_groups(rows, group, source, value, out))
        else:
            parts.append(_peer_distance_by_rank(rows, group, source, value, out, stage))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else _peer_distance_in_arrays(base, group, source, value, out)


def _peer_distance_in_arrays(base: DataFrame, group: list[str], source: str, value: str, out: str) -> DataFrame:
    members = base.groupBy(*group).agg(F.collect_list(F.struct("__source", "__v")).alias("__m"), F.first("__rel").alias("__rel"))
    asked = members.withColumn("__q", F.explode(F.array_distinct("__m")))
    far = F.array_sort(F.transform(
        F.filter("__m", lambda x: x["__source"] != F.col("__q.__source")), lambda x: _distance(F.col("__q.__v"), x["__v"], F.col("__rel"))
    ))
    ranked = asked.select(*group, "__q", far.alias("__d")).filter(F.size("__d") > 0)
    low, high = F.floor((F.size("__d") - 1) / 2).cast("int"), F.floor(F.size("__d") / 2).cast("int")
    return ranked.select(
        *group, F.col("__q.__source").alias(source), F.col("__q.__v").alias(value), ((F.col("__d")[low] + F.col("__d")[high]) / 2).alias(out)
    )


def _peer_distance_in_groups(base: DataFrame, group: list[str], source: str, value: str, out: str) -> DataFrame:
    types = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([*[T.StructField(k, types[k]) for k in group], T.StructField(source, types["__source"]), T.StructField(value, T.DoubleType()), T.StructField(out, T.DoubleType())])

    def medians(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(rows["__source"])
        values, rel = rows["__v"].to_numpy(), bool(rows["__rel"].iloc[0])
        found = []
        for code, name in enumerate(names):
            asked, others = np.unique(values[codes == code]), np.sort(values[(codes != code) & (codes >= 0)])
            if len(others):
                found.append((np.full(len(asked), name, object), asked, _median_distance(asked, others, rel)))
        if not found:
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in schema.names})
        whose, asked, distance = (np.concatenate(part) for part in zip(*found, strict=True))
        same = {k: pd.Series([x] * len(asked), dtype=object) for k, x in zip(group, key, strict=True)}
        return pd.DataFrame({**same, source: pd.Series(whose, dtype=object), value: asked, out: distance})

    return base.groupBy(*group).applyInPandas(medians, schema)


def _median_distance(asked: np.ndarray, others: np.ndarray, rel: bool) -> np.ndarray:
    """Median distance of each asked value to all sorted others.  The k nearest are a run, whose start is found by
    halving; relative distances take positive values only."""

    def signed(a, b):
        return (b - a) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-9) if rel else b - a

    n = len(others)
    ranks = ((n + 1) // 2, n // 2 + 1)
    total = np.zeros(len(asked))
    for k in ranks:
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), n - k, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            later = (low < high) & (signed(others[middle], asked) > signed(asked, others[np.minimum(middle + k, n - 1)]))
            low, high = np.where(later, middle + 1, low), np.where(later, high, np.maximum(middle, low))
        total += np.maximum(np.abs(signed(asked, others[low])), np.abs(signed(asked, others[low + k - 1])))
    return total / 2


def _peer_distance_by_rank(base: DataFrame, group: list[str], source: str, value: str, out: str, stage) -> DataFrame:
    """The k values nearest to a query on one monotone side are a contiguous run in sorted order, and the
    start of that run is the number of run midpoints below the query.  One rank pass, one rank-shifted
    equi-join and one as-of count give the k-th nearest distance.

    A plain distance has one side.  A relative distance has three: values of the query's sign are nearer
    than 1 and monotone in magnitude, zeros are at 1, and values of the other sign lie at 1 + smaller
    over larger magnitude, so the j-th nearest of m such values is the (m - j + 1)-th nearest by
    relative distance of magnitudes, at 2 minus that distance.
    """
    keys = [*group, "__asker"]
    askers = base.select(*group, F.col("__source").alias("__asker")).distinct()
    renamed = base.withColumnsRenamed({k: f"__r_{k}" for k in group})
    match = reduce(and_, [askers[k].eqNullSafe(renamed[f"__r_{k}"]) for k in group])
    sign = lambda c: F.when(F.col("__rel"), F.signum(c)).otherwise(F.lit(0.0)).cast("int")
    size = lambda c: F.when(F.col("__rel"), F.abs(c)).otherwise(F.col(c))
    peers = (
        askers.join(renamed, match & (F.col("__asker") != F.col("__source")))
        .select(*keys, sign("__v").alias("__side"), size("__v").alias("__v"), "__rel")
    )
    sided = [*keys, "__side"]
    ranked = stage(dense_positions(value_chunks(peers.drop("__rel"), sided, "__v"), sided, ["__v"], F.col("__piece"), "__i").drop("__piece"))
    count = lambda s: F.count_if(F.col("__side") == s)
    sizes = peers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), count(1).alias("__plus"), count(-1).alias("__minus"), count(0).alias("__zero"), F.first("__rel").alias("__rel")
    )
    queries = base.select(*group, F.col("__source").alias("__asker"), sign("__v").alias("__sign"), size("__v").alias("__q"), F.col("__v").alias("__value")).distinct()
    own, other = F.when(F.col("__sign") > 0, F.col("__plus")).otherwise(F.col("__minus")), F.when(F.col("__sign") > 0, F.col("__minus")).otherwise(F.col("__plus"))
    total = None
    for which, k in (("lower", F.floor((F.col("__n") + 1) / 2)), ("upper", F.floor(F.col("__n") / 2) + 1)):
        signs = sizes.withColumns({"__sign": F.explode(F.when(F.col("__rel"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))), "__k": k.cast("long")})
        flat = F.col("__rel") & (F.col("__sign") == 0)
        constant = F.when(flat, F.when(F.col("__k") <= F.col("__zero"), 0.0).otherwise(1.0)).when(
            F.col("__rel") & (F.col("__k") > own) & (F.col("__k") <= own + F.col("__zero")), 1.0
        )
        far = F.col("__rel") & ~flat & (F.col("__k") > own + F.col("__zero"))
        plan = signs.select(
            *keys, "__sign", "__rel", constant.alias("__constant"), far.alias("__far"), F.when(far, -F.col("__sign")).otherwise(F.col("__sign")).alias("__side"),
            F.when(far, other - (F.col("__k") - own - F.col("__zero")) + 1).otherwise(F.col("__k")).alias("__k"),
        )
        asked = null_safe_join(queries, plan, [*keys, "__sign"])
        fixed = asked.filter("__constant IS NOT NULL").select(*keys, "__value", F.col("__constant").alias(which))
        signed = [*keys, "__sign"]
        points = stage(null_safe_join(ranked, plan.filter("__constant IS NULL").select(*sided, "__sign", "__k", "__rel"), sided).select(*signed, "__i", "__v", "__k", "__rel"))
        ahead = points.select(*signed, F.col("__i").alias("__j"), F.col("__v").alias("__then"))
        mids = null_safe_join(points.withColumn("__j", F.col("__i") + F.col("__k")), ahead, [*signed, "__j"]).select(
            *signed, F.when(F.col("__rel"), F.sqrt(F.col("__v") * F.col("__then"))).otherwise((F.col("__v") + F.col("__then")) / 2).alias("__m")
        )
        searched = asked.filter("__constant IS NULL").select(*signed, "__q", "__value", "__k", "__rel", "__far")
        located = _count_below(searched, mids, signed)
        near = points.select(*signed, F.col("__i").alias("__start"), F.col("__v").alias("__lo"))
        last = points.select(*signed, F.col("__i").alias("__end"), F.col("__v").alias("__hi"))
        located = null_safe_join(located, near, [*signed, "__start"])
        located = null_safe_join(located.withColumn("__end", F.col("__start") + F.col("__k") - 1), last, [*signed, "__end"])
        distance = F.greatest(
            _distance(F.col("__q"), F.col("__lo"), F.col("__rel")), _distance(F.col("__q"), F.col("__hi"), F.col("__rel"))
        )
        part = fixed.unionByName(located.select(*keys, "__value", F.when(F.col("__far"), 2 - distance).otherwise(distance).alias(which)))
        total = part if total is None else null_safe_join(total, part, [*keys, "__value"])
    return total.select(
        *group, F.col("__asker").alias(source), F.col("__value").alias(value),
        ((F.col("lower") + F.col("upper")) / 2).alias(out),
    )


def _distance(left: Column, right: Column, relative: Column) -> Column:
    gap = F.abs(left - right)
    return F.when(relative, gap / F.greatest(F.abs(left), F.abs(right), F.lit(1e-9))).otherwise(gap)


def _count_below(queries: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """For each query ``__q`` the number of points ``__m`` strictly below it, as ``__start``."""
    extra = [c for c in queries.columns if c not in [*keys, "__q"]]
    payload = F.struct(*extra)
    marks = queries.select(*keys, F.col("__q").alias("__at"), F.lit(0).alias("__kind"), F.lit(0).alias("__one"), payload.alias("__payload"))
    dots = points.select(
        *keys, F.col("__m").alias("__at"), F.lit(1).alias("__kind"), F.lit(1).alias("__one"),
        F.lit(None).cast(marks.schema["__payload"].dataType).alias("__payload"),
    )
    merged = value_chunks(marks.unionByName(dots), keys, "__at")
    counted = running_sum(merged, keys, ["__at", "__kind"], F.col("__piece"), "__one", "__start")
    return counted.filter("__kind = 0").select(*keys, F.col("__at").alias("__q"), F.col("__start").cast("long").alias("__start"), "__payload.*")
