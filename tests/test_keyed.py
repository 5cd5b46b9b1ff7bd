"""Skew-safe keyed helpers against plain computations, with one dominant key."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import keyed


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 7}", i % 400, round(rng.uniform(-5, 5), 2), f"s{rng.randrange(4)}") for i in range(1500)]
    return spark.createDataFrame(data, "k string, t int, v double, s string"), data


def test_positions_lags_and_running_max(rows):
    df, data = rows
    placed = keyed.dense_positions(df, ["k"], ["t", "v"], F.floor(F.col("t") / 25))
    out = keyed.running_max(keyed.lag_positions(placed, ["k"], "position", {"l1": ("v", 1), "l4": ("v", 4)}, block=32), ["k"], "position", "v", "peak", block=32)
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.position] = r
    for key in {d[0] for d in data}:
        want = [v for _, v in sorted((d[1], d[2]) for d in data if d[0] == key)]
        assert sorted(got[key]) == list(range(len(want)))
        for i, value in enumerate(want):
            r = got[key][i]
            assert r.v == value and r.peak == max(want[: i + 1])
            assert r.l1 == (want[i - 1] if i else None) and r.l4 == (want[i - 4] if i >= 4 else None)


def test_grouped_quantiles(rows):
    df, data = rows
    got = {r.k: r for r in keyed.grouped_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.9}).collect()}
    for key in got:
        values = sorted(d[2] for d in data if d[0] == key)
        for name, f in (("a", 0.1), ("m", 0.5), ("z", 0.9)):
            at = f * (len(values) - 1)
            low = int(at)
            want = values[low] * (1 - at + low) + values[min(low + 1, len(values) - 1)] * (at - low)
            assert got[key][name] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("relative", [False, True])
def test_peer_median_distance_equals_brute_force(rows, relative):
    df, data = rows
    out = keyed.peer_median_distance(df, ["k"], "s", "v", F.lit(relative)).collect()
    assert len(out) == len({(d[0], d[3], d[2]) for d in data})

    def distance(a, b):
        return abs(a - b) / max(abs(a), abs(b), 1e-9) if relative else abs(a - b)

    for r in random.Random(1).sample(out, 120):
        want = statistics.median(distance(r.v, d[2]) for d in data if d[0] == r.k and d[3] != r.s)
        assert r.peer_distance == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("n", "relative"), [(7, True), (300, True), (300, False)])
def test_peer_distance_by_rank_with_mixed_signs(spark, monkeypatch, n, relative):
    """The way of large groups gives the brute-force median for positive, negative, zero and equal values."""
    from parcelflow.session import checkpointed

    draw = random.Random(n)
    values = [0.0, 1.0, -1.0, 5.0, -7.0, -100.0, 2.0] if n == 7 else [draw.choice([0.0, 1.0, -1.0, draw.uniform(-9, 9), draw.lognormvariate(0, 2), -draw.lognormvariate(0, 2)]) for _ in range(n)]
    data = [(f"s{i % 7}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame([("k", s, v) for s, v in data], "k string, s string, v double")
    monkeypatch.setattr(keyed, "SMALL_GROUP", 0)
    got = {(r.s, r.v): r.peer_distance for r in keyed.peer_median_distance(df, ["k"], "s", "v", F.lit(relative), stage=checkpointed).collect()}
    assert set(got) == set(data)
    distance = lambda a, b: abs(a - b) / max(abs(a), abs(b), 1e-9) if relative else abs(a - b)
    for s, v in got:
        assert got[s, v] == pytest.approx(statistics.median(distance(v, x) for o, x in data if o != s), abs=1e-9)


def test_null_keys_match(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    out = {(r.k, r.v): r.n for r in keyed.with_group_stats(df, ["k"], F.count(F.lit(1)).alias("n")).collect()}
    assert out == {(None, 1): 2, (None, 2): 2, ("a", 3): 1}


@pytest.mark.parametrize("relative", [False, True])
def test_peer_distance_searched_inside_a_task(spark, monkeypatch, relative):
    """Groups between the array limit and the rank limit are searched by halving, with equal values and a null key."""
    draw = random.Random(8)
    data = [(None if i % 2 else "k", f"s{i % 3}", draw.choice([1.0, 2.0, 1e-10, draw.uniform(0.1, 9)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, s string, v double")
    monkeypatch.setattr(keyed, "SMALL_GROUP", 4)
    monkeypatch.setattr(keyed, "_peer_distance_by_rank", None)
    got = {(r.k, r.s, r.v): r.peer_distance for r in keyed.peer_median_distance(df, ["k"], "s", "v", F.lit(relative)).collect()}
    assert set(got) == set(data)
    distance = lambda a, b: abs(a - b) / max(abs(a), abs(b), 1e-9) if relative else abs(a - b)
    for k, s, v in got:
        assert got[k, s, v] == pytest.approx(statistics.median(distance(v, x) for g, o, x in data if o != s and g == k), abs=1e-12)
