"""Exact dedup: brute force, splits, insertions, hot copies."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import exact
from parcelflow.llm.common import shared_folder, stored

SPACE = r"[\x20\x09-\x0D]+"


def brute(docs):
    groups = defaultdict(list)
    rows = [(r.doc_id, re.sub(SPACE, " ", r.text or "")) for r in docs.collect()]
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("name", ["edge", "tiny", "nothing"])
@pytest.mark.parametrize("capacity", [exact.CAPACITY, 3])
def test_against_brute_force(request, name, capacity):
    docs = request.getfixturevalue(name)
    got = exact.dedup(docs, capacity).drop("key", "bucket").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs)


def test_buckets_split_and_cover(tiny):
    index = exact.build(tiny, capacity=20)
    assert index.depth >= 3
    spans = index.slots()
    assert spans[0][0] == 0 and spans[-1][1] == 2**exact.MOST_BITS - 1 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    sizes = index.routed(index.entries()).groupBy("bucket").agg(F.count_distinct("key").alias("n")).collect()
    assert max(r.n for r in sizes) <= 20


def test_insertions_equal_one_build(spark, tiny):
    folder = shared_folder(spark)
    index = exact.Index(spark, folder, 20)
    for part in range(3):
        index.insert(stored(exact.chains(tiny.filter(F.col("doc_id") % 3 == part)), folder, f"part-{part}"))
    columns = ["key", "text_sha256", "n_bytes", "keep_id", "group_size"]
    whole = exact.build(tiny, 20)
    assert sorted(index.entries().select(columns).collect()) == sorted(whole.entries().select(columns).collect())
    assert {b for b in index.buckets} == {b for b in whole.buckets}


def test_native_plan(tiny):
    plan = exact.dedup(tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
