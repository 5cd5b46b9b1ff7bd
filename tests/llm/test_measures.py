"""Mixing, quality, license and sharding operators against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from parcelflow.llm import licenses, mixing, quality, sharding

WS = r"[\x20\x09-\x0D]"


def pairs(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.collect()]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **want}
        fixed.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("name", ["edge", "tiny"])
def test_mixing(request, name):
    docs = request.getfixturevalue(name)
    rows = pairs(docs)
    size = lambda t: len(re.findall(WS.replace("[", "[^") + "+", t))
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
    want = brute_targets(totals)
    got = mixing.mix(docs, chunk_rows=7).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size(t), totals[s]) for i, t, s in rows)
    assert sorted((r.size, round(r.target, 6)) for r in got) == sorted((size(t), round(want[s], 6)) for _, t, s in rows)
    assert all(0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    largest = max(r.size for r in got)
    assert sum(totals.values()) - largest < sum(r.taken for r in got) <= sum(totals.values())
    by_target = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        entry = by_target[round(r.target, 6), r.source_size]
        entry[:] = [entry[0] + r.taken, r.target, max(entry[2], r.size)]
    n_same = Counter((round(want[s], 6), totals[s]) for s in totals)
    slack = largest * len(totals)
    assert all(abs(taken - target * n_same[k]) <= slack for k, (taken, target, _) in by_target.items())
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(5), chunk_rows=7).collect(), key=str)


def test_mixing_order_is_fair_queueing(tiny):
    """Kept offers are exactly the prefix, by virtual finish time, that fits the budget."""
    queue, budget = mixing.queued(tiny, mixing.WEIGHTS, 3, 50, 42)
    rows = queue.filter("size > 0").collect()
    offers = sorted((((p * r.source_size + r.cumulative) / r.target, r["rank"], r["__u"], r.doc_id), r.size) for r in rows for p in range(3))
    taken, reached = Counter(), 0
    for (_, _, _, i), size in offers:
        reached += size
        if reached > budget:
            break
        taken[i] += size
    assert {r.doc_id: r.taken for r in mixing.mix(tiny, chunk_rows=50).collect() if r.taken} == dict(taken)


def brute_quality(text):
    words = re.findall(WS.replace("[", "[^") + "+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WS.replace("[", "[^"), line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("name", ["edge", "tiny"])
def test_quality_measures(request, name):
    docs = request.getfixturevalue(name)
    got = quality.apply_policy(quality.ledger(docs), "base").collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(
        (i, *brute_quality(t)) for i, t, _ in pairs(docs)
    )
    assert all(r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words) for r in got)


def test_quality_ablation(tiny):
    entries = quality.ledger(tiny)
    rows = entries.collect()
    for r in quality.ablation(entries).collect():
        policy = quality.POLICIES[r.version]
        assert r.rows == len(rows) and r.kept == sum(not e.failed & quality.mask(policy) for e in rows)
        assert r.kept_without_rule == sum(not e.failed & quality.mask(tuple(x for x in policy if x != r.rule)) for e in rows)


@pytest.mark.parametrize("name", ["edge", "tiny"])
def test_license_base(request, name):
    docs = request.getfixturevalue(name)
    want = Counter()
    for i, t, _ in pairs(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        want[i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = licenses.scan_documents(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_rules_and_suppression():
    assert sum(len(group) for _, group in licenses.rules()) > 200
    kept = licenses.unsuppressed(licenses.detections(b"licensed under the apache license, version 2.0. released under the mit license."))
    assert {label for *_, label in kept} == {"apache-2.0", "mit", "unnamed", "apache"} - {"apache"} or {label for *_, label in kept} >= {"apache-2.0", "mit"}
    spans = [(0, 10, 50, "a"), (2, 5, 40, "b"), (2, 5, 90, "c"), (0, 10, 50, "d"), (8, 12, 50, "e")]
    want = [s for s in spans if not any(o is not s and o[0] <= s[0] and s[1] <= o[1] and (o[2], o[1] - o[0], -spans.index(o)) > (s[2], s[1] - s[0], -spans.index(s)) for o in spans)]
    assert sorted(licenses.unsuppressed(spans)) == sorted(want)


def test_each_license_rule_finds_its_own_template():
    labels = defaultdict(set)
    for _, _, label, templates, versions, variants in licenses.FAMILIES:
        for template in templates:
            for v in versions if "{v}" in template else ("",):
                for x in variants if "{x}" in template + label else ("",):
                    text = template.format(v=v, x=x).replace("[0-9]", "7").strip()
                    name = re.sub("-+$", "", label.format(v="" if "[" in v else v, x=x.replace(" ", "-")))
                    labels[text].add(name)
                    assert any(d[:2] == (0, len(text)) and d[3] == name for d in licenses.detections(text.encode())), text
    assert {t: n for t, n in labels.items() if len(n) > 1} == {}
    alone = lambda t: {label for *_, label in licenses.unsuppressed(licenses.detections(t))}
    assert alone(b"affero gpl version 3") == {"affero-3"} and alone(b"open database license") == {"odc-odbl"}
    assert alone(b"berkeley software distribution license") == {"bsd"} and alone(b"psf license 2") == {"psf-2"}


@pytest.mark.parametrize("name", ["edge", "tiny"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    got = sharding.shard(docs, range_rows=20).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in pairs(docs))
    total, by_shard = sum(r.size for r in got), defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    for k, rows in by_shard.items():
        assert 0 <= k < 16 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 16) <= max(r.size for r in got)
    key = lambda r: (r.doc_id, r.size, r.shard, r.slot)
    assert sorted(map(str, map(key, got))) == sorted(map(str, map(key, sharding.shard(docs.repartition(4), range_rows=20).collect())))


def test_hot_text_is_cut(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 > 0, 'the same text', concat('text ', id)) AS text")
    got = sharding.shard(docs, range_rows=100).groupBy("shard").sum("size").collect()
    assert len(got) == 16 and max(r[1] for r in got) - min(r[1] for r in got) <= 60


def test_empty_tables(nothing):
    for df in (mixing.mix(nothing), quality.ablation(quality.ledger(nothing)), licenses.scan_documents(nothing), sharding.shard(nothing)):
        assert df.count() == 0
