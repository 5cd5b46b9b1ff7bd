"""SimHash near-dedup against brute force, covering masks, divided buckets, long chains."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from parcelflow.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component of each position of a list of fingerprints."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    return [find(p) for p in prints]


@pytest.mark.parametrize("name", ["edge", "tiny", "nothing"])
def test_documents(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, brute_print(r.text or "")) for r in docs.collect()]
    parts = brute_components([p for _, p in rows])
    least = {}
    for (i, _), part in zip(rows, parts, strict=True):
        least[part] = min(filter(lambda x: x is not None, (least.get(part), i)), default=None)
    want = sorted(str((i, f"{p:016x}", least[part])) for (i, p), part in zip(rows, parts, strict=True))
    assert sorted(str(tuple(r)) for r in simhash.near_dedup(docs).collect()) == want


def test_every_pair_within_the_radius_collides():
    tables = simhash.masks(list(range(64)))
    assert len(tables) == 15
    for flips in itertools.combinations(range(64), 3):
        mask = sum(1 << p for p in flips)
        assert any(t & mask == 0 for t in tables)


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_keep_components(spark, bucket):
    """A crowded ball, a long chain and far points, with buckets that must be divided."""
    draw = random.Random(2)
    centre = draw.getrandbits(64)
    prints = {centre ^ sum(1 << p for p in draw.sample(range(40), draw.randint(0, 5))) for _ in range(300)}
    step = draw.getrandbits(64)
    for p in range(60):
        prints.add(step)
        step ^= 1 << p
    prints |= {draw.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, bucket=bucket)).collect()}
    got = [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    want = brute_components(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_blocks_change_nothing(monkeypatch):
    text = b"a few words that come again and again " * 50
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole and whole % 2**64 == brute_print(text.decode())


def test_third_division_is_small():
    assert max(64 - mask.bit_count() for _, _, mask in simhash.divisions(3, 3)) <= 9 and np.bitwise_count(np.uint64(7)) == 3
