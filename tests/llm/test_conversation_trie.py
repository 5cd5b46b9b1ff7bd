"""The prefix trie against a dictionary of prefixes, for several block sizes and edges, hot groups and edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from parcelflow.llm import conversation_trie

DDL = "conv_id long, turn long, role string, text string, depth long, parent string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def made(seed, convs=150):
    """Short conversations over few turns, so prefixes are shared; some long, some equal, nulls and ties."""
    draw, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(draw.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, t if draw.random() < 0.9 else None, draw.choice(["user", "bot", None]), draw.choice(["hi", "", None, "é\U0001f600", "a longer turn"])))
    rows += [(400 + c, t, "user", "same") for c in range(60) for t in range(5)]  # a hot group of copies
    rows += [(500 + c, t, "user", f"deep {t if t < 70 else t * (1 + c % 3)}") for c in range(6) for t in range(90)]  # parts beyond the edge
    return rows + rows[:7] + [(None, 0, "user", "nobody's"), (-5, 1, "user", "hi"), (1_000_003, 1, "user", "base is absent")]


@pytest.mark.parametrize(("cells", "edge"), [(conversation_trie.CELLS, 64), (40, 64), (40, 2), (1, 3)])
def test_against_brute_force(spark, cells, edge):
    rows = made(cells % 97)
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], DDL).repartition(5)
    assert found(conversation_trie.trie(df, cells, edge)) == brute(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert found(conversation_trie.trie(df)) == found(conversation_trie.trie(df.repartition(7), cells=100)) == brute(rows)


def test_empty_and_turnless(spark):
    nothing = spark.createDataFrame([], DDL)
    assert conversation_trie.trie(nothing).count() == 0
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its one turn is replaced by none
    rows = [(short, 0, "user", "gone")]
    assert found(conversation_trie.trie(spark.createDataFrame([(*r, 0, "") for r in rows], DDL))) == brute(rows)
    assert brute(rows)[0][1:4] == (0, None, 1)
