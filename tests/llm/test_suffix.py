"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from parcelflow.llm import suffix_dedup, suffixes


def brute(rows):
    """rows: (doc_id, bytes).  A window is a repeat if its least (id, start) is smaller than its own."""
    late = 1 << 62
    order = {None: late}
    least = {}
    for i, t in rows:
        for k in range(len(t) - 99):
            place = (order.get(i, i), k)
            w = t[k : k + 100]
            if w not in least or place < least[w]:
                least[w] = place
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - 99):
            if least[t[k : k + 100]] < (order.get(i, i), k):
                gone[k] += 1
                gone[k + 100 if k + 100 < len(gone) else -1] -= 1
        covered = np.cumsum(gone)[: len(t)] > 0
        spans = int((covered & ~np.concatenate(([False], covered[:-1]))).sum()) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~covered].tobytes()
        out.append((i, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def check(docs, **options):
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    got = suffix_dedup.dedup(docs, **options).collect()
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_tiny(tiny, batches):
    check(tiny, batches=batches)


def test_crowded_grams_take_the_other_way(tiny):
    check(tiny, batches=2, crowd=1)


def test_edges(spark, nothing):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefg ") for _ in range(draw.randint(1, 9)))
    stretch = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 1000), (6, "ab" * 300), (7, stretch[0]), (8, stretch[0]), (9, "é" * 150), (10, "é" * 150 + "x"), (None, stretch[0])]
    for i in range(11, 90):
        text = "".join(draw.choice(stretch)[draw.randint(0, 60) : draw.randint(100, 200)] + word() * draw.randint(0, 5) for _ in range(draw.randint(1, 5)))
        rows.append((i, text))
    rows.append(rows[20])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for batches in (1, 3):
        check(docs, batches=batches)
    assert suffix_dedup.dedup(nothing).count() == 0


def test_long_texts_and_small_blocks(monkeypatch, spark):
    draw = random.Random(8)
    part = "".join(draw.choice("abcdefghij") for _ in range(3000))
    long = part + "".join(draw.choice("abcdefghij") for _ in range(5000)) + part[500:2500]
    rows = [(2, long.encode()), (1, part.encode()), (3, (long * 2).encode())]
    whole = [suffixes.neighbourhoods(b) for b in suffixes.pieces(rows)]
    assert sum(x["width"].sum() for x in whole) == sum(len(t) - 99 for _, t in rows)
    monkeypatch.setattr(suffixes, "BLOCK", 2048)
    cut = [suffixes.neighbourhoods(b) for b in suffixes.pieces(rows)]
    assert sum(x["width"].sum() for x in cut) == sum(x["width"].sum() for x in whole)
    check(spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string"))


def test_levels_merge_like_a_counter(spark, tiny):
    family = suffix_dedup.Family(spark)
    rows = suffix_dedup.keyed(tiny, "doc_id", "text")
    parts = suffix_dedup.in_batches(rows, 5)
    held = []
    for part in parts:
        family.add(part)
        held.append([level is not None for level in family.levels])
    assert held == [[True], [False, True], [True, True], [False, False, True], [True, False, True]]
    entries = Counter()
    for level in family.levels:
        if level is not None:
            entries.update((r.gram, r.whole) for r in level.collect())
    assert max(entries.values()) == 1
    once = suffix_dedup.Family(spark)
    once.add(rows)
    assert {(r.gram, r.whole) for r in once.levels[0].collect()} == set(entries)


def test_kept_text(spark):
    part = "some words that are long enough to be met again, more than one hundred bytes of them, at least in two texts "
    docs = spark.createDataFrame([(1, "start " + part), (2, "other " + part + "end")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.dedup(docs, with_text=True).collect()}
    assert got[1] == "start " + part and got[2] in ("otherend", "other" + "end")


def test_one_id_with_several_texts(spark):
    """Bytes go only where an earlier string covers them, whichever text of the id stands first."""
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    a, b, shared = some(300), some(400), some(200)
    rows = [(1, a), (5, a[:250] + some(80)), (5, b), (5, b), (7, "x" + b[100:380]), (None, shared + some(30)), (None, some(40) + shared), (9, shared + "q")]
    docs = spark.createDataFrame([(*r, 0, 1, b"") for r in rows], "doc_id long, text string, doc long, part int, packed binary").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(docs).collect())
    assert got == Counter([
        (1, 300, 0, 0), (5, 330, 250, 1), (5, 400, 0, 0), (5, 400, 0, 0), (7, 281, 280, 1), (None, 230, 200, 1), (None, 240, 200, 1), (9, 201, 0, 0),
    ])


def test_parts_of_one_document_are_in_order(spark):
    """A passage that two texts of one id share stays in the one whose hash is less."""
    draw = random.Random(6)
    passage = "".join(draw.choice("abcdefghij ") for _ in range(150))
    docs = spark.createDataFrame([(3, "one " + passage), (3, "another " + passage)], "doc_id long, text string")
    got = suffix_dedup.dedup(docs, with_text=True).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False, True] and all(r.n_removed in (0, 150, 151) for r in got)
    assert sorted(len(r.kept) for r in got)[0] < 10


def test_levels_merge_in_a_bulk_run(spark, tiny, monkeypatch):
    seen = []
    add = suffix_dedup.Family.add
    monkeypatch.setattr(suffix_dedup.Family, "add", lambda self, *a, **k: (add(self, *a, **k), seen.append([x is not None for x in self.levels])))
    suffix_dedup.dedup(tiny).count()
    assert seen[-1] == [False, True]
    assert [suffix_dedup.batches_for(n) for n in (0, 1 << 18, 1 << 20, 1 << 22)] == [3, 3, 4, 5]
