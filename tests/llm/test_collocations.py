"""Phrase mining against plain Python, over several chunks, on a small table, edge cases and planted phrases."""

import re
from collections import Counter

import pytest

from parcelflow.llm import collocations


def brute(rows, support, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower):
            w = [x for x in re.split("[\\x20\\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    longer = {}
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, w[i : i + size]
                longer[key] = max(longer.get(key, 0), a)
    found = []
    for (lang, w), a in candidates.items():
        if 100 * longer.get((lang, w), 0) >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.append((lang, score, a, " ".join(w), l, r))
    out = []
    for lang in {x[0] for x in found}:
        mine = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        out += [(lang, k, w, a, l, r, n[lang], score) for k, (_, score, a, w, l, r) in enumerate(mine, 1)]
    return sorted(out)


@pytest.mark.parametrize(("name", "support", "chunk", "top"), [("tiny", 5, 30_000, 2000), ("tiny", 30, 1 << 24, 3), ("edge", 2, 200, 2000)])
def test_against_brute_force(request, name, support, chunk, top):
    docs = request.getfixturevalue(name)
    docs = docs.withColumn("lang", docs["source"]) if name == "edge" else docs
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = collocations.mine(docs.repartition(3), support, top=top, chunk_bytes=chunk).collect()
    want = brute(rows, support, top)
    assert want and sorted(tuple(r) for r in got) == want


def test_overlaps_breaks_and_clashing_columns(spark):
    """``x x x`` holds two pairs; a phrase never crosses a break; two languages keep their own counts."""
    rows = [("x x x, New York! new\tYORK.\r\nYork city", "en", 7)] * 3 + [("new york", None, 7)] * 2 + [(None, "en", 7)]
    docs = spark.createDataFrame(rows, "text string, lang string, chunk long")
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs, support=2).collect()}
    assert got["en", "new york"] == (6, 6, 9, 27, 800000)
    assert got["und", "new york"] == (2, 2, 2, 4, 1000000)
    assert ("en", "york new") not in got and ("en", "york york") not in got
    assert got["en", "x x x"][0] == 3 and got["en", "x x"][0] == 6  # 100 * 3 < 80 * 6


def test_hot_phrase_over_many_chunks(spark):
    rows = [(f"the hot phrase number {i % 3} end{i}", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    assert sorted(tuple(r) for r in collocations.mine(docs, chunk_bytes=500).collect()) == brute(rows, 30, 2000)


def test_empty(nothing):
    assert collocations.mine(nothing).count() == 0
