"""The hidden Markov model against plain Python: counts, base score, likelihood, one sweep, held-out gain."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelflow.llm import hmm


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def trains(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1


def word_class(word):
    return zlib.crc32(word[-3:]) % hmm.CLASSES


def brute(rows, model, hot):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base, score, by forward sums in plain Python."""
    counts = Counter(w for i, t in rows if trains(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    rare = {w: c for w, c in counts.items() if w not in hot}
    for i, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score, now = 0.0, None
        for w in own:
            if w in hot:
                emit = model.emits[hot.index(w)]
            else:
                k = word_class(w)
                same = [c for r, c in rare.items() if word_class(r) == k]
                emit = model.emits[len(hot) + k] * (counts[w] + 0.5) / (sum(same) + 0.5 * (len(same) + 1))
            now = [(model.start[s] if now is None else sum(now[r] * model.moves[r][s] for r in range(len(emit)))) * emit[s] for s in range(len(emit))]
            total = sum(now)
            score += math.log10(total)
            now = [p / total for p in now]
        yield i, not trains(i), len(own), sum(counts[w] > 0 for w in own), n, base, score


@pytest.mark.parametrize("hot", [hmm.HOT, 40])
@pytest.mark.parametrize("name", ["tiny", "edge"])
def test_scores(request, monkeypatch, name, hot):
    monkeypatch.setattr(hmm, "HOT", hot)
    docs = request.getfixturevalue(name)
    docs = docs.limit(60) if name == "tiny" else docs
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    chunks, corpus = hmm.prepared(docs.repartition(3), chunk_bytes=20_000)
    assert hot == hmm.HOT and len(corpus.hot) <= hot
    model = hmm.trained(chunks, corpus, states=3, sweeps=1, warm_sweeps=2)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in hmm.scored(chunks, model, corpus.tokens).collect()), key=key)
    want = sorted(brute(rows, model, list(corpus.hot)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)


def test_forward_and_counts_over_all_paths():
    """Likelihood and expected counts of short sequences, summed over every path of states."""
    model = hmm.Model.drawn(np.array([0.4, 0.3, 0.2, 0.1]), 3)
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), model.moves, model.emits)
    sequences = [np.array(s) for s in ([0, 1, 3, 2, 0], [2, 2, 1], [3], [1])]
    want, totals = hmm.Expected.none(model), []
    for own in sequences:
        paths = {}
        for path in itertools.product(range(3), repeat=len(own)):
            p = model.start[path[0]] * model.emits[own[0], path[0]]
            for a, b, w in zip(path, path[1:], own[1:], strict=False):
                p *= model.moves[a, b] * model.emits[w, b]
            paths[path] = p
        totals.append(math.log10(sum(paths.values())))
        for path, p in paths.items():
            share = p / sum(paths.values())
            want.start[path[0]] += share
            for a, b in itertools.pairwise(path):
                want.moves[a, b] += share
            for w, s in zip(own, path, strict=True):
                want.emits[w, s] += share
    assert np.allclose(hmm.likelihood(sequences, model), totals)
    got = hmm.Expected.none(model)
    hmm.expect(sequences, model, got)
    for part in ("start", "moves", "emits"):
        assert np.allclose(getattr(got, part), getattr(want, part))


def test_long_document_in_blocks(monkeypatch):
    model = hmm.Model.drawn(np.full(6, 1 / 6), 4)
    long = np.random.default_rng(1).integers(0, 6, 1000)
    whole, parts = hmm.Expected.none(model), hmm.Expected.none(model)
    hmm.expect([long], model, whole)
    exact = hmm.likelihood([long], model)
    monkeypatch.setattr(hmm, "BLOCK", 64)
    hmm.expect([long], model, parts)
    assert np.allclose(hmm.likelihood([long], model), exact)
    for part in ("start", "moves", "emits"):
        assert np.allclose(getattr(whole, part), getattr(parts, part))


def test_held_out_text_is_more_likely_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hmm.score(docs).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain per token, log10:", gain)
    assert gain > 0.05
    again = {r.doc_id: r.score for r in hmm.score(docs.repartition(5)).collect()}
    assert all(abs(again[r.doc_id] - r.score) <= 1e-3 * abs(r.score) for r in rows)


def test_empty(nothing):
    assert hmm.score(nothing).count() == 0


def test_every_sweep_runs_over_all_training_documents(spark, monkeypatch):
    """no sweep is left to a sample, whatever the number of tokens."""
    swept, whole = [], hmm.sweep
    monkeypatch.setattr(hmm, "sweep", lambda chunks, model: swept.append(whole(chunks, model)) or swept[-1])
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c " * 40) for i in range(4_000)], "doc_id long, text string").repartition(2)
    tokens = hmm.score(docs, states=2, sweeps=1, warm_sweeps=2).first().train_tokens
    assert tokens > 300_000 and len(swept) == 3
    assert all(np.isclose(x.emits.sum(), tokens) and np.isclose(x.start.sum(), sum(trains(i) for i in range(4_000))) for x in swept)
