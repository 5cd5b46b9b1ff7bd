"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades.  One weight vector over sparse text features serves all thresholds:
``P(grade > k) = sigmoid(score - threshold_k)`` with rising thresholds.  The verdict rests on the
expected severity, the sum of these probabilities.

Labels say toxic or not, so grades come from the labelled corpus itself: 0 for rows labelled clean; a
row labelled toxic gets 1 to GRADES - 1 by how much it holds of the terms that toxic rows hold far more
often than clean ones.  Features are words and letter sequences inside words.  Features are chosen and
the regression is fitted in one task on a bounded sample of labelled rows (FIT_ROWS).

Cases: null or empty texts have no features and the lowest severity the thresholds allow; null labels
are left out; without both labels nothing is rejected; repeated rows get equal scores; an empty table
gives an empty result; very long texts are read whole; a severity that equals the limit is not rejected; further
columns of any name are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, keyed_text, rows_of, shared_folder, stored, unit_hash

GRADES = 4
#: Bounds of the model: features kept, and labelled rows the regression is fitted on.
FEATURES = 4096
FIT_ROWS = 6_000
MIN_ROWS, MIN_RATIO = 5, 2.7
REMEMBERED = 100_000
GRAMS = (4, 5, 6, 7)
STEPS, RATE, RIDGE = 1500, 0.05, 2e-5
_WORD = re.compile(r"[^\W\d_]+")
MODEL = pa.schema([("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("thresholds", pa.list_(pa.float64())), ("limit", pa.float64())])


def word_terms(word: str) -> list[str]:
    """The word, and its distinct letter sequences of GRAMS lengths (marked, so they differ from words)."""
    return [word, *{"~" + word[i : i + size] for size in GRAMS for i in range(len(word) - size + 1)}]


def word_counts(text: bytes) -> Counter[str]:
    return Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))


class Sample:
    """Word counts of texts in arrays: every distinct word is held once, a row as numbers of words and counts."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: bytes) -> None:
        counts = word_counts(text)
        numbers = np.fromiter((self.place.setdefault(w, len(self.place)) for w in counts), np.int32, len(counts))
        self.rows.append((numbers, np.fromiter(counts.values(), np.int32, len(counts))))

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[dict[str, int]]:
        words = list(self.place)
        for numbers, counts in self.rows:
            yield {words[i]: n for i, n in zip(numbers.tolist(), counts.tolist(), strict=True)}


def frequent_terms(rows: Iterable[dict[str, int]], least: int) -> Counter[str]:
    """Terms that stand in at least ``least`` rows, with their rows.  Hashed counts leave out most others
    before any term is held."""
    rows, seen = list(rows), np.zeros(1 << 20, np.int32)
    places = lambda words: np.unique([zlib.crc32(t.encode()) & 0xFFFFF for w in words for t in word_terms(w)])
    for words in rows:
        if words:
            seen[places(words)] += 1
    found: Counter[str] = Counter()
    for words in rows:
        found.update({t for w in words for t in word_terms(w) if seen[zlib.crc32(t.encode()) & 0xFFFFF] >= least})
    return Counter({t: n for t, n in found.items() if n >= least})


def hits(counts: dict[str, int], known: dict[str, tuple[str, ...]], wanted) -> Counter[str]:
    """Occurrences of wanted terms.  ``known`` remembers, per word, its wanted terms, and starts anew when full."""
    found: Counter[str] = Counter()
    for word, n in counts.items():
        mine = known.get(word)
        if mine is None:
            if len(known) >= REMEMBERED:
                known.clear()
            mine = known[word] = tuple(t for t in word_terms(word) if t in wanted)
        for term in mine:
            found[term] += n
    return found


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text and toxic (0 or 1) of about ``fit_rows`` documents with a label, drawn by the hash of their id.  The drawn
    labels are few whatever the input, so they are sent to the documents, whose texts stay where they are."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("__id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.filter(unit_hash("__id", seed=5) < share)
    texts = keyed_text(docs)
    return texts.join(F.broadcast(drawn), texts["doc_id"] == drawn["__id"]).select("doc_id", "text", "toxic")


def vocabulary(counts: Sample | list[dict[str, int]], toxic: np.ndarray, features: int = FEATURES) -> list[str]:
    """Terms of toxic rows whose share of toxic rows exceeds a cautious estimate of their share of clean rows by
    ``exp(MIN_RATIO)``, the most telling first."""
    n_bad, n_good = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    bad = frequent_terms((words for words, y in zip(counts, toxic, strict=True) if y == 1), MIN_ROWS)
    wanted = set(bad)
    good: Counter[str] = Counter()
    known: dict[str, tuple[str, ...]] = {}
    for words, y in zip(counts, toxic, strict=True):
        if y == 0:
            good.update(hits(words, known, wanted).keys())
    shares = {t: ((bad[t] + 0.5) / (n_bad + 1), (good[t] + 3) / (n_good + 6)) for t in wanted}
    telling = {t: (b - g) * np.log(b / g) for t, (b, g) in shares.items() if b > g * np.exp(MIN_RATIO)}
    return sorted(telling, key=lambda t: (-telling[t], t))[:features]


@dataclass(frozen=True)
class Model:
    """Shared weights over terms, rising thresholds, and the expected severity from which a text is toxic."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    limit: float

    def severity(self, text: bytes, known: dict[str, tuple[str, ...]]) -> float:
        """Expected grade; ``known`` is the memory of ``hits``."""
        score = sum(self.weights[t] * value(n) for t, n in sorted(hits(word_counts(text), known, self.weights).items()))
        return float(sum(1.0 / (1.0 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds))


def value(count: int) -> float:
    """The size of a feature that occurs ``count`` times."""
    return 1.0 + np.log(count)


def fit_ordinal(x, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and thresholds by gradient steps on the mean log loss of all cumulative splits.

    ``x`` is (row, column, value) arrays with the column count.  Thresholds are a first one and positive gaps,
    so they rise; weights are never negative, so severity rises with evidence and long clean texts gain none.
    """
    row, column, amount, width = x
    n = len(grade)
    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    balance = np.where(grade > 0, n / (2 * max(1, (grade > 0).sum())), n / (2 * max(1, (grade == 0).sum())))[:, None] / n
    weights, first, gaps = np.zeros(width), 0.5, np.zeros(grades - 2)
    moment = [np.zeros(width), np.zeros(1), np.zeros(grades - 2)]
    speed = [np.zeros(width), np.zeros(1), np.zeros(grades - 2)]
    for step in range(1, STEPS + 1):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(row, amount * weights[column], n)
        p = 1.0 / (1.0 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
        off = (p - above) * balance
        by_row = off.sum(axis=1)
        by_cut = -off.sum(axis=0)
        slopes = [
            np.bincount(column, amount * by_row[row], width) + RIDGE * weights,
            np.array([by_cut.sum()]), np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:],
        ]
        moves = []
        for k, slope in enumerate(slopes):
            moment[k] = 0.9 * moment[k] + 0.1 * slope
            speed[k] = 0.99 * speed[k] + 0.01 * slope**2
            moves.append(RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(speed[k] / (1 - 0.99**step)) + 1e-8))
        weights, first, gaps = np.maximum(weights - moves[0], 0.0), first - moves[1][0], gaps - moves[2]
    return weights, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def fit(counts: Sample | list[dict[str, int]], toxic: np.ndarray, features: int = FEATURES) -> Model:
    """A model from the word counts and labels of the sample."""
    names = vocabulary(counts, toxic, features)
    if not names:
        return Model({}, (0.0,) * (GRADES - 1), float("inf"))
    place, known = {t: k for k, t in enumerate(names)}, {}
    found = [hits(words, known, place) for words in counts]
    strength = np.array([sum(value(n) for n in f.values()) for f in found])
    some = np.sort(strength[(toxic == 1) & (strength > 0)])
    cuts = [some[len(some) * k // (GRADES - 1)] for k in range(1, GRADES - 1)]
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, strength, side="right"), 0)
    entries = [(i, place[t], value(n)) for i, f in enumerate(found) for t, n in f.items()]
    row, column, amount = (np.array(c) for c in zip(*entries, strict=True))
    weights, thresholds = fit_ordinal((row, column, amount, len(names)), grade)
    score = np.bincount(row, amount * weights[column], len(found))
    severity = (1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -60, 60)))).sum(axis=1)
    return Model({t: float(w) for t, w in zip(names, weights, strict=True) if w > 1e-6}, tuple(map(float, thresholds)), limit_of(severity, toxic))


def limit_of(severity: np.ndarray, toxic: np.ndarray, most_false: float = 0.001) -> float:
    """The severity above which the share of clean rows is at most ``most_false``, and which rejects no fewer toxic
    rows than needed: half-way between the clean row at that rank and the next toxic row above it."""
    clean = np.sort(severity[toxic == 0])
    low = clean[max(0, int(np.ceil(len(clean) * (1 - most_false))) - 1)]
    above = severity[(toxic == 1) & (severity > low)]
    return float((low + above.min()) / 2) if len(above) else float("inf")


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """The model.  About ``fit_rows`` labelled rows, drawn by the hash of their id, meet in one task; only the
    weights of at most ``features`` terms reach the driver."""
    rows = stored(labelled(docs, labels, fit_rows), shared_folder(docs.sparkSession), "labelled")
    sample = rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id", "text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, toxic = Sample(), []
        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                counts.add(text.as_py())
                toxic.append(label)
        model = fit(counts, np.array(toxic, int), features)
        yield pa.RecordBatch.from_pydict({
            "terms": [list(model.weights)], "weights": [list(model.weights.values())], "thresholds": [list(model.thresholds)], "limit": [model.limit],
        }, schema=MODEL)

    got = sample.select("text", "toxic").mapInArrow(fitted, "terms array<string>, weights array<double>, thresholds array<double>, limit double").first()
    if got is None:  # no labelled rows
        return Model({}, (0.0,) * (GRADES - 1), float("inf"))
    return Model(dict(zip(got["terms"], got["weights"], strict=True)), tuple(got["thresholds"]), got["limit"])


RESULT = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int64()), ("toxic", pa.bool_())])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES - 1), grade (rounded), toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value, {}

        def rows():
            for i, text in rows_of(batches):
                severity = own.severity(text, known)
                yield i, severity, round(severity), severity > own.limit

        return batched(rows(), RESULT)

    return keyed_text(docs, id_column, text_column).mapInArrow(scored, "doc_id long, severity double, grade long, toxic boolean")


def severity(text: Column, model: Model, spark: SparkSession) -> Column:
    """Expected grade as a column, for filters that leave the rows where they are."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def expected(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[str, ...]] = {}
        return pd.Series([sent.value.severity((t or "").encode(), known) for t in texts], dtype="float64")

    return expected(F.coalesce(text.cast("string"), F.lit("")))
