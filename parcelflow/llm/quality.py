"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; policies are versioned sets of rules, applied to the bits without reading texts again,
and ablations (what a policy would keep without one of its rules) are bitwise sums over the ledger.

Cases: a null or empty text has no words and fails ``few_words``; null ids keep their row; repeated
rows give repeated ledger rows; an empty table gives an empty ledger; very long texts are measured whole;
no measure depends on the order of rows, so there are no ties; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, keyed_text, rows_of

WINDOW = 8
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")
LEDGER = pa.schema([("doc_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]])

#: Rule, and the test that a document fails it, over the measurements.  The position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_words", "n_words > 10000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("few_distinct_words", "n_words >= 50 AND 20 * n_distinct_words < n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "many_words", "short_words", "long_words", "symbols", "repeated_lines", "few_distinct_words"),
}
CURRENT = "v2"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at two places or more.  ``window`` is a power of two: equal
    windows get equal numbers by pairing the numbers of their halves, without hashing."""
    if len(ids) <= window:
        return 0
    numbers, width = ids, 1
    while width < window:
        pairs = numbers[:-width] * np.int64(len(ids) + 1) + numbers[width:]
        numbers, width = np.unique(pairs, return_inverse=True)[1], 2 * width
    starts = np.flatnonzero(np.bincount(numbers)[numbers] > 1)
    if not len(starts):
        return 0
    return int(window + np.minimum(np.diff(starts), window).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text; words are runs without the six ASCII white-space characters."""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    packed = text.translate(None, SPACES)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return (
        len(words), len(packed.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(ids), len(seen),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batched(((i, *measure(t)) for i, t in rows_of(batches)), LEDGER)


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def failures() -> Column:
    """One bit per failed rule."""
    bits = F.lit(0).cast("long")
    for place, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the failed rules."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return keyed_text(docs, id_column, text_column).mapInArrow(_measured, schema).withColumn("failed", failures())


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``kept`` under a policy."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """For every policy and each of its rules: rows, kept, and kept without the rule.  Documents are first
    counted by their bits, so the work per policy does not depend on their number."""
    by_bits = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("rows"))
    cases = [(v, r, mask(rules), mask(tuple(x for x in rules if x != r))) for v, rules in POLICIES.items() for r in rules]
    each = by_bits.withColumn("case", F.explode(F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(whole).alias("whole"), F.lit(rest).alias("rest")) for v, r, whole, rest in cases
    ]))).select("case.*", "failed", "rows")
    passes = lambda bits: F.sum(F.when(F.col("failed").bitwiseAND(F.col(bits)) == 0, F.col("rows")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        F.sum("rows").alias("rows"), passes("whole").alias("kept"), passes("rest").alias("kept_without_rule")
    )
