"""Phrase collocations by relational mining of occurrences (SETM).

The relation of level k holds the occurrences (piece, position, phrase of k words).  It is kept sorted by piece
and position, a chunk of documents at a time, and stored between levels.  One level makes the next:

1. merge-join: two frequent occurrences at adjacent positions of a piece make one of k + 1 words; in sorted
   order these are neighbours.
2. group-count: each chunk counts its own phrases, and Spark adds up these counts per key, a hash of language and words.
3. semi-join: the phrases whose key reaches the support go back to their chunks, and occurrences of others leave
   the relation before it is extended.

So only keys of the distinct phrases of a chunk are shuffled for counting, and only occurrences inside frequent
phrases are carried on.  A phrase can only be frequent where both phrases of one word less are, so nothing is
lost.  Phrases that share a key can only let each other pass: what passes is counted again by its text.

Cases: a null text has no pieces; a null language is ``und``; pieces of one word count towards words alone;
ties go by count, then by phrase in the order of its bytes; repeated rows count each for themselves; an empty
table gives an empty result; very long texts are read whole; further columns of any name are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, shared_folder, stored, unpacked

SUPPORT, LONGEST, TOP = 30, 4, 2_000
#: A candidate goes when a longer one that holds it occurs at least this often per hundred of its occurrences.
COVERED = 80
SCALE = 2_000_000
CHUNK_BYTES = 12_000_000
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")

#: A chunk of a relation, of one language: words by number (-1 between pieces) and the phrase that starts at each
#: position (-1 for none; null for single words), both packed; the words, one per line; and the phrases of one word
#: less that passed, one per line, with their counts.
RELATION = pa.schema([
    ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.string()), ("ids", pa.binary()),
    ("passed", pa.string()), ("passed_counts", pa.list_(pa.int32())), ("tokens", pa.int64()), ("chunk", pa.int64()),
])
RELATION_DDL = "lang string, codes binary, words string, ids binary, passed string, passed_counts array<int>, tokens long, chunk long"
#: Bits of a key: enough that few phrases share one, few enough to travel light.
KEY_BITS = 44
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_keys(lang: str, words: list[str]) -> np.ndarray:
    head = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(head + w.encode()) for w in words), np.uint64, len(words))


def phrase_keys(keys: np.ndarray, codes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Keys of the phrases of ``length`` words that start at some positions."""
    out = np.zeros(len(first), np.uint64)
    for j in range(length):
        out = (out ^ keys[codes[first + j]]) * _STEP
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out >> np.uint64(64 - KEY_BITS)).view(np.int64)


def chunk_row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, RELATION, strict=True)], schema=RELATION)


def words_relation(docs: DataFrame, chunk_bytes: int, text_column: str, lang_column: str) -> DataFrame:
    """The relation of single words."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            place = defaultdict(dict)
            place.default_factory = lambda: defaultdict(count().__next__)
            return defaultdict(lambda: array("i")), 0, place

        def all_chunks() -> Iterator[pa.RecordBatch]:
            for lang, own in codes.items():
                found = np.frombuffer(own, np.int32)
                words = [w.decode("utf-8", "replace") for w in place[lang]]
                yield chunk_row(lang, packed(found), "\n".join(words), None, None, None, int((found >= 0).sum()), 0)

        codes, size, place = fresh()
        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                number, own = place[lang].__getitem__, text.as_py()
                for piece in _BREAK.sub(b"\n", own.lower()).split(b"\n"):
                    found = piece.split()
                    if found:
                        codes[lang].extend(map(number, found))
                        codes[lang].append(-1)
                size += len(own)
                if size >= chunk_bytes:
                    yield from all_chunks()
                    codes, size, place = fresh()
        yield from all_chunks()

    texts = docs.select(
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang")
    )
    return texts.mapInArrow(chunks, RELATION_DDL).withColumn("chunk", F.monotonically_increasing_id())


def extended(codes: np.ndarray, ids: np.ndarray, frequent: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One level further on one chunk: (codes, ids) of phrases of ``length + 1`` words.

    Positions that no frequent phrase of ``length`` words covers become breaks, and breaks in a row become one.
    """
    holds = np.zeros(int(ids.max(initial=-1)) + 2, bool)
    holds[frequent] = True
    good = holds[ids]  # -1 looks at the last place, which holds nothing
    covered = good.copy()
    for step in range(1, length):
        covered[step:] |= good[:-step]
    kept = covered.copy()
    kept[1:] |= covered[:-1]  # the first break after a covered run
    codes, ids, good = np.where(covered, codes, -1)[kept], np.where(good, ids, -1)[kept].astype(np.int64), good[kept]
    at = np.flatnonzero(good[:-1] & good[1:])
    width = int(ids.max(initial=0)) + 1
    _, inverse = np.unique(ids[at] * width + ids[at + 1], return_inverse=True)
    longer = np.full(len(codes), -1, np.int64)
    longer[at] = inverse
    return codes, longer


def phrases_of(columns: dict[str, pa.Array], k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, ids, first position and count of each phrase) of a chunk."""
    codes = unpacked(columns["codes"][k].as_py())
    ids = codes if length == 1 else unpacked(columns["ids"][k].as_py())
    at = np.flatnonzero(ids >= 0)
    counts = np.bincount(ids[at])
    first = np.zeros(len(counts), np.int64)
    first[ids[at[::-1]]] = at[::-1]  # written last, the first position of a phrase stays
    return codes, ids, first, counts


def keyed_counts(relation: DataFrame, length: int) -> DataFrame:
    """(key, chunk, id, n): every phrase of a chunk with its count there."""
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("id", pa.int32()), ("n", pa.int32())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                codes, _, first, counts = phrases_of(columns, k, length)
                keys = phrase_keys(word_keys(columns["lang"][k].as_py(), columns["words"][k].as_py().split("\n")), codes, first, length)
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    size = len(keys[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[part]), pa.array(np.full(size, columns["chunk"][k].as_py())), pa.array(np.arange(at, at + size, dtype=np.int32)), pa.array(counts[part].astype(np.int32))],
                        schema=schema,
                    )

    return relation.filter("codes IS NOT NULL").select("chunk", "lang", "codes", "words", "ids").mapInArrow(counted, "key long, chunk long, id int, n int")


def next_relation(relation: DataFrame, frequent: DataFrame, length: int, last: bool) -> DataFrame:
    """The relation of phrases of ``length + 1`` words from that of ``length`` and what passed of it (chunk, id), with the
    texts of these; the ``last`` one holds the texts alone."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                lang, words = columns["lang"][k].as_py(), columns["words"][k].as_py().split("\n")
                found = columns["found"][k].values.to_numpy(zero_copy_only=False)
                codes, ids, first, counts = phrases_of(columns, k, length)
                texts = pa.array(words)
                lines = pc.binary_join_element_wise(*[texts.take(pa.array(codes[first[found] + j])) for j in range(length)], " ")
                passed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()
                more = None, None, None
                if not last:
                    codes, longer = extended(codes, ids, found, length)
                    used = np.unique(codes[codes >= 0])
                    number = np.full(len(words) + 1, -1, np.int64)
                    number[used] = np.arange(len(used))
                    codes, words = number[codes], [words[i] for i in used.tolist()]
                    more = packed(codes), "\n".join(words), packed(longer)
                yield chunk_row(lang, *more, passed, counts[found], None, columns["chunk"][k].as_py())

    back = frequent.groupBy("chunk").agg(F.collect_list("id").alias("found"))  # one chunk's phrases
    joined = relation.select("chunk", "lang", "codes", "words", "ids").join(back, "chunk")
    return joined.mapInArrow(turned, RELATION_DDL)


def frequent_phrases(docs: DataFrame, support: int, longest: int, chunk_bytes: int, text_column: str, lang_column: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words that reach the support; and (lang, n)."""
    folder, found = shared_folder(docs.sparkSession), None
    relation = stored(words_relation(docs, chunk_bytes, text_column, lang_column), folder, "level-1")
    totals = stored(relation.groupBy("lang").agg(F.sum("tokens").alias("n")), folder, "totals")
    for length in range(1, longest + 1):
        passed = keyed_counts(relation, length).withColumn("f", F.sum("n").over(Window.partitionBy("key"))).filter(F.col("f") >= support).select("chunk", "id")
        relation = stored(next_relation(relation, passed, length, length == longest), folder, f"level-{length + 1}")
        lines = F.arrays_zip(F.split("passed", "\n").alias("phrase"), F.col("passed_counts").alias("n"))
        texts = relation.select("lang", F.inline(lines))
        exact = texts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support).select("lang", "phrase", F.lit(length).alias("k"), "f")
        exact = stored(exact, folder, f"frequent-{length}")
        found = exact if found is None else found.unionByName(exact)
    return found, totals


def part(start, size):
    return F.array_join(F.slice(F.col("w"), start, size), " ")


def mine(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, chunk_bytes: int = CHUNK_BYTES,
    text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by their lowest-scoring cut."""
    phrases, totals = frequent_phrases(docs, support, longest, chunk_bytes, text_column, lang_column)
    candidates = phrases.filter("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    left, right = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    judged = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr(f"(cast(a AS decimal(20,0)) * cast({SCALE} AS decimal(10,0))) div (l + r)")
    )
    lowest = judged.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.score", "s.a", "s.l", "s.r")
    inner = F.expr("flatten(transform(sequence(2, k - 1), size -> transform(sequence(1, k - size + 1), start -> array_join(slice(w, start, size), ' '))))")
    inside = candidates.filter("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.col("longer").cast("decimal(30,0)") * 100 >= F.col("a").cast("decimal(30,0)") * COVERED
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(~covered, F.lit(True))).drop("longer")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
