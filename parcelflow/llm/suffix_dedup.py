"""Suffix-array dedup with a logarithmic family of indexes.

Texts come in batches, in id order.  A batch's sparse suffix array is its neighbourhoods (see
``suffixes``), range-sorted by fingerprint of the suffix.  It is merge-scanned against the arrays of the
existing levels: of equal neighbourhoods all but the first are repeats as a whole, and where one gram has
several neighbourhoods, windows may be shared in part, which is settled at the end on the bytes of
these few.  Levels of equal size merge: a level that holds as many batches as the new array is
taken into the same scan, and the merged array goes one level up, as in a binary counter.

A position is removed if a window that covers it starts earlier too (smaller id, or same id and
earlier start), judged on the input.  Sorting by range splits a gram that a third of all texts hold over
many tasks; a gram with very many neighbourhoods is settled window by window, with partial minima.

Cases: a null or empty text, and any text shorter than a window, keeps all its bytes; null ids come after
all others, in the order of a hash of their text; rows that share an id are parts of one document, in the
order of a hash of their texts, and equal ones are one part, so none of these is earlier than the other; an
empty table gives an empty result; very long texts are cut into overlapping pieces for hashing alone;
further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import suffixes as core
from .common import shared_folder, stored

#: Least number of batches of a bulk run, and rows from which every fourfold adds one.
BATCHES, BATCH_ROWS = 3, 1 << 18
#: Neighbourhoods of one gram that a task compares with one another.
CROWD = 4_000
#: Bits of a position inside a text; the bits above number the parts of a document.
INSIDE = 31
PARTS = 1 << (63 - 16 - INSIDE)
#: Neighbourhoods that a task combines before it hands them on.
TOGETHER = 250_000
PLACE = 16  # bits of a place below the position: eight for the width, eight for the offset of the anchor

ROW = pa.schema([("gram", pa.int64()), ("whole", pa.int64()), ("age", pa.int8()), ("doc", pa.int64()), ("place", pa.int64())])
ROW_DDL = "gram long, whole long, age byte, doc long, place long"
SCAN = pa.schema([("kind", pa.int8()), ("gram", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
SCAN_DDL = "kind byte, gram long, whole long, doc long, place long"
SPAN, REQUEST, ENTRY = 0, 1, 2
NEW, KNOWN, LOCAL = 1, 0, 2  # ages: LOCAL rows are spans that their own task has found


def document_key(doc_id: Column, text: Column) -> Column:
    """The id; for a null id a number behind all ids that depends on the text."""
    late = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(doc_id.cast("long"), late)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(document_key(F.col(id_column), text).alias("doc"), text.alias("text"), F.col(id_column).cast("long").alias("doc_id"))
    return rows.withColumn("part", F.lit(0).cast("long"))


def parted(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with different texts of one ``doc`` numbered as its parts, and their count.  Usually there are none."""
    own = F.xxhash64("text")
    per = rows.select("doc", own.alias("h")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    total, shared = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("low") != F.col("high"))).first()
    if not shared:
        return rows, total
    ids = per.filter("low <> high").select("doc")
    several = rows.join(ids, "doc", "left_semi").select("doc", own.alias("h")).distinct()
    numbered = several.withColumn("__part", F.row_number().over(Window.partitionBy("doc").orderBy("h")).cast("long") - 1).withColumnRenamed("doc", "__doc")
    most = numbered.agg(F.max("__part")).first()[0]
    if most >= PARTS:
        raise ValueError(f"one id has over {PARTS} different texts")
    joined = rows.join(numbered, (F.col("doc") == F.col("__doc")) & (own == F.col("h")), "left")
    return joined.select("doc", "text", "doc_id", F.coalesce("__part", F.lit(0)).alias("part")), total


def own_spans(spans: np.ndarray, part: int) -> np.ndarray:
    """Spans (start, end) of one part of a document, as positions in its text."""
    return spans[spans[:, 0] >> INSIDE == part] - (part << INSIDE) if len(spans) else spans


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbourhoods of (doc, text, part) rows.  Of equal ones in a task, those after the first are spans already."""
    held, count = [], 0
    for batch in batches:
        for part in _parts(batch, 512):
            docs, parts = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for block in core.pieces(list(enumerate(part.column(1).cast(pa.binary()).to_pylist()))):
                found = core.neighbourhoods(block)
                row = found["doc"]
                found["doc"], found["pos"] = docs[row], found["pos"] + (parts[row] << INSIDE)
                held.append(found)
                count += len(found["gram"])
                if count > TOGETHER:
                    yield from _combined(held)
                    held, count = [], 0
    if held:
        yield from _combined(held)


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that few rows are Python objects at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _combined(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort((x["pos"], x["doc"], x["whole"], x["gram"]))
    x = {k: v[order] for k, v in x.items()}
    first, later = _first_and_later(x["gram"], x["whole"], x["doc"], x["pos"])
    place = (x["pos"] << PLACE) | (x["width"] << 8) | x["before"]
    keep = ~later
    yield from _slices([x["gram"][keep], x["whole"][keep], np.full(keep.sum(), NEW, np.int8), x["doc"][keep], place[keep]], ROW)
    spans = _spans_by_document(x["doc"][later], x["pos"][later], x["width"][later])
    # the hash of the document spreads them; nothing else reads it
    yield from _slices([core.mixed(spans[0].view(np.uint64)).view(np.int64), spans[2], np.full(len(spans[0]), LOCAL, np.int8), spans[0], spans[1]], ROW)


def _first_and_later(gram, whole, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: those that open a run of equal (gram, whole), and those of a run that stand later than its first."""
    opens = np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]))) if len(gram) else np.empty(0, bool)
    start = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(gram) else np.empty(0, int)
    return opens, (doc != doc[start]) | (pos != pos[start])


def _spans_by_document(doc, pos, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of merged spans."""
    order = np.lexsort((pos, doc))
    doc, start, end = doc[order], pos[order], (pos + width - 1 + core.LENGTH)[order]
    if not len(doc):
        return doc, start, end
    edges = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    parts = [(d, core.merged(np.stack((s, e), axis=1))) for d, s, e in zip(doc[np.append(0, edges)], np.split(start, edges), np.split(end, edges), strict=True)]
    joined = np.concatenate([p for _, p in parts])
    return np.repeat([d for d, _ in parts], [len(p) for _, p in parts]), joined[:, 0], joined[:, 1]


def _slices(columns: list[np.ndarray], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + size], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _scan(keep: bool):
    """Merge-scan of sorted rows.  A run of one gram may continue in the neighbouring task, so the neighbourhoods at
    both ends of a task are requested in any case."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, gram_before, first_gram, several, waiting = None, None, None, False, None
        for batch in batches:
            gram, whole, age, doc, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            local = age == LOCAL
            if local.any():
                yield from _slices([np.full(local.sum(), SPAN, np.int8), gram[local], whole[local], doc[local], place[local]], SCAN)
                gram, whole, age, doc, place = (c[~local] for c in (gram, whole, age, doc, place))
            if not len(gram):
                continue
            opens = np.concatenate(([run is None or (gram[0], whole[0]) != run[:2]], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])))
            of = np.cumsum(opens) - 1
            begin = np.flatnonzero(opens)
            head_doc = doc[begin][of] if opens[0] else np.concatenate(([run[2]], doc[begin]))[of + 1]
            head_place = place[begin][of] if opens[0] else np.concatenate(([run[3]], place[begin]))[of + 1]
            later = ((doc != head_doc) | (place != head_place)) & (age == NEW)
            pos, width = place[later] >> PLACE, (place[later] >> 8) & 255
            yield from _slices([np.full(later.sum(), SPAN, np.int8), gram[later], pos + width - 1 + core.LENGTH, doc[later], pos], SCAN)
            run = (gram[-1], whole[-1], head_doc[-1], head_place[-1])
            if keep:
                yield from _slices([np.full(len(begin), ENTRY, np.int8), gram[begin], whole[begin], doc[begin], place[begin]], SCAN)
            # neighbourhoods (heads of runs) by gram; the last gram of a batch waits for what follows
            g, d, p = gram[begin], doc[begin], place[begin]
            if waiting is not None:
                g, d, p = np.concatenate((waiting[0], g)), np.concatenate((waiting[1], d)), np.concatenate((waiting[2], p))
            if not len(g):
                continue
            first_gram = g[0] if first_gram is None else first_gram
            shared = np.concatenate(([False], g[1:] == g[:-1])) | np.concatenate((g[1:] == g[:-1], [False]))
            shared |= g == first_gram
            if several and gram_before == g[0]:
                shared |= g == gram_before
            last = g == g[-1]
            tail = np.flatnonzero(last)
            ready = shared & ~last
            yield from _slices([np.full(ready.sum(), REQUEST, np.int8), g[ready], np.zeros(ready.sum(), np.int64), d[ready], p[ready]], SCAN)
            several, gram_before = bool(several and gram_before == g[-1]) or len(tail) > 1, g[-1]
            if len(tail) > 1 or several:  # all but one may go; one that stays keeps the run's name
                out = tail[:-1]
                yield from _slices([np.full(len(out), REQUEST, np.int8), g[out], np.zeros(len(out), np.int64), d[out], p[out]], SCAN)
            waiting = (g[tail[-1:]], d[tail[-1:]], p[tail[-1:]])
        if waiting is not None:
            yield from _slices([np.full(1, REQUEST, np.int8), waiting[0], np.zeros(1, np.int64), waiting[1], waiting[2]], SCAN)

    return scan


class Family:
    """The levels: ``levels[k]`` is the sorted array of ``2**k`` batches, or None."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)
        self.levels: list[DataFrame | None] = []
        self.found: list[DataFrame] = []
        self.batches = 0

    def add(self, rows: DataFrame, keep: bool = True) -> None:
        """Scan a batch of (doc, text, part) rows against all levels.  ``keep=False`` for a last batch: no array is written."""
        fresh = rows.select("doc", "text", "part").mapInArrow(_sampled, ROW_DDL)
        height = 0
        while height < len(self.levels) and self.levels[height] is not None:
            height += 1
        merging, above = self.levels[:height], [x for x in self.levels[height:] if x is not None]
        known = lambda level: level.select("gram", "whole", F.lit(KNOWN).cast("byte").alias("age"), "doc", "place")
        name = f"batch-{self.batches}"
        self.batches += 1
        union = fresh
        for level in [*merging, *above]:
            union = union.unionByName(known(level))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = union.repartitionByRange(parts, "gram", "whole").sortWithinPartitions("gram", "whole", "age", "doc", "place")
        order.mapInArrow(_scan(keep), SCAN_DDL).write.partitionBy("kind").parquet(f"{self.folder}/{name}")
        read = self.spark.read.schema(f"{SCAN_DDL.removeprefix('kind byte, ')}, kind byte").parquet(f"{self.folder}/{name}")
        self.found.append(read)
        if keep:
            entries = read.filter(F.col("kind") == ENTRY)
            if above:  # entries of the levels above stay where they are
                old = above[0].select("gram", "whole")
                for level in above[1:]:
                    old = old.unionByName(level.select("gram", "whole"))
                entries = entries.join(old, ["gram", "whole"], "left_anti")
            self.levels[:height] = [None] * height
            if height == len(self.levels):
                self.levels.append(None)
            self.levels[height] = entries.select("gram", "whole", "doc", "place")

    def rows(self, kind: int) -> DataFrame:
        out = None
        for read in self.found:
            part = read.filter(F.col("kind") == kind)
            out = part if out is None else out.unionByName(part)
        return out


LISTED = pa.schema([
    ("final", pa.bool_()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("packed", pa.binary()), ("gram", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary()), ("crowded", pa.bool_()), ("part", pa.int64()),
])
LISTED_DDL = (
    "final boolean, doc long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "packed binary, gram long, place long, bytes binary, crowded boolean, part long"
)


def cut(text: bytes, spans: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """(bytes, removed, spans, hash of what is kept, what is kept)."""
    spans = core.merged(spans[spans[:, 0] < len(text)] if len(spans) else spans)
    spans = np.minimum(spans, len(text))
    at, kept = 0, []
    for start, end in spans.tolist():
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    left = b"".join(kept)
    return len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(left).hexdigest(), left


def _pairs(column: pa.Array, k: int) -> list[np.ndarray]:
    """Per row, the list<struct<long, long>> as an array of two columns."""
    values = column.flatten()  # of this slice alone
    flat = np.stack([values.field(j).to_numpy(zero_copy_only=False) for j in range(k)], axis=1) if len(values) else np.empty((0, k), np.int64)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b].astype(np.int64) for a, b in zip(offsets, offsets[1:], strict=False)]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their whole spans: finished where nothing is requested, else packed, with the bytes of requests."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor()
    for batch in (part for whole in batches for part in _parts(whole, 256)):
        at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        spans, wanted = _pairs(at["spans"], 2), _pairs(at["requests"], 3)
        out: list[tuple] = []
        for doc, doc_id, part, packed, mine, asked in zip(*(at[c].to_pylist() for c in ("doc", "doc_id", "part", "packed")), spans, wanted, strict=True):
            text, mine = unpack.decompress(packed), own_spans(mine, part)
            asked = asked[asked[:, 1] >> PLACE + INSIDE == part]
            if not len(asked):
                out.append((True, doc, doc_id, *cut(text, mine)[:4], None, None, None, None, None, part))
            else:
                out.append((False, doc, doc_id, len(mine), None, None, None, pack.compress(mine.tobytes() + text), None, None, None, None, part))
                for gram, place, crowded in asked.tolist():
                    pos, width = (place >> PLACE) - (part << INSIDE), place >> 8 & 255
                    out.append((None, doc, None, None, None, None, None, None, gram, place, text[pos : pos + width - 1 + core.LENGTH], bool(crowded), None))
            if len(out) >= 1000:
                yield _batch_of(out, LISTED)
                out = []
        if out:
            yield _batch_of(out, LISTED)


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SETTLED = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, doc, place, bytes) sorted by gram: windows of one gram that start earlier in another neighbourhood.
    Grams are settled together once some thousand rows have come; no gram has more than the crowd's rows."""
    held: list[tuple[int, int, int, bytes]] = []
    for batch in batches:
        for part in _parts(batch, 1024):
            held += zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)
            if len(held) > 2048 and held[0][0] != held[-1][0]:
                last = held[-1][0]
                cut_at = next(k for k in range(len(held) - 1, -1, -1) if held[k][0] != last) + 1
                yield from _settle(held[:cut_at])
                held = held[cut_at:]
    if held:
        yield from _settle(held)


def _settle(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    columns: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(held), 2048):  # neighbourhoods of under 200 bytes, so a block holds them
        some = held[at : at + 2048]
        gram, doc, place = (np.array([r[k] for r in some], np.int64) for k in range(3))
        width, sizes = (place >> 8) & 255, np.array([len(r[3]) for r in some])
        sums = core.prefix_sums(np.frombuffer(b"".join(r[3] for r in some), np.uint8))
        inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        start = np.repeat(np.cumsum(sizes) - sizes, width) + inside
        window = core.stretch_hash(sums, start, start + core.LENGTH).view(np.int64)
        columns.append((np.repeat(gram, width), window, np.repeat(doc, width), np.repeat(place >> PLACE, width) + inside))
    gram, window, doc, pos = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.lexsort((pos, doc, window, gram))
    gram, window, doc, pos = gram[order], window[order], doc[order], pos[order]
    _, later = _first_and_later(gram, window, doc, pos)
    if later.any():
        yield from _slices(list(_spans_by_document(doc[later], pos[later], np.ones(later.sum(), np.int64))), SETTLED)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of crowded neighbourhoods: (doc, start, window)."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("window", pa.binary())])
    for batch in batches:
        for doc, place, data in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            width = place >> 8 & 255
            yield _batch_of([(doc, (place >> PLACE) + k, data[k : k + core.LENGTH]) for k in range(width)], schema)


FINISHED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finished(with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in _parts(whole, 512)):
            more = _pairs(batch.column(4), 2)
            out = []
            for doc_id, n, packed, part, late in zip(*(batch.column(k).to_pylist() for k in range(4)), more, strict=True):
                whole = unpack.decompress(packed)
                mine, text = np.frombuffer(whole[: 16 * n], np.int64).reshape(-1, 2), whole[16 * n :]
                *row, kept = cut(text, np.concatenate((mine, own_spans(late, part))))
                out.append((doc_id, *row, kept if with_text else None))
            if out:
                yield _batch_of(out, FINISHED)

    return finish


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor()
    for batch in (part for whole in batches for part in _parts(whole, 512)):
        texts = [pack.compress(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2), batch.column(3)], names=["doc", "packed", "doc_id", "part"])


def in_batches(rows: DataFrame, batches: int) -> list[DataFrame]:
    """Rows by ranges of ``doc`` of about equal count."""
    if batches < 2:
        return [rows]
    cuts = rows.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10_000).alias("c")).first()["c"] or []
    bounds = [None, *sorted(set(cuts)), None]
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.filter(F.col("doc") > low)
        out.append(part if high is None else part.filter(F.col("doc") <= high))
    return out


def batches_for(rows: int) -> int:
    """Batches of a bulk run: enough that levels merge, and more as the input grows."""
    return BATCHES + max(0, (max(1, rows // BATCH_ROWS).bit_length() - 1) // 2)


def dedup(
    docs: DataFrame, batches: int | None = None, crowd: int = CROWD, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row, and ``kept`` (the remaining bytes) if asked for."""
    spark = docs.sparkSession
    family = Family(spark)
    rows, total = parted(keyed(docs, id_column, text_column))
    parts = in_batches(rows, batches_for(total) if batches is None else batches)
    for k, part in enumerate(parts):
        family.add(part, keep=k + 1 < len(parts))
    spans = family.rows(SPAN).groupBy("doc").agg(F.collect_list(F.struct(F.col("place").alias("start"), F.col("whole").alias("end"))).alias("spans"))
    asked = family.rows(REQUEST).select("gram", "doc", "place").distinct()
    crowds = asked.groupBy("gram").agg((F.count(F.lit(1)) > crowd).alias("crowded")).filter("crowded")
    asked = asked.join(crowds, "gram", "left").select("doc", F.struct("gram", "place", F.coalesce("crowded", F.lit(False)).cast("long").alias("crowded")).alias("r"))
    requests = asked.groupBy("doc").agg(F.collect_list("r").alias("requests"))  # at most a few per hundred bytes of the document
    texts = rows.mapInArrow(_packed, "doc long, packed binary, doc_id long, part long")
    joined = texts.join(spans, "doc", "left").join(requests, "doc", "left").select(
        "doc", "doc_id", "part", "packed", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("requests", F.array().cast("array<struct<gram:long,place:long,crowded:long>>")).alias("requests"),
    )
    if with_text:
        joined = joined.withColumn("requests", F.when(F.size("requests") > 0, F.col("requests")).otherwise(F.array(F.struct(F.lit(0).alias("gram"), F.shiftleft(F.col("part"), INSIDE + PLACE).alias("place"), F.lit(0).alias("crowded")).cast("struct<gram:long,place:long,crowded:long>"))))
    folder = shared_folder(spark)
    listed = stored(joined.mapInArrow(_listed, LISTED_DDL), folder, "listed")
    wanted = listed.filter("final IS NULL").select("gram", "doc", "place", "bytes", "crowded").distinct()
    settled = (
        wanted.filter("NOT crowded").select("gram", "doc", "place", "bytes").repartition("gram").sortWithinPartitions("gram", "doc", "place")
        .mapInArrow(_settled, "doc long, start long, end long")
    )
    single = wanted.filter("crowded").select("gram", "doc", "place", "bytes").mapInArrow(_windows, "doc long, start long, window binary")
    least = single.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("least"))
    crowded = single.join(least, "window").filter(F.struct("doc", "start") > F.col("least")).select("doc", "start", (F.col("start") + core.LENGTH).alias("end"))
    late = settled.unionByName(crowded).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("late"))
    pending = listed.filter("NOT final").select("doc", "doc_id", "n_bytes", "packed", "part").join(late, "doc", "left").select(
        "doc_id", "n_bytes", "packed", "part", F.coalesce("late", F.array().cast("array<struct<start:long,end:long>>")).alias("late")
    )
    finished = pending.mapInArrow(_finished(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = listed.filter("final").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = done.unionByName(finished)
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")
