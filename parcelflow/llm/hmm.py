"""Language-model scoring with a hidden Markov model over words.

A document is its words in lower case (A-Z alone) and one end.  Latent states follow one another by a
transition matrix and each emits a symbol: a word that makes up at least ``1 / HOT`` of the training tokens is
a symbol of its own (at most HOT words can be), every other word is emitted by way of its class, the hash of its
last three bytes, and then drawn within the class by its count over the whole corpus.  The probabilities of all
words and of one unseen word per class add up to one.

Work is done on chunks of documents, bounded by bytes.  A chunk holds its distinct words once and its texts
as packed numbers of these, so what is shuffled is distinct words per chunk and not tokens: their training
counts are summed over all chunks, brought back to each chunk, and turned into symbols and base scores there.

Baum-Welch: every sweep runs over all training documents.  A task adds up the expected counts of its chunks,
and Spark adds those of the tasks, as whole numbers, so reruns agree.  Documents of a chunk of like length
advance side by side.  The recursions run on emissions relative to their mean over the states and are scaled
every RESCALE steps; means and scales together are the exact likelihood.  A document of more than
BLOCK tokens is walked in blocks that are computed again on the way back, so memory stays bounded.

Cases: a null or empty text is the end alone; a null id trains; repeated rows are rows of their own;
without training documents every class is equally likely; an empty table gives an empty result; very long
texts are read whole; further columns of any name are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, shared_folder, stored, unpacked

STATES, HOT, CLASSES, TAIL = 8, 65_536, 512, 3
SWEEPS, WARM_SWEEPS = 3, 25
CHUNK_BYTES, BLOCK, RESCALE, SEED = 8_000_000, 131_072, 8, 42
#: Pseudo counts: of a state for the overall share of symbols, and of starts and transitions.
EMIT_PRIOR, MOVE_PRIOR = 10.0, 0.1
#: Expected counts are added up as whole numbers of this fraction.
UNIT = 1 << 20
END = b""
CODED = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()),
    ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
])
CODED_DDL = "doc_ids array<long>, train array<boolean>, lengths array<long>, codes binary, words array<binary>, counts array<long>"


def training(id_column: str = "doc_id") -> Column:
    """Whether a document trains: the CRC-32 of its id as text, modulo 5, is not 1."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 != 1


def coded(docs: DataFrame, trains: Column, chunk_bytes: int, id_column: str, text_column: str) -> DataFrame:
    """Chunks of documents: ids, training flags, lengths, tokens as places in the chunk's distinct words, those
    words, and how often training documents of the chunk hold them."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, parts, place, size = [], [], [], defaultdict(), 0
        place.default_factory = place.__len__

        def chunk() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            lengths = np.array([len(p) for p in parts], np.int64)
            counts = np.bincount(codes[np.repeat(np.array(flags, bool), lengths)], minlength=len(place))
            values = (ids, flags, lengths, packed(codes), list(place), counts)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CODED, strict=True)], schema=CODED)

        for batch in batches:
            for i, text, flag in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().lower().split()
                words.append(END)
                ids.append(i)
                flags.append(flag)
                parts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                size += len(text.as_py()) + 64
                if size >= chunk_bytes:
                    yield chunk()
                    ids, flags, parts, size = [], [], [], 0
                    place.clear()
        if ids:
            yield chunk()

    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), trains.alias("trains")
    )
    return texts.mapInArrow(chunks, CODED_DDL).withColumn("chunk", F.monotonically_increasing_id())


def word_class(word: Column) -> Column:
    return (F.crc32(F.substring(word, -TAIL, TAIL)) % CLASSES).cast("int")


@dataclass(frozen=True)
class Corpus:
    """Counts of the training documents: tokens, distinct words, hot words with their counts in order of their
    bytes, and tokens and distinct words of the other words of each class."""

    tokens: int
    distinct: int
    hot: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray

    def symbol_share(self) -> np.ndarray:
        """Smoothed share of each symbol: hot words, then classes."""
        counts = np.concatenate([np.fromiter(self.hot.values(), float, len(self.hot)), self.class_tokens]) + 0.5
        return counts / counts.sum()


def counted(chunks: DataFrame, folder: str) -> tuple[DataFrame, Corpus]:
    """(chunk, place, k, c) of each distinct word of a chunk, k its class and c its count in all training documents; and
    the corpus.  The word itself is kept in one row only."""
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("word")
    found = words.withColumn("c", F.sum("n").over(same)).withColumn("first", F.min(F.struct("chunk", "place")).over(same) == F.struct("chunk", "place"))
    found = stored(found.select("chunk", "place", "c", word_class(F.col("word")).alias("k"), F.when(F.col("first"), F.col("word")).alias("word")), folder, "words")
    once = found.filter("word IS NOT NULL AND c > 0")
    tokens, distinct = once.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = F.col("c") * HOT >= tokens  # at most HOT words, as their counts add up to the tokens
    hot = {bytes(r["word"]): r["c"] for r in once.filter(frequent).select("word", "c").orderBy("word").collect()}
    sums = once.filter(~frequent).groupBy("k").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        class_tokens[r["k"]], class_words[r["k"]] = r["t"], r["v"]
    return found.select("chunk", "place", "k", "c"), Corpus(tokens, distinct, hot, class_tokens, class_words)


SYMBOLS_DDL = (
    "doc_ids array<long>, train array<boolean>, lengths array<long>, symbols binary, known array<long>, base array<double>, rare array<double>"
)
SYMBOLS = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("symbols", pa.binary()),
    ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("rare", pa.list_(pa.float64())),
])


def flat(column: pa.Array, k: int) -> np.ndarray:
    """The list of row ``k`` of a column as an array, without a copy where the type allows it."""
    return column[k].values.to_numpy(zero_copy_only=False)


def symbolised(chunks: DataFrame, words: DataFrame, corpus: Corpus) -> DataFrame:
    """Chunks with tokens as symbols; per document the known tokens, the base score, and the log10 probability of
    its rare words within their classes."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(corpus)  # at most HOT words
    hot = F.col("c") * HOT >= corpus.tokens
    rare_class = F.when(hot & (F.col("c") > 0), F.lit(-1)).otherwise(F.col("k"))
    back = words.select("chunk", F.struct("place", "c", rare_class.alias("k")).alias("w")).groupBy("chunk").agg(F.collect_list("w").alias("found"))  # one chunk's words

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        number = {w: i for i, w in enumerate(own.hot)}
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                found = columns["found"][k].values
                place = found.field("place").to_numpy(zero_copy_only=False)
                c, kind = np.empty(len(place)), np.empty(len(place), np.int64)
                c[place], kind[place] = found.field("c").to_numpy(zero_copy_only=False), found.field("k").to_numpy(zero_copy_only=False)
                symbol = np.where(kind >= 0, len(number) + kind, 0)
                words_of = columns["words"][k].values
                for at in np.flatnonzero(kind < 0).tolist():
                    symbol[at] = number[words_of[at].as_py()]
                base = np.log10((c + 0.5) / (own.tokens + 0.5 * (own.distinct + 1)))
                within = np.where(kind >= 0, np.log10((c + 0.5) / (own.class_tokens[kind] + 0.5 * (own.class_words[kind] + 1))), 0.0)
                codes, lengths = unpacked(columns["codes"][k].as_py()), flat(columns["lengths"], k)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                values = (
                    columns["doc_ids"][k].values, columns["train"][k].values, lengths, packed(symbol[codes]),
                    np.add.reduceat((c > 0)[codes].astype(np.int64), starts), np.add.reduceat(base[codes], starts), np.add.reduceat(within[codes], starts),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, f.type.value_type)) for v, f in zip(values, SYMBOLS, strict=True)],
                    schema=SYMBOLS,
                )

    joined = chunks.select("chunk", "doc_ids", "train", "lengths", "codes", "words").join(back, "chunk")
    return joined.drop("chunk").mapInArrow(turned, SYMBOLS_DDL)


@dataclass(frozen=True)
class Model:
    """Start probabilities, transitions (from, to) and emissions (symbol, state) of the states."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def drawn(cls, share: np.ndarray, states: int, seed: int = SEED) -> Model:
        """States whose emissions differ from the overall shares at random, and which tend to last."""
        noise = np.random.default_rng(seed)
        emits = share[:, None] * np.exp(noise.normal(0, 0.5, (len(share), states)))
        moves = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * 0.7
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    def refitted(self, counts: Expected, share: np.ndarray) -> Model:
        start, moves = counts.start + MOVE_PRIOR, counts.moves + MOVE_PRIOR
        emits = counts.emits + EMIT_PRIOR * share[:, None]
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


@dataclass
class Expected:
    """Expected counts of one pass."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def none(cls, model: Model) -> Expected:
        return cls(np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emits))


class Batch:
    """Documents side by side, longest first, laid out by time: at each step those that still have a token."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        steps = int(lengths[0])
        self.width = np.searchsorted(-lengths, -np.arange(steps), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.width)))
        self.symbols = np.empty(self.at[-1], np.int64)
        for i, own in enumerate(sequences):
            self.symbols[self.at[: len(own)] + i] = own

    def forward(self, emitted: np.ndarray, model: Model, prior: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """State probabilities of each token given what stands up to it, up to a factor, and what they were divided by at
        every step that scales them."""
        alpha, scales, at, moves = np.empty_like(emitted), {}, self.at.tolist(), model.moves
        now = alpha[: at[1]]
        np.multiply(emitted[: at[1]], prior, out=now)
        for t in range(1, len(at) - 1):
            low, high = at[t], at[t + 1]
            then, now = now[: high - low], alpha[low:high]
            np.matmul(then, moves, out=now)
            now *= emitted[low:high]
            if t % RESCALE == 0:
                scales[t] = now.sum(axis=1)
                now /= scales[t][:, None]
        return alpha, scales

    def backward(self, emitted: np.ndarray, model: Model, last: np.ndarray) -> np.ndarray:
        """What follows each token (beta), up to a factor."""
        beta, at, back = np.empty_like(emitted), self.at.tolist(), model.moves.T.copy()
        after = 0
        for t in range(len(at) - 2, -1, -1):
            low, high = at[t], at[t + 1]
            mine = beta[low:high]
            if after < high - low:
                mine[after:] = last
            if after:
                np.matmul(emitted[high : high + after] * beta[high : high + after], back, out=mine[:after])
                if t % RESCALE == 0:
                    mine /= mine.sum(axis=1)[:, None]
            after = high - low
        return beta

    def before(self) -> np.ndarray:
        """The place of the token before each one after the first step."""
        return np.arange(self.at[1], self.at[-1]) - np.repeat(self.width[:-1], self.width[1:]) if len(self.width) > 1 else np.zeros(0, np.int64)


def batches_of(symbols: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Chosen documents in runs of like length, longest first, of at most BLOCK tokens (or one document)."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    held, size = [], 0
    for i in sorted(np.flatnonzero(chosen).tolist(), key=lambda i: (-lengths[i], i)):
        if held and size + lengths[i] > BLOCK:
            yield held, [symbols[starts[k] : starts[k + 1]] for k in held]
            held, size = [], 0
        held.append(i)
        size += lengths[i]
    if held:
        yield held, [symbols[starts[k] : starts[k + 1]] for k in held]


def relative(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of each symbol over their mean, and the mean."""
    mean = model.emits.mean(axis=1)
    return model.emits / mean[:, None], mean


def likelihood(sequences: list[np.ndarray], model: Model, relation: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each sequence of symbols."""
    emits, mean = relation or relative(model)
    if len(sequences) == 1:  # of any length, block by block
        total, prior = 0.0, model.start
        for start in range(0, len(sequences[0]), BLOCK):
            part = Batch([sequences[0][start : start + BLOCK]])
            alpha, scales = part.forward(emits[part.symbols], model, prior)
            sums = alpha[-1].sum()
            total += np.log10(mean[part.symbols]).sum() + sum(np.log10(c[0]) for c in scales.values()) + np.log10(sums)
            prior = (alpha[-1:] / sums) @ model.moves
        return np.array([total])
    batch = Batch(sequences)
    alpha, scales = batch.forward(emits[batch.symbols], model, model.start)
    owner = np.arange(batch.at[-1]) - np.repeat(batch.at[:-1], batch.width)
    total = np.bincount(owner, np.log10(mean[batch.symbols]), len(sequences))
    for c in scales.values():
        total[: len(c)] += np.log10(c)
    ends = np.array([batch.at[len(s) - 1] for s in sequences]) + np.arange(len(sequences))
    return total + np.log10(alpha[ends].sum(axis=1))


def expect(sequences: list[np.ndarray], model: Model, out: Expected, relation: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Adds the expected counts of sequences of symbols to ``out``."""
    emits, _ = relation or relative(model)
    parts, priors = [sequences], [model.start]
    if len(sequences) == 1 and len(sequences[0]) > BLOCK:
        parts = [[sequences[0][s : s + BLOCK]] for s in range(0, len(sequences[0]), BLOCK)]
        for part in parts[:-1]:
            batch = Batch(part)
            alpha = batch.forward(emits[batch.symbols], model, priors[-1])[0][-1:]
            priors.append((alpha / alpha.sum()) @ model.moves)
    last, pulled = np.ones(len(model.start)), None
    for k in range(len(parts) - 1, -1, -1):
        batch = Batch(parts[k])
        emitted = emits[batch.symbols]
        alpha, scales = batch.forward(emitted, model, priors[k])
        beta = batch.backward(emitted, model, last)
        if pulled is not None:
            own = alpha[-1] / alpha[-1].sum()
            out.moves += np.outer(own, pulled) * model.moves
        seen = alpha * beta
        whole = seen.sum(axis=1)
        seen /= whole[:, None]
        for t, c in scales.items():
            whole[batch.at[t] : batch.at[t + 1]] *= c
        beta *= emitted
        beta /= whole[:, None]  # now the weights by which tokens pull on the states before them
        out.moves += alpha[batch.before()].T @ beta[batch.at[1] :] * model.moves
        for state, own in enumerate(np.ascontiguousarray(seen.T)):
            out.emits[:, state] += np.bincount(batch.symbols, own, len(out.emits))
        if k == 0:
            out.start += seen[: batch.at[1]].sum(0)
        pulled = beta[0]
        last = pulled @ model.moves.T


def sweep(chunks: DataFrame, model: Model) -> Expected:
    """Expected counts of all training documents: tasks add up their chunks, Spark adds up the tasks."""
    spark, states = chunks.sparkSession, len(model.start)
    sent = spark.sparkContext.broadcast(model)
    cells = [f"s{k}" for k in range(states)]
    schema = pa.schema([("row", pa.int32()), *((c, pa.int64()) for c in cells)])

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        out, relation = Expected.none(own), relative(own)
        for batch in batches:
            train, lengths, symbols = batch.columns
            for k in range(batch.num_rows):
                for _, sequences in batches_of(unpacked(symbols[k].as_py()), flat(lengths, k), flat(train, k)):
                    expect(sequences, own, out, relation)
        table = np.rint(np.concatenate([out.start[None, :], out.moves, out.emits]) * UNIT).astype(np.int64)
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(table[rows, k]) for k in range(states))], schema=schema)

    parts = chunks.select("train", "lengths", "symbols").mapInArrow(expected, "row int, " + ", ".join(f"{c} long" for c in cells))
    table = np.zeros((1 + states + len(model.emits), states))
    for r in parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in cells]).collect():  # at most one row per symbol and state
        table[r["row"]] = [r[c] / UNIT for c in cells]
    sent.destroy()
    return Expected(table[0], table[1 : 1 + states], table[1 + states :])


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])
RESULT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(chunks: DataFrame, model: Model, tokens: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    sent = chunks.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        relation = relative(own)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                lengths, score = flat(columns["lengths"], k), flat(columns["rare"], k).copy()
                for places, sequences in batches_of(unpacked(columns["symbols"][k].as_py()), lengths, np.ones(len(lengths), bool)):
                    score[places] += likelihood(sequences, own, relation)
                values = (
                    columns["doc_ids"][k].values, ~flat(columns["train"], k).astype(bool), lengths, columns["known"][k].values,
                    np.full(len(lengths), tokens), columns["base"][k].values, score,
                )
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, RESULT, strict=True)], schema=RESULT)

    return chunks.select("doc_ids", "train", "lengths", "symbols", "known", "base", "rare").mapInArrow(judged, RESULT_DDL)


def prepared(
    docs: DataFrame, trains: Column | None = None, chunk_bytes: int = CHUNK_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> tuple[DataFrame, Corpus]:
    """Chunks of symbols, in the shared folder, and the corpus they were counted in."""
    folder = shared_folder(docs.sparkSession)
    chunks = stored(coded(docs, training(id_column) if trains is None else trains, chunk_bytes, id_column, text_column), folder, "chunks")
    words, corpus = counted(chunks, folder)
    return stored(symbolised(chunks, words, corpus), folder, "symbols"), corpus


def trained(chunks: DataFrame, corpus: Corpus, states: int = STATES, sweeps: int = SWEEPS, warm_sweeps: int = WARM_SWEEPS) -> Model:
    """The model after ``warm_sweeps`` and ``sweeps``, each over all training documents."""
    share = corpus.symbol_share()
    model = Model.drawn(share, states)
    if corpus.tokens:
        for _ in range(warm_sweeps + sweeps):
            model = model.refitted(sweep(chunks, model), share)
    return model


def score(
    docs: DataFrame, trains: Column | None = None, states: int = STATES, sweeps: int = SWEEPS, warm_sweeps: int = WARM_SWEEPS,
    chunk_bytes: int = CHUNK_BYTES, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Learns from the documents that train and scores all: see ``scored`` for the columns."""
    chunks, corpus = prepared(docs, trains, chunk_bytes, id_column, text_column)
    return scored(chunks, trained(chunks, corpus, states, sweeps, warm_sweeps), corpus.tokens)
