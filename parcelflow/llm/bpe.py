"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of the encoding of a prefix is enough to know the encoding: it is the one token that
ends the prefix and may follow the last token of what stands before it.  Distinct words, in sorted
order, are met as a depth-first walk of their trie; the walk keeps the last-token state of every
prefix on its path, so the states of a prefix shared by many words are computed once.

Two tokens may stand side by side when the merges turn their joined symbols into exactly these two;
that is decided by the merges themselves and remembered.

Normalisation and the split into words are the tokenizer file's own.  Text is cut at ASCII white
space first, which neither of them crosses, so both run once per distinct piece and not per document.

Cases: a null or empty text has no tokens and decodes to the empty text; very long words are walked
in linear time; special tokens written in a text get their own id, as the library gives them; null
ids keep their row; repeated rows give repeated rows; an empty table gives an empty result; further columns of
any name are not read.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, rows_of

#: What a task may remember: bytes of pieces with their ids, and token pairs; beyond that the memory starts anew.
PIECE_BYTES, PIECE_COST = 96_000_000, 200
PAIRS = 800_000
OUT_BYTES = 2_000_000
RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Merges:
    """Vocabulary and merge ranks of a tokenizer file whose words end in a suffix."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        if model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level merges without unknown tokens, byte fallback or prefixes are supported")
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        ends = {t[: -len(self.suffix)]: t for t in self.ids if self.suffix and t.endswith(self.suffix)}
        self.inner = {t: t for t in self.ids if not (self.suffix and t.endswith(self.suffix))}
        self.final = ends if self.suffix else self.inner
        self.endings = {t[k:] for t in self.inner for k in range(len(t))}
        self.final_endings = {t[k:] for t in self.final for k in range(len(t))}
        self.parts = {"".join(pair): pair for pair in self.rank}
        self.follows: dict[str, dict[str, bool]] = {}
        self.remembered = 0
        self.edges: dict[tuple[str, int], list[tuple[float, str]]] = {}

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix]
        return list(token)

    def stands_alone(self, token: str) -> bool:
        """Whether the merges turn the token's own symbols into the token."""
        symbols = self.symbols(token)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: self.rank.get((symbols[k], symbols[k + 1]), len(self.rank)))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                return False
            symbols[best : best + 2] = ["".join(pair)]
        return symbols == [token]

    def edge(self, token: str, side: int) -> list[tuple[float, str]]:
        """The first (side 0) or last (side 1) symbol while the token is being merged: (rank of the merge
        that made it, symbol), from single symbol to the token."""
        if (token, side) not in self.edges:
            inside = self.edge(self.parts[token][side], side) if token in self.parts else []
            self.edges[token, side] = [*inside, (self.rank[self.parts[token]] if token in self.parts else -1, token)]
        return self.edges[token, side]

    def meets(self, left: str, right: str) -> bool:
        """Whether no merge ever crosses the border of two tokens that stand side by side.  Merges happen in
        rank order, at equal rank from the left, and only those that change the symbols at the border count."""
        ends, starts, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            next_left = ends[i + 1][0] if i + 1 < len(ends) else len(self.rank)
            next_right = starts[j + 1][0] if j + 1 < len(starts) else len(self.rank)
            across = self.rank.get((ends[i][1], starts[j][1]), len(self.rank))
            if across < next_left and across <= next_right and across < len(self.rank):
                return False
            if next_left == next_right == len(self.rank):
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def last_token(self, word: str, end: int, tokens: dict[str, str], endings: set[str], states: list[str]) -> str:
        """The last token of ``word[:end]``; ``states[k]`` is the last token of ``word[:k]``, "" for none."""
        start, found = end - 1, []
        while start >= 0 and (tail := word[start:end]) in endings:
            if tail in tokens:
                found.append((tokens[tail], states[start]))
            start -= 1
        for token, before in reversed(found):
            known = self.follows.get(token)
            if known is None:
                known = self.follows[token] = {"": self.stands_alone(token)}
            fits = known.get(before)
            if fits is None:
                fits = known[before] = known[""] and self.meets(before, token)
                self.remembered += 1
            if fits:
                return token
        raise ValueError(f"no token ends {word[max(0, end - 40):end]!r}")

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """(word, token ids) of distinct words, in sorted order: a depth-first walk of their trie."""
        if self.remembered > PAIRS:
            self.follows.clear()
            self.remembered = 0
        states: list[str] = [""]
        path = ""
        for word in sorted(words):
            shared, last = 0, len(word) - 1
            for a, b in zip(path, word):  # noqa: B905 - the shorter one ends it
                if a != b:
                    break
                shared += 1
            del states[min(shared, last) + 1 :]
            for end in range(len(states), len(word)):
                states.append(self.last_token(word, end, self.inner, self.endings, states))
            path = word[:-1]
            token, out = self.last_token(word, len(word), self.final, self.final_endings, states), []
            at = len(word) - len(token) + len(self.suffix)
            out.append(self.ids[token])
            while at:
                token = states[at]
                out.append(self.ids[token])
                at -= len(token)
            yield word, tuple(out[::-1])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable and no blank, else
    the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes white-space separated pieces, remembering what it has met."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        described = json.loads(content)
        self.library = Tokenizer.from_str(content)
        self.merges = Merges(described["model"])
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.token = {i: t for t, i in {**self.merges.ids, **self.special}.items()}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.held = 0
        splits = described["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.bytes = str.maketrans({i: c for i, c in enumerate(byte_characters())})

    def segments(self, piece: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens with None, and special tokens with their id."""
        while piece:
            found = min(((at, -len(s), s) for s in self.special if (at := piece.find(s)) >= 0), default=None)
            if found is None:
                yield piece, None
                return
            if found[0]:
                yield piece[: found[0]], None
            yield found[2], self.special[found[2]]
            piece = piece[found[0] - found[1] :]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the characters that stand for bytes.  The
        library's own steps are taken outside Latin letters; within, they come to the same."""
        normal = text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)
        if not normal:
            return []
        if max(normal) < "\u0250":
            if normal.isascii() and normal.isprintable():
                return [normal] if normal.isalpha() else self.pattern.findall(normal)
            return [w.encode().decode("latin-1").translate(self.bytes) for w in self.pattern.findall(normal)]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if w]

    def learn(self, pieces: set[bytes]) -> None:
        simple, mixed = {}, {}
        for piece in pieces:
            text = piece.decode("utf-8", "replace")
            if "<" in text:
                mixed[piece] = [(w, i) for s, i in self.segments(text) for w in ([s] if i is not None else self.words(s))]
            else:
                simple[piece] = self.words(text)
        words = set(chain.from_iterable(simple.values()))
        words.update(w for parts in mixed.values() for w, i in parts if i is None)
        ids = dict(self.merges.walk(words))
        for piece, parts in simple.items():
            self.pieces[piece] = ids[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([ids[w] for w in parts]))
        for piece, parts in mixed.items():
            self.pieces[piece] = tuple(chain.from_iterable((i,) if i is not None else ids[w] for w, i in parts))
        self.held += sum(PIECE_COST + len(piece) + 8 * len(self.pieces[piece]) for piece in pieces)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """The token ids of each text."""
        split = [t.split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.pieces)
        if new and self.held > PIECE_BYTES:
            self.pieces.clear()
            self.held = 0
            new = set(chain.from_iterable(split))
        if new:
            self.learn(new)
        known = self.pieces.__getitem__
        return [list(chain.from_iterable(map(known, parts))) for parts in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, as the library joins them for a file that names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))


def groups(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, bytes]]]:
    """Rows in runs of about ``OUT_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > OUT_BYTES or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids) and decoded (the text that the ids decode to).

    ``path`` names the tokenizer file where the driver runs; its content (a few MB) travels with the job.
    """
    with open(path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(content.value)  # one per task: the worker lives on, and what this task remembers must not
        gc.disable()  # what is remembered holds no cycles, and scanning it again and again is slow
        try:
            for group in groups(rows_of(batches)):
                encoded = own.encode([t for _, t in group])
                offsets = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
                values = np.fromiter(chain.from_iterable(encoded), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in group], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(map(own.decode, encoded), pa.string())],
                    schema=RESULT,
                )
        finally:
            gc.enable()

    return keyed_text(docs, id_column, text_column).mapInArrow(coded, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode_decode`` returns."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
