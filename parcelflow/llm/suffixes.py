"""Fingerprinted sparse suffixes of texts: the numeric core of suffix-array dedup.

A window is a string of LENGTH bytes.  Its anchor is the leftmost of its GRAM-byte strings with the least
hash, so equal windows have equal anchors at equal offsets.  Consecutive windows with one anchor form a
neighbourhood: the bytes from the first window's start to the last one's end.  The suffix that
starts at an anchor is ordered by the fingerprint of its first GRAM bytes, then by the fingerprint of its
neighbourhood, which decides all windows of the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH, GRAM = 100, 32
#: Bytes met at once; longer texts are cut into pieces that overlap by LENGTH - 1 bytes.
BLOCK = 1 << 19
LAST_ID = np.iinfo(np.int64).max  # stands for a null id, after all others

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWER = _powers(_MULTIPLIER, BLOCK + LENGTH + 1)
_INVERSE = _powers(pow(_MULTIPLIER, -1, 2**64), BLOCK + LENGTH + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch by one subtraction and one product."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _POWER[: len(data)], dtype=np.uint64)))


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _INVERSE[start])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def pieces(rows: list[tuple[int | None, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (id, offset in the text, bytes) in id order; texts without a window are left out."""
    block, size = [], 0
    for doc_id, text in sorted(((LAST_ID if i is None else i, t) for i, t in rows), key=lambda r: r[0]):
        for at in range(0, len(text) - LENGTH + 1, BLOCK // 2):
            piece = text[at : at + BLOCK // 2 + LENGTH - 1]
            if size + len(piece) > BLOCK:
                yield block
                block, size = [], 0
            block.append((doc_id, at, piece))
            size += len(piece)
    if block:
        yield block


def neighbourhoods(block: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """All neighbourhoods of a block: gram and whole fingerprints, id, first window ``pos``, number of windows
    ``width`` and offset ``before`` of the anchor."""
    data = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = stretch_hash(sums, at, at + GRAM)
    bits = np.uint64((1 << 20) - 1)
    anchor = (sliding_least((gram & ~bits) | at.astype(np.uint64), LENGTH - GRAM + 1) & bits).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in block])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(block)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[piece]
    own = anchor[window]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1]))))
    width = np.diff(np.append(first, len(window)))
    low, mine, of = window[first], own[first], piece[first]
    before = mine - low
    whole = stretch_hash(sums, low, low + width - 1 + LENGTH) ^ mixed((before * 256 + width).astype(np.uint64))
    ids, offsets = np.array([i for i, _, _ in block], np.int64), np.array([o for _, o, _ in block], np.int64)
    return {
        "gram": gram[mine].view(np.int64), "whole": whole.view(np.int64), "doc": ids[of], "pos": (low - begin[of] + offsets[of]).astype(np.int64),
        "width": width.astype(np.int64), "before": before.astype(np.int64),
    }


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, non-touching (start, end) rows that cover what some (start, end) rows cover."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])), axis=1)
