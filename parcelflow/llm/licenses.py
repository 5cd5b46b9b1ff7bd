"""License scan with ordered signature rules.

A few hundred regular expressions, written as families (name, priority, the word that must be
present, templates) over lists of versions and variants.  A rule's pattern runs only where its keyword
occurs in the text; a template without the word of its family has the longest of its own words.  Detections overlap; one that lies within the span of a detection of higher
priority, or of equal priority and greater length, is suppressed.

Cases: a null or empty text has no words and no labels; very long texts are scanned whole; null ids
keep their row; repeated rows give repeated rows; an empty table gives an empty result; of equal spans the rule
of higher priority stays, then the label that sorts first; further columns of any name are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched, keyed_text, rows_of

#: Phrases of the base and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Family: priority, keyword, label, templates.  In a template a blank stands for any run of characters
#: between words, {v} for each version and {x} for each variant.
FAMILIES: tuple[tuple[int, str, str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    (90, "apache", "apache-{v}", ("apache license version {v}", "apache license {v}", "apache {v}", "apache software license {v}", "apache software license version {v}"), ("1.0", "1.1", "2.0"), ("",)),
    (50, "apache", "apache", ("licensed under the apache license", "apache license", "apache public license", "apache software license"), ("",), ("",)),
    (90, "mit", "mit", ("released under the mit license", "licensed under the mit license", "under the terms of the mit license", "mit license", "the mit license {x}", "mit {x} license"), ("",), ("expat", "x11", "modern", "style")),
    (80, "permission", "mit", ("permission is hereby granted free of charge to any person obtaining a copy",), ("",), ("",)),
    (90, "bsd", "bsd-{v}-clause", ("bsd {v} clause", "bsd {v} clause license", "{v} clause bsd", "{v} clause bsd license", "{x} bsd {v} clause license"), ("0", "1", "2", "3", "4"), ("new", "revised", "simplified", "original", "modified")),
    (50, "bsd", "bsd", ("bsd license", "bsd licensed", "bsd style license", "berkeley software distribution license"), ("",), ("",)),
    (80, "redistribution", "bsd", ("redistribution and use in source and binary forms with or without modification are permitted",), ("",), ("",)),
    (95, "general", "{x}-{v}", ("gnu {x} general public license version {v}", "gnu {x} general public license v {v}", "{x} general public license version {v}", "{x} general public license v{v}", "{x} gpl version {v}"), ("1", "2", "2.1", "3"), ("lesser", "library", "affero")),
    (90, "general", "gpl-{v}", ("gnu general public license version {v}", "gnu general public license v {v}", "gnu general public license v{v}", "general public license version {v}", "general public license v{v}", "general public license {v}"), ("1", "2", "3"), ("",)),
    (90, "gpl", "{x}-{v}", ("{x} v {v}", "{x} v{v}", "{x} {v}", "{x}v{v}", "{x} version {v}", "gnu {x} {v}", "gnu {x} v{v}", "gnu {x} version {v}"), ("1", "2", "2.1", "3"), ("gpl", "lgpl", "agpl")),
    (50, "general", "gpl", ("gnu general public license", "general public license"), ("",), ("",)),
    (90, "cc", "cc-{x}-{v}", ("cc {x} {v}", "licensed under cc {x} {v}", "under a cc {x} {v} license", "under cc {x} {v}"), ("1.0", "2.0", "2.5", "3.0", "4.0"), ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")),
    (70, "cc", "cc-{x}", ("cc {x}", "licensed under cc {x}"), ("",), ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")),
    (95, "cc0", "cc0", ("cc0", "cc0 1.0", "cc0 1.0 universal"), ("",), ("",)),
    (85, "creative", "cc-{x}", ("creative commons {x}", "creative commons {x} license", "creative commons {x} international license", "creative commons {x} {v}"), ("1.0", "2.0", "2.5", "3.0", "4.0"), ("attribution", "attribution sharealike", "attribution noncommercial", "attribution noderivatives", "zero")),
    (40, "creative", "cc", ("creative commons", "creative commons license"), ("",), ("",)),
    (90, "mozilla", "mpl-{v}", ("mozilla public license version {v}", "mozilla public license v {v}", "mozilla public license {v}"), ("1.0", "1.1", "2.0"), ("",)),
    (50, "mozilla", "mpl", ("mozilla public license",), ("",), ("",)),
    (90, "mpl", "mpl-{v}", ("mpl {v}", "mpl v{v}", "mpl version {v}"), ("1.0", "1.1", "2.0"), ("",)),
    (90, "eclipse", "epl-{v}", ("eclipse public license version {v}", "eclipse public license v {v}", "eclipse public license {v}"), ("1.0", "2.0"), ("",)),
    (90, "european", "eupl-{v}", ("european union public licence version {v}", "european union public licence v {v}", "european union public licence {v}"), ("1.0", "1.1", "1.2"), ("",)),
    (90, "artistic", "artistic-{v}", ("artistic license version {v}", "artistic license {v}"), ("1.0", "2.0"), ("",)),
    (90, "boost", "bsl-1.0", ("boost software license", "boost software license version 1.0"), ("",), ("",)),
    (90, "isc", "isc", ("isc license", "under the isc license"), ("",), ("",)),
    (90, "zlib", "zlib", ("zlib license", "zlib libpng license"), ("",), ("",)),
    (90, "unlicense", "unlicense", ("the unlicense", "unlicense"), ("",), ("",)),
    (90, "wtfpl", "wtfpl", ("wtfpl", "wtfpl version 2"), ("",), ("",)),
    (90, "python", "psf-{v}", ("python software foundation license version {v}", "python license {v}", "psf license {v}"), ("2", "2.0"), ("",)),
    (90, "open", "{x}", ("open font license {v}", "sil open font license {v}", "open font license version {v}"), ("1.0", "1.1"), ("ofl",)),
    (90, "open", "odc-{x}", ("open data commons {x}", "open data commons {x} license {v}"), ("1.0",), ("attribution", "odbl", "pddl")),
    (90, "open", "odc-odbl", ("open database license",), ("",), ("",)),
    (60, "public", "public-domain", ("public domain", "dedicated to the public domain", "in the public domain"), ("",), ("",)),
    (60, "reserved", "reserved", ("all rights reserved", "all rights are reserved", "some rights reserved"), ("",), ("",)),
    (30, "copyright", "copyright", ("copyright c", "copyright {v}", "copyright c {v}"), ("19[0-9][0-9]", "20[0-9][0-9]"), ("",)),
    (40, "spdx", "spdx", ("spdx license identifier",), ("",), ("",)),
    (30, "proprietary", "proprietary", ("proprietary and confidential", "proprietary license", "proprietary software"), ("",), ("",)),
    (30, "license", "unnamed", ("this work is licensed under", "this file is licensed under", "this software is licensed under"), ("",), ("",)),
    (30, "licensed", "unnamed", ("licensed under the", "licensed under a", "licensed under"), ("",), ("",)),
)

_IN = rb"[0-9a-z\x80-\xff]"
_OUT = rb"[^0-9a-z\x80-\xff]"
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_found", pa.int64()), ("n_suppressed", pa.int64()),
])


def _parts(template: str) -> list[str]:
    return re.split(r"[ .]+", template.strip())


def _pattern(template: str) -> re.Pattern[bytes]:
    """Words in order, with any run of other characters between them."""
    parts = [p.encode() if "[" in p else re.escape(p.encode()) for p in _parts(template)]
    return re.compile(rb"(?<!" + _IN + rb")" + (_OUT + rb"+").join(parts) + rb"(?!" + _IN + rb")")


def _gate(keyword: str, template: str) -> bytes:
    """What each match of the template holds: the keyword of the family, else the longest fixed word."""
    fixed = [p for p in _parts(template) if "[" not in p]
    gate = keyword if any(keyword in p for p in fixed) else max(fixed, key=len)
    assert gate and gate in template
    return gate.encode()


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[bytes, tuple[tuple[int, str, re.Pattern[bytes]], ...]], ...]:
    """Rules by keyword: (priority, label, pattern)."""
    by_keyword: dict[bytes, dict[tuple[str, str], tuple[int, str, re.Pattern[bytes]]]] = {}
    for priority, keyword, label, templates, versions, variants in FAMILIES:
        for template in templates:
            for version in versions if "{v}" in template else ("",):
                for variant in variants if "{x}" in template or "{x}" in label else ("",):
                    text = template.format(v=version, x=variant)
                    name = re.sub(r"-+$", "", label.format(v=version if "[" not in version else "", x=variant.replace(" ", "-")))
                    by_keyword.setdefault(_gate(keyword, text), {}).setdefault((text, name), (priority, name, _pattern(text)))
    return tuple((k, tuple(v.values())) for k, v in by_keyword.items())


@lru_cache(maxsize=1)
def base_patterns() -> tuple[tuple[str, bytes, re.Pattern[bytes]], ...]:
    return tuple((label, max(phrase.split(), key=len).encode(), _pattern(phrase)) for phrase, label in PHRASES)


def detections(lowered: bytes) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of every rule that matches, overlapping ones too."""
    found = []
    for keyword, group in rules():
        if keyword in lowered:
            for priority, label, pattern in group:
                found += [(m.start(), m.end(), priority, label) for m in pattern.finditer(lowered)]
    return found


def unsuppressed(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Drop detections inside one of higher priority, or of the same priority and greater length.  Spans
    are met by priority and length, so each is compared with kept ones only; kept spans lie in start order."""
    import bisect

    kept: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    reach: list[int] = []  # largest end among kept spans up to here
    for span in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        at = bisect.bisect_right(starts, span[0])
        if at and reach[at - 1] >= span[1]:
            continue
        starts.insert(at, span[0])
        kept.insert(at, span)
        reach.insert(at, max(span[1], reach[at - 1] if at else 0))
        for later in range(at + 1, len(reach)):
            if reach[later] >= span[1]:
                break
            reach[later] = span[1]
    return kept


def scan(text: bytes) -> tuple:
    """The columns of RESULT after doc_id."""
    lowered = text.lower()  # bytes: A-Z alone
    inside = _WORD[np.frombuffer(lowered, np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))) if len(inside) else np.empty(0, np.int64)
    places, base = [], set()
    for label, keyword, pattern in base_patterns():
        if keyword in lowered:
            hits = [m.start() for m in pattern.finditer(lowered)]
            places += hits
            base |= {label} if hits else set()
    found = detections(lowered)
    kept = unsuppressed(found)
    words = np.searchsorted(starts, places)
    score = 1.0 - float(np.prod([1 - p / 100 for p in {label: p for _, _, p, label in kept}.values()])) if kept else 0.0
    return (
        len(starts), len(places), int(words.min()) if places else None, int(words.max()) if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {label for *_, label in kept})), score, len(kept), len(set(found)) - len(kept),
    )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batched(((i, *scan(t)) for i, t in rows_of(batches)), RESULT)


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the columns of RESULT."""
    return keyed_text(docs, id_column, text_column).mapInArrow(
        _scanned,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_found long, n_suppressed long",
    )
