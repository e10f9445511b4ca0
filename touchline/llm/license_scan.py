"""Fuzzy search for short licence notices: exact pigeonhole seeds, then bounded-error verification.

A text is lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters; the words joined by
single spaces are what is searched. A notice with at most k edits, cut into k+1 parts, holds at least one part
unchanged; so each part is looked up as a plain substring, and around each hit the ``regex`` library's
bounded-error matching looks for the notice at word boundaries: first without edits, then in what is left between
the places found with one, and so on to k. So fewer edits go first, then what stands first, and no place is lost to a
better one beside it; each level reads a text once, however many places it has.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows each have their
row; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from touchline.llm.common import ALNUM, LOWER

# Phrases whose exact places are the base, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notices searched with errors, their labels and the edits allowed.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license", "apache", 2),
    ("mit license", "mit", 1),
    ("bsd license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
)
_CLEAN = bytes(int(c) if ALNUM[LOWER[i]] else 32 for i, c in enumerate(LOWER))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits string"


def seeds(notice: str, k: int) -> list[tuple[int, bytes]]:
    """The notice in k+1 parts of near-equal length, with their offsets."""
    n = len(notice)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _compiled(notices: tuple) -> list:
    return [(name, label, k, seeds(name, k), [regex.compile(rb"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(name.encode()), e)) for e in range(k + 1)]) for name, label, k in notices]


def fuzzy_spans(words: bytes, notices: tuple = NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) in the joined words, by start; overlapping windows of a notice are searched as one."""
    found = []
    for name, label, k, parts, levels in _compiled(notices):
        windows = []
        for offset, part in parts:
            at = words.find(part)
            while at >= 0:
                windows.append((max(0, at - offset - k - 1), at - offset + len(name) + k + 1))
                at = words.find(part, at + 1)
        windows.sort()
        i = 0
        while i < len(windows):
            a, b = windows[i]
            while i + 1 < len(windows) and windows[i + 1][0] <= b:
                i += 1
                b = max(b, windows[i][1])
            i += 1
            # whole words at both ends, so that the boundary tests see what surrounds the window
            a = words.rfind(b" ", 0, a) + 1
            b = (words.find(b" ", b) + 1 or len(words) + 1) - 1
            left = [(a, b)]
            for pattern in levels:
                rest = []
                for a, b in left:
                    for m in pattern.finditer(words, a, b) if a < b else ():
                        if m.end() > m.start():
                            found.append((m.start(), m.end(), label, sum(m.fuzzy_counts)))
                            rest.append((a, m.start() - 1))
                            a = m.end() + 1
                    rest.append((a, b))
                left = rest
    return sorted(set(found))


def scan(text: bytes, notices: tuple = NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, hits (label:start:end:edits in words) of one text."""
    words = text.translate(_CLEAN).split()
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    places, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.encode()
        at = joined.find(p)
        while at >= 0:
            end = at + len(p)
            if (at == 0 or joined[at - 1] == 32) and (end == len(joined) or joined[end] == 32):
                places.append(bisect_right(starts, at) - 1)
                base.add(label)
            at = joined.find(p, at + 1)
    fuzzy = fuzzy_spans(joined, notices)
    labels = base | {label for _, _, label, _ in fuzzy}
    score = 1.0 if base else max((1 - e / (b - a + e) for a, b, _, e in fuzzy), default=0.0)
    hits = ",".join(f"{label}:{bisect_right(starts, a) - 1}:{bisect_right(starts, b)}:{e}" for a, b, label, e in fuzzy)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, hits


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """One row per document, SCHEMA; first_word and last_word are null where no phrase stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x or b"", notices) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
