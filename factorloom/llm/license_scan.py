"""License scan: exact notice phrases, and short notices with edits.

A text is brought to words (`[0-9a-z non-ASCII]` runs of the ASCII-lower-cased text, joined by one
blank). Exact phrases are found in that. For up to k edits, a notice is split into k + 1 pieces: by
the pigeonhole principle one piece occurs unchanged in any match, so the pieces are the seeds whose
places name the candidate windows; the regex library's bounded-error matching then verifies a window
and reports the span and the number of edits.

Null and empty texts have no words, no labels and score 0. Rows are independent: repeated ids give
repeated rows, empty tables give none, other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WORD_TABLE, column, map_arrow, text_bytes

#: phrase, label: found as whole consecutive words.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: notice, label, most edits: characters of the notice inserted, deleted or replaced.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("released under the mit license", "mit", 3),
    ("licensed under cc by", "cc-by", 2),
    ("licensed under the bsd license", "bsd", 2),
    ("mozilla public license", "mpl", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("creative commons attribution", "cc-by", 3),
)
_BLANK = re.compile(b" ")
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start_word:long,end_word:long,edits:int>>"
)


class Notice:
    def __init__(self, text: str, label: str, edits: int):
        self.text, self.label, self.edits = text.encode(), label, edits
        n = len(self.text)
        cuts = [i * n // (edits + 1) for i in range(edits + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.match = regex.compile(b"(?e)(?:" + regex.escape(self.text) + b"){e<=" + str(edits).encode() + b"}")

    def windows(self, words: bytes) -> list[tuple[int, int]]:
        """Merged stretches that hold every occurrence with at most `edits` edits."""
        found, n = [], len(self.text) + self.edits
        for seed, offset in self.seeds:
            at = words.find(seed)
            while at >= 0:
                found.append((max(0, at - offset - self.edits), min(len(words), at - offset + n)))
                at = words.find(seed, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged]

    def find(self, words: bytes) -> list[tuple[int, int, int]]:
        """Start, end and edits of the matches, best ones first come in each stretch."""
        out = []
        # A piece of a few letters is common in prose; only stretches with a second seed close by
        # can still be within the bound, as each lost seed costs an edit.
        for a, b in self.windows(words):
            stretch = words[a:b]
            lost = sum(seed not in stretch for seed, _ in self.seeds)
            if lost > self.edits:
                continue
            for m in self.match.finditer(stretch):
                if m.end() > m.start():
                    out.append((a + m.start(), a + m.end(), sum(m.fuzzy_counts)))
        return out


def scan(text: bytes, phrases: list[tuple[bytes, str]], notices: list[Notice]) -> dict:
    words = text.translate(WORD_TABLE).split()
    joined = b" " + b" ".join(words) + b" "
    places, base, spans, score = [], set(), [], 0.0
    ends: list[int] = []  # places of the blanks, once a match asks for word numbers

    def blanks(at: int) -> int:
        """Blanks before a place."""
        if not ends:
            ends.extend(m.start() for m in _BLANK.finditer(joined))
        return bisect.bisect_left(ends, at)

    for phrase, label in phrases:
        at = joined.find(phrase)
        while at >= 0:
            first = blanks(at)
            places.append(first)
            base.add(label)
            spans.append((label, first, first + phrase.count(b" ") - 1, 0))
            at = joined.find(phrase, at + 1)
            score = 1.0
    labels = set(base)
    for notice in notices:
        for a, b, edits in notice.find(joined):
            labels.add(notice.label)
            score = max(score, 1 - edits / len(notice.text))
            first = blanks(a) - (joined[a : a + 1] != b" ")
            last = blanks(b) - 1 - (joined[b - 1 : b] == b" ")
            spans.append((notice.label, first, last, edits))
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
        "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
        "score": score,
        "spans": [dict(zip(("label", "start_word", "end_word", "edits"), x)) for x in sorted(set(spans))],
    }


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of docs(doc_id, text); see the module for what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        fuzzy = [Notice(*x) for x in notices]
        for batch in batches:
            rows = [{"doc_id": i} | scan(t, exact, fuzzy) for i, t in zip(column(batch, "doc_id"), text_bytes(batch))]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])))]
)
