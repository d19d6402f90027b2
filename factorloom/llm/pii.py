"""Personal data: exact patterns, and a character-level BiLSTM-CRF for what they miss.

Base spans come from the patterns (leftmost, non-overlapping, per kind; failing matches are dropped). The tagger is trained on
other spellings too: national and dotted phone numbers, addresses with "[at]" and "dot", IP addresses of version 6 or with
bracketed dots, cards with other separators. It
reads the text around every digit, "@", bracketed "at" and "dot" (each kind has one of them, so other text can hold no
span of it) in overlapping windows. A window's spans count if their middle lies in the window's core, so each
place is decided by the window that sees most around it; the cores tile the text. Spans of all windows
are then reconciled over the whole text: they must be possible for their kind (parts of an IP address at most 255, a card's check
digit, a phone's number of digits), longer ones go first,
and none may overlap a base span or one another. Weights are trained once per process, from generated labelled spans.

Null and empty texts have no spans. Rows are independent: repeated ids give repeated rows, an empty table
none; other columns are ignored by find() and kept by redact(). Offsets count code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .common import column, map_arrow

KINDS = tagger.KINDS
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits that fails from its first one fails from every other: it is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]+|[\[(](?:at|dot)[\])]| dot ")
_NOT_DIGIT = re.compile(r"[^0-9]+")
WINDOW, CORE, AROUND = 96, 48, 24
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # kind, start, end


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        # a run of address characters without an "@" behind it costs its length once, not at each place
        out += [(0, *m.span()) for m in _emails(text)]
    if _HOT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and tagger.luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")


def _emails(text: str) -> Iterator[re.Match]:
    """The leftmost, non-overlapping matches of the address pattern; tried only where a run of local characters meets an "@"."""
    at, end = text.find("@"), 0
    while at >= 0:
        low = at
        while low > end and _LOCAL.fullmatch(text, low - 1, low):
            low -= 1
        m = _EMAIL.match(text, low) if low < at else None
        if m:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end if m else 0))


def _octets(parts: list[str]) -> bool:
    return all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in parts)


def windows(text: str) -> list[int]:
    """Starts of the windows that see all of the text around what every kind has; cores begin CORE / 2 behind."""
    out: list[int] = []
    for m in _HOT.finditer(text):
        low = (m.start() - AROUND + CORE // 2) // CORE
        high = (m.end() - 1 + AROUND + CORE // 2) // CORE
        out.extend(range(max(low, out[-1] + 1 if out else low), high + 1))
    return [CORE * i - CORE // 2 - (WINDOW - CORE) // 2 for i in out]


_AT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*|\s+(?:dot|\.)\s+|\.", re.I)
_PLAIN_AT = re.compile(r"\s+at\s+", re.I)
_SIX = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_NUMBER = re.compile(r"\+?\(?[0-9][\x20()./0-9-]*[0-9]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}.*")


def well_formed(kind: int, piece: str) -> bool:
    """Whether a piece can be what its kind says; the spelling is the tagger's affair."""
    digits = _NOT_DIGIT.sub("", piece)
    if kind == 0:
        plain, dotted = _DOT.sub(".", _AT.sub("@", piece)), re.search(r"[\s\[(]dot[\s\])]", piece, re.I)
        return len(piece) < WINDOW and bool(_EMAIL.fullmatch(plain)) and plain[-1].isalpha() and not (_PLAIN_AT.search(piece) and not dotted)
    if kind == 1:
        if ":" in piece:
            groups = piece.split(":")
            return bool(_SIX.fullmatch(piece)) and piece.count("::") < 2 and (len(groups) == 8 or "::" in piece) and sum(map(bool, groups)) > 1 and ":::" not in piece
        parts = _DOT.sub(".", piece).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts) and _octets(parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[\x20./_-]{0,3}[0-9])+", piece)) and 13 <= len(digits) <= 19 and tagger.luhn(digits)
    if not _NUMBER.fullmatch(piece) or not 9 <= len(digits) <= 15 or _DATE.fullmatch(piece) or piece.count("(") != piece.count(")"):
        return False
    return piece[0] in "+(0" or re.fullmatch(r"(?:1[-. ])?[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}", piece) is not None


class Finder:
    def __init__(self, weights: tagger.Weights):
        self.weights = weights

    def added(self, texts: list[str], base: list[list[Span]], at_once: int = 4096) -> list[list[Span]]:
        """The tagger's spans of each text, reconciled with its base spans."""
        found: list[list[Span]] = [[] for _ in texts]
        queue: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            queue += [(k, s) for s in windows(text)]
            if len(queue) >= at_once:
                self._tag(texts, queue, found)
                queue = []
        self._tag(texts, queue, found)
        return [_reconcile(text, f, b) for text, f, b in zip(texts, found, base)]

    def _tag(self, texts: list[str], queue: list[tuple[int, int]], found: list[list[Span]]) -> None:
        cache: tuple[int, np.ndarray] | None = None
        for lot in range(0, len(queue), 2048):
            part = queue[lot : lot + 2048]
            codes = np.full((len(part), WINDOW), 0, np.int16)
            codes[:] = 5 + tagger._SPECIAL.index("\n")
            for row, (k, start) in enumerate(part):
                if cache is None or cache[0] != k:
                    cache = (k, tagger.classes(texts[k]))
                low, high = max(start, 0), min(start + WINDOW, len(texts[k]))
                codes[row, low - start : high - start] = cache[1][low:high]
            tags = tagger.decode(tagger.emissions(np.ascontiguousarray(codes.T), self.weights), self.weights).T
            # begins of spans, and the first place behind each that is not inside it
            for row, at in zip(*np.nonzero(tags % 2 == 1)):
                tag, end = tags[row, at], at + 1
                while end < WINDOW and tags[row, end] == tag + 1:
                    end += 1
                middle = (at + end) // 2
                if (WINDOW - CORE) // 2 <= middle < (WINDOW + CORE) // 2:
                    k, start = part[row]
                    found[k].append(((int(tag) - 1) // 2, start + int(at), min(start + int(end), len(texts[k]))))


def _reconcile(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    taken, out = _merged(sorted((s, e) for _, s, e in base)), []
    for kind, start, end in sorted(set(found), key=lambda x: (x[1] - x[2], x)):
        while end > start and text[end - 1] in " .,:-(\n":
            end -= 1
        while start < end and text[start] in " .,:-)\n":
            start += 1
        # a span within a longer run of letters or digits is part of something else
        if start > 0 and end > start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and end > start and text[end].isalnum() and text[end - 1].isalnum():
            continue
        if end <= start:
            continue
        at = bisect.bisect_left(taken, (start, end))
        if at < len(taken) and taken[at][0] < end or at and taken[at - 1][1] > start or not well_formed(kind, text[start:end]):
            continue
        taken.insert(at, (start, end))
        out.append((kind, start, end))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the sorted ones."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _spans(batch: pa.RecordBatch, finder: Finder) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """Row, text, base and added spans of the rows that may hold any."""
    texts = {i: t for i, t in enumerate(column(batch, "text")) if t and _HOT.search(t)}
    base = [base_spans(t) for t in texts.values()]
    for (i, t), b, a in zip(texts.items(), base, finder.added(list(texts.values()), base)):
        yield i, t, b, a


def find(docs: DataFrame, weights: tagger.Weights | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): counts and hash of the base spans, and all spans."""
    weights = weights or tagger.train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, none = Finder(weights), hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
            for i, _, base, added in _spans(batch, finder):
                for kind, _, _ in base:
                    counts[kind, i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(base + added)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=_NAMES)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def redact(docs: DataFrame, weights: tagger.Weights | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars, where there is one, follows."""
    weights = weights or tagger.train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(weights)
        for batch in batches:
            changed: dict[int, str] = {}
            for i, text, base, added in _spans(batch, finder):
                out, upto = [], 0
                for start, end, kind in sorted((s, e, k) for k, s, e in base + added):
                    if end > upto:
                        out.append(text[upto : max(start, upto)])
                        if start >= upto:
                            out.append(f"[{KINDS[kind].upper()}]")
                        upto = end
                if upto:
                    changed[i] = "".join(out) + text[upto:]
            if changed:
                for name, new in (("text", lambda t: t), ("n_chars", len)):
                    at = batch.schema.get_field_index(name)
                    if at >= 0:
                        values = batch.column(at).to_pylist()
                        for i, t in changed.items():
                            values[i] = new(t)
                        batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return map_arrow(docs, run, docs.schema)
