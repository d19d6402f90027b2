"""Sequence packing by minimum bin slack.

Documents stream through in chunks. Of each, whole windows are cut off and make sequences of their own; what remains
is shorter than a window. The remainders of a chunk are a multiset of lengths. Starting from the longest, a
bitset subset-sum dynamic programme finds the multiset of other lengths that fills the window closest to
its capacity; the counts are read off by backtracking and the pattern is used as often as the counts allow. Where
the closest pattern leaves slack, the slack is cut off the longest piece that waits, whose rest goes on waiting, so no window is padded. A
chunk is packed until less than a window waits. At a partition's end that makes
the last windows: powers of two, the largest first, each filled in the same way.

sequence_id is the partition in the upper bits and a running number in the lower 33. Null texts are empty
(only the end id), repeated rows are packed each, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import END_ID, column, crc32, encoder, map_arrow, text_bytes

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset that sums closest to room from below; lengths descend, counts bound them.

    Bit s of the set tells that sum s can be made. A length's copies are added in binary portions; the
    programme stops as soon as the room can be filled exactly.
    """
    whole = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, portion = min(counts[length], room // length), 1
        while left > 0:
            n = min(portion, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & whole
            left -= n
            portion *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            used[length] += n
            total -= length * n
    return sorted(used.items(), reverse=True)


def pattern(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill the window closest to its capacity; the longest that fits is among them. lengths descend."""
    first = next((x for x in lengths if x <= capacity), None)
    if first is None:
        return {}
    counts[first] -= 1
    found = defaultdict(int, {first: 1})
    for length, n in fill(lengths, counts, capacity - first):
        found[length] += n
    counts[first] += 1
    return found


class Packer:
    """Gets documents' ids, gives pieces (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, chunk: int):
        self.capacity, self.chunk = capacity, chunk
        self.waiting: dict[int, list] = defaultdict(list)
        self.held = self.tokens = self.next = 0
        self.out: list[tuple] = []
        #: ids in whole windows, in pieces that a pattern placed, and in pieces cut to fill a slack
        self.shares = [0, 0, 0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, size = len(ids), self.capacity
        whole = n - n % size
        for at in range(0, whole, size):
            self._piece(doc_id, ids[at : at + size], at, n, 0)
            self.next += 1
        self.shares[0] += whole
        if n > whole:
            self._wait(doc_id, ids if whole == 0 else ids[whole:].copy(), whole, n)
            if self.held >= self.chunk:
                self._pack(self.capacity)

    def _wait(self, doc_id, ids, start, total) -> None:
        self.waiting[len(ids)].append((doc_id, ids, start, total))
        self.held += 1
        self.tokens += len(ids)

    def _piece(self, doc_id, ids, start, total, offset) -> None:
        self.out.append((doc_id, start, len(ids), crc32(ids), total, self.next, offset))

    def _take(self, length: int) -> tuple:
        self.held -= 1
        self.tokens -= length
        return self.waiting[length].pop()

    def _pack(self, window: int) -> None:
        """Fills windows until less than one waits."""
        counts = defaultdict(int, {x: len(v) for x, v in self.waiting.items() if v})
        lengths = sorted(counts, reverse=True)
        while self.tokens >= window:
            found = pattern(lengths, counts, window)
            slack = window - sum(x * n for x, n in found.items())
            times = 1 if slack else min(counts[x] // n for x, n in found.items())
            for x, n in found.items():
                counts[x] -= n * times
            for _ in range(times):
                offset = 0
                for length, n in sorted(found.items(), reverse=True):
                    for _ in range(n):
                        doc_id, ids, start, total = self._take(length)
                        self._piece(doc_id, ids, start, total, offset)
                        offset += length
                self.shares[1] += offset
                while slack:  # what waits has slack ids at least
                    longest = next(x for x in lengths if counts[x])
                    doc_id, ids, start, total = self._take(longest)
                    counts[longest] -= 1
                    cut = min(slack, longest)
                    self._piece(doc_id, ids[:cut], start, total, offset)
                    self.shares[2] += cut
                    offset, slack = offset + cut, slack - cut
                    if cut < longest:
                        self._wait(doc_id, ids[cut:], start + cut, total)
                        counts[longest - cut] += 1
                        if longest - cut not in lengths:
                            lengths = sorted([*lengths, longest - cut], reverse=True)
                self.next += 1
            lengths = [x for x in lengths if counts[x]]

    def finish(self) -> None:
        self._pack(self.capacity)
        while self.tokens:
            self._pack(1 << (self.tokens.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, chunk: int = 2048) -> DataFrame:
    """One row per piece of docs(doc_id, text). capacity: a power of two; chunk: remainders packed together."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(capacity, chunk)
        high = TaskContext.get().partitionId() << 33
        kinds = [pa.int64()] * 7

        def emit() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * 7
            packer.out = []
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds)]
            arrays[5] = pa.array(np.array(columns[5], np.int64) + high)
            return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

        for batch in batches:
            names, texts, at = column(batch, "doc_id"), text_bytes(batch), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 4_000_000:
                    size += len(texts[to])
                    to += 1
                ids, offsets = enc.encode(texts[at:to])
                for name, a, b in zip(names[at:to], offsets.tolist(), offsets[1:].tolist()):
                    one = np.empty(b - a + 1, np.uint32)
                    one[:-1], one[-1] = ids[a:b], END_ID
                    packer.add(name, one)
                at = to
            if packer.out:
                yield emit()
        packer.finish()
        if packer.out:
            yield emit()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA, encodes=True)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
