"""What the training-data operators share: scratch folders, Arrow plumbing and cached tokenization."""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, shared_dir, ship  # noqa: F401

#: A-Z to a-z, everything that separates `[0-9a-z non-ASCII]` words to a blank.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)
END_ID = 1
#: Bytes of an Arrow batch.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, encodes: bool = False) -> DataFrame:
    """mapInArrow; a task that doesn't encode drops the pieces that earlier tasks of its worker have kept.

    Batches are held to BATCH_BYTES by the session's setting: with thousands of rows each, long texts would fill both sides' memory.
    """
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            _ENCODERS.clear()
            _give_back()
        yield from f(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Returns what a task has freed to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back by this way


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


# --- tokenization -------------------------------------------------------------------------------

_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
#: Bytes of texts that are hashed at a time, and of the longest piece that is kept.
_GROUP, _LONGEST = 1 << 20, 200


def _byte_letters() -> dict[int, int]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return {b: next(extra) for b in range(256) if b not in keep}


class TextEncoder:
    """Ids of whole texts, exactly those of the tokenizers library.

    The tokenizer never merges across white space, nor from a letter to a following full stop or
    comma, so texts are cut there. Pieces are looked up by a 64-bit hash of their lower-cased
    bytes (the tokenizer lower-cases; texts that may hold a special token skip this) and every one's bytes are then compared with the stored ones;
    a piece that is long, or differs, is encoded by itself. Each distinct
    piece is encoded once by the tokenizer and its ids are kept in flat arrays: about 40 bytes a
    piece, `limit` pieces at most, after which the store starts anew.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.limit = self.tokenizer.model, _byte_letters(), limit
        rng = np.random.Generator(np.random.PCG64(20240607))
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        table[65:91] = table[97:123]
        self.table = table
        base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
        inverse = pow(base, -1, 1 << 64)
        self.power, self.inverse = (_powers(x, _GROUP + 1) for x in (base, inverse))
        self._reset()

    def _reset(self) -> None:
        #: hashes in order, and which entry of the other arrays is each one's
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)

    def _piece(self, piece: bytes) -> list[int]:
        if piece.isalpha():
            return [t.id for t in self.model.tokenize(piece.lower().decode())]
        text = piece.decode()
        if len(piece) < _LONGEST and _PLAIN.fullmatch(text):
            return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin: len(texts) + 1 offsets."""
        parts, counts, at = [], [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) + 1 <= _GROUP):
                size += len(texts[to]) + 1
                to += 1
            if to == at + 1 and size > _GROUP or any(b"<|" in x for x in texts[at:to]):
                for x in texts[at:to]:
                    ids = self._alone(x)
                    parts.append(ids)
                    counts.append(np.array([len(ids)], np.int64))
            else:
                ids, n = self._group(texts[at:to], size)
                parts.append(ids)
                counts.append(n)
            at = to
        offsets = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum()
        return np.concatenate([np.zeros(0, np.uint32), *parts]), offsets

    def _alone(self, text: bytes) -> np.ndarray:
        """A text that may hold special tokens or is longer than a group, in stretches that end at blanks."""
        if b"<|" not in text and len(text) > _GROUP:
            out, at = [], 0
            while at < len(text):
                to = len(text) if at + _GROUP // 2 >= len(text) else max(text.rfind(x, at, at + _GROUP // 2) for x in (b" ", b"\n"))
                if to <= at:
                    to = min((x for x in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if x > 0), default=len(text))
                stretch = text[at:to]
                out.append(self.encode([stretch])[0] if len(stretch) < _GROUP else np.array(self._piece(stretch), np.uint32))
                at = to
            return np.concatenate(out)
        return np.array(self._piece(text), np.uint32)

    def _group(self, texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        blank = _IS_BLANK[data]
        letter = _IS_LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins = np.empty(len(data), bool)
        begins[0] = not blank[0]
        begins[1:] = ~blank[1:] & (blank[:-1] | (_IS_STOP[data[1:]] & letter[:-1]))
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        blanks = np.flatnonzero(blank)
        end = np.minimum(blanks[np.searchsorted(blanks, start)], np.append(start[1:], len(data)))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
        key = (sums[end] - sums[start]) * self.inverse[start]
        key ^= key >> np.uint64(29)
        size = (end - start).astype(np.int32)
        key[size > _LONGEST] = 0  # its entry holds no bytes
        distinct, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        lower = _LOWER[data]
        place = self._look_up(distinct, start[sample], end[sample], joined, lower)[inverse]
        first, count = self.first[place], self.count[place]
        # blanks belong to no piece, so the pieces' bytes are what is left of the text
        own = lower[~blank]
        equal = self.size[place] == size
        upto = size.cumsum(dtype=np.int32)
        held = np.repeat(np.where(equal, self.at[place], 0) - (upto - size), size) + np.arange(len(own), dtype=np.int32)
        differs = self.bytes[held if equal.all() else np.minimum(held, max(len(self.bytes) - 1, 0))] != own if len(self.bytes) else np.ones(len(own), bool)
        if differs.any():
            equal &= np.add.reduceat(differs, upto - size) == 0
        flat = self.flat
        if not equal.all():
            odd = np.flatnonzero(~equal)
            more = [self._piece(joined[a:b]) for a, b in zip(start[odd].tolist(), end[odd].tolist())]
            count[odd] = np.fromiter(map(len, more), np.int64, len(more))
            first[odd] = len(flat) + count[odd].cumsum() - count[odd]
            flat = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(more), np.uint32)])
        ends = count.cumsum()
        ids = flat[np.arange(ends[-1]) + np.repeat(first - (ends - count), count)]
        edges = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)).cumsum()
        upto = np.append(0, ends)[np.searchsorted(start, edges)]
        return ids, np.diff(upto, prepend=0)

    def _look_up(self, distinct: np.ndarray, start: np.ndarray, end: np.ndarray, joined: bytes, lower: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.limit or len(self.bytes) > 1 << 30:
            self._reset()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            long = end - start > _LONGEST
            ids = [[] if c else self._piece(joined[a:b]) for a, b, c in zip(start[new].tolist(), end[new].tolist(), long[new].tolist())]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            first = len(self.flat) + count.cumsum() - count
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
            size = np.where(long, 0, end - start)[new].astype(np.int32)
            upto = size.cumsum(dtype=np.int32)
            at = len(self.bytes) + upto - size
            self.bytes = np.concatenate([self.bytes, lower[np.repeat(start[new].astype(np.int32) - (upto - size), size) + np.arange(upto[-1], dtype=np.int32)]])
            slot = np.arange(len(self.first), len(self.first) + len(new), dtype=np.int32)
            self.first = np.concatenate([self.first, first])
            self.count = np.concatenate([self.count, count])
            self.at = np.concatenate([self.at, at.astype(np.int32)])
            self.size = np.concatenate([self.size, size])
            # both are sorted: the new keys go in between the others
            into = place[new] + np.arange(len(new))
            old = np.ones(len(self.keys) + len(new), bool)
            old[into] = False
            for name, values in (("keys", distinct[new]), ("slot", slot)):
                merged = np.empty(len(old), values.dtype)
                merged[old], merged[into] = getattr(self, name), values
                setattr(self, name, merged)
            place = np.searchsorted(self.keys, distinct)
        return self.slot[place]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 13, 32]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[[44, 46]] = True

_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
