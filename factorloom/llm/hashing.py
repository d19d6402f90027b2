"""Vectorised 64-bit hashes of the words of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_GROUP = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(77))
#: Per byte: a random odd number, the same for either case of a letter.
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 5
#: 0 for white space, 1 for letters, digits and all bytes beyond ASCII, 2 for the rest.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size, out = max(n, _GROUP) + 1, []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _stretches(text: bytes) -> Iterator[bytes]:
    """Pieces of a long text that end at blanks, each of bounded size unless a word is longer."""
    at = 0
    while len(text) - at > _GROUP:
        to = max(text.rfind(b, at, at + _GROUP) for b in (b" ", b"\n", b"\t"))
        if to <= at:
            to = min((x for x in (text.find(b, at + 1) for b in (b" ", b"\n", b"\t")) if x > 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its ASCII-case-folded words and of its runs of other signs, in order."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < _GROUP):
            size += len(texts[to]) + 1
            to += 1
        if size > _GROUP and to == at + 1:
            yield np.concatenate([x for s in _stretches(texts[at]) for x in _hashes([s])])
        else:
            yield from _hashes(texts[at:to])
        at = to


def _hashes(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[:-1], edge[1:]
    start, end = (x[kind[start] != 0] for x in (start, end)) if len(edge) else (edge, edge)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    keys = mix((sums[end] - sums[start]) * down[start])
    upto = np.searchsorted(start, np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)).cumsum())
    return np.split(keys, upto[:-1])
