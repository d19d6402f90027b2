"""Static range asymmetric numeral system for token ids: a table of frequencies per segment, independent interleaved blocks.

A segment is one table and up to SEGMENT ids. Its ids are cut into blocks of LANES x STEPS; in a block each lane codes
every LANES-th id with its own 32-bit state, and the lanes' 16-bit words are interleaved in the order in
which the decoder asks for them. A block's header is a checkpoint: where its words begin, its number of ids, the
lanes' states and the checksum of its ids, so any block can be decoded by itself. numpy works on all
lanes of all blocks of a segment at once.

    segment: magic, n_docs, n_ids, n_symbols, n_blocks, n_words, crc32 of the rest (u4)
             doc_ids i8, doc sizes u8, symbols u4, frequencies u2 - 1, block first word u8,
             block sizes u4, block crc32 u4, states u4 [block][lane], words u2
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, SCALE, LANES, STEPS = 0x534E4152, 16, 64, 512
BLOCK, SEGMENT = LANES * STEPS, 1 << 22
_HEAD = struct.Struct("<IIQIIQI")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**SCALE, each 1 at least, in proportion to the counts; 2**16 distinct ids at most."""
    total, room = int(counts.sum()), 1 << SCALE
    if len(counts) > room:
        raise ValueError("a table holds 65536 distinct ids at most")
    out = np.maximum(1, (counts.astype(np.float64) * room / total).astype(np.int64))
    order = np.argsort(-out, kind="stable")
    left = room - int(out.sum())
    if left > 0:
        out[order[0]] += left
    while left < 0:
        spare = out[order] - 1
        take = np.minimum(spare, -(left * spare // max(1, int(spare.sum()))))
        take = take if take.any() else (np.cumsum(spare > 0) <= -left) & (spare > 0)
        out[order] -= take
        left = room - int(out.sum())
        if left > 0:
            out[order[0]] += left
    return out


def encode_segment(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    blocks = -(-n // BLOCK)
    freq = frequencies(counts) if n else np.zeros(0, np.int64)
    start = freq.cumsum() - freq
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = index
    grid = np.ascontiguousarray(grid.reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
    used = np.ascontiguousarray((np.arange(blocks * BLOCK) < n).reshape(blocks, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, -1)
    state = np.full(blocks * LANES, 1 << 16, np.uint64)
    words, emitted = np.zeros(grid.shape, np.uint16), np.zeros(grid.shape, bool)
    freq64, start64 = freq.astype(np.uint64), start.astype(np.uint64)
    shift = np.uint64(16)
    for step in range(STEPS - 1, -1, -1):
        f, c = freq64[grid[step]], start64[grid[step]]
        full = state >= (f << shift)
        whole = used[step].all()
        if not whole:
            full &= used[step]
        words[step], emitted[step] = state, full
        state = np.where(full, state >> shift, state)
        quotient = state // f
        after = (quotient << shift) + (state - quotient * f) + c
        state = after if whole else np.where(used[step], after, state)
    by_block = (STEPS, blocks, LANES)
    emitted = emitted.reshape(by_block).transpose(1, 0, 2)
    stream = words.reshape(by_block).transpose(1, 0, 2)[emitted]
    n_words = emitted.sum(axis=(1, 2), dtype=np.int64)
    raw = np.ascontiguousarray(ids, "<u4")
    edges = [min(i * BLOCK, n) for i in range(blocks + 1)]
    body = b"".join(np.ascontiguousarray(x, t).tobytes() for x, t in (
        (doc_ids, "<i8"), (sizes, "<u8"), (symbols, "<u4"), (freq - 1, "<u2"), (n_words.cumsum() - n_words, "<u8"), (np.diff(edges), "<u4"),
        ([zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])], "<u4"), (state, "<u4"), (stream, "<u2"),
    ))
    return _HEAD.pack(MAGIC, len(doc_ids), n, len(symbols), blocks, len(stream), zlib.crc32(body)) + body


def read_segment(read) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """doc_ids, sizes, ids of the segment at hand; read(n) gives the next n bytes. None at the end. Raises where a checksum is off."""
    head = read(_HEAD.size)
    if not head:
        return None
    magic, docs, n, n_symbols, blocks, n_words, crc = _HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("not a segment")
    layout = _layout(docs, n_symbols, blocks, n_words)
    parts, have = [], 0
    for kind, count in layout:
        data = read(np.dtype(kind).itemsize * count)
        have = zlib.crc32(data, have)
        parts.append(np.frombuffer(data, kind))
    if have != crc:
        raise ValueError("a segment's checksum is off")
    doc_ids, sizes, symbols, freq, first, n_ids, crcs, states, words = parts
    ids = decode_blocks(symbols, freq.astype(np.int64) + 1, first, n_ids, crcs, states, words)
    if len(ids) != n:
        raise ValueError("a segment's blocks don't have its ids")
    return doc_ids, sizes.astype(np.int64), ids


def _layout(docs: int, n_symbols: int, blocks: int, n_words: int) -> tuple[tuple[str, int], ...]:
    return ("<i8", docs), ("<u8", docs), ("<u4", n_symbols), ("<u2", n_symbols), ("<u8", blocks), ("<u4", blocks), ("<u4", blocks), ("<u4", blocks * LANES), ("<u2", n_words)


def read_blocks(segment: bytes | memoryview, which: list[int]) -> list[np.ndarray]:
    """The ids of some blocks of a segment, from their checkpoints: neither other blocks' words nor the segment's checksum are looked at."""
    magic, docs, _, n_symbols, blocks, n_words, _ = _HEAD.unpack(segment[: _HEAD.size])
    if magic != MAGIC:
        raise ValueError("not a segment")
    at, parts = _HEAD.size, []
    for kind, count in _layout(docs, n_symbols, blocks, n_words):
        parts.append(np.frombuffer(segment, kind, count, at))
        at += np.dtype(kind).itemsize * count
    _, _, symbols, freq, first, n_ids, crcs, states, words = parts
    stop = np.append(first, n_words)[1:].astype(np.int64)
    out = []
    for b in which:
        own = words[int(first[b]) : int(stop[b])]
        out.append(decode_blocks(symbols, freq.astype(np.int64) + 1, np.zeros(1, np.int64), n_ids[b : b + 1], crcs[b : b + 1], states[b * LANES : (b + 1) * LANES], own))
    return out


def decode_blocks(symbols, freq, first, n_ids, crcs, states, words) -> np.ndarray:
    """The ids of some blocks of a segment (all arrays but symbols, freq and words hold those blocks' entries)."""
    blocks = len(n_ids)
    if not blocks:
        return np.zeros(0, np.uint32)
    slot = np.repeat(np.arange(len(symbols), dtype=np.uint32), freq)
    freq64, start64 = freq.astype(np.uint64), (freq.cumsum() - freq).astype(np.uint64)
    state, at = states.astype(np.uint64), first.astype(np.int64)
    padded = np.append(words, np.zeros(LANES + 1, np.uint16)).astype(np.uint64)
    lane = np.tile(np.arange(LANES), blocks)
    size = np.repeat(n_ids.astype(np.int64), LANES)
    out = np.zeros((STEPS, blocks * LANES), np.uint32)
    low, shift, floor = np.uint64(0xFFFF), np.uint64(16), np.uint64(1 << 16)
    full = bool((n_ids == BLOCK).all())
    for step in range(STEPS):
        rest = state & low
        s = slot[rest]
        after = freq64[s] * (state >> shift) + rest - start64[s]
        need = after < floor
        if not full:
            used = lane + step * LANES < size
            after, need = np.where(used, after, state), need & used
        taken = need.reshape(blocks, LANES).cumsum(axis=1)
        place = (at[:, None] + taken - 1).ravel()
        state = np.where(need, (after << shift) | padded[np.where(need, place, 0)], after)
        at += taken[:, -1]
        out[step] = s
    if (state != floor).any():
        raise ValueError("a block does not end where it began")
    grid = out.reshape(STEPS, blocks, LANES).transpose(1, 0, 2).reshape(blocks, BLOCK)
    parts = [symbols[grid[b, : n_ids[b]]] for b in range(blocks)]
    for part, crc in zip(parts, crcs):
        if zlib.crc32(np.ascontiguousarray(part, "<u4")) != crc:
            raise ValueError("a block's checksum is off")
    return np.concatenate(parts)
