"""SimHash near-duplicates: exact fingerprints, a binary trie self-join, connected components.

Fingerprints are reduced to distinct ones first, so copies never meet in the join. With m bit
blocks, two fingerprints within d bits agree on m - d blocks; for every choice of m - d blocks the
distinct fingerprints are grouped by those bits and each group is joined with itself by walking a
binary trie of the other bits: pairs of nodes descend together, add up differing bits and are
dropped beyond the budget. Groups stream through a task in order and their links leave it as stars;
groups that are too large are split by further blocks, see links().
Components follow from min-label star contraction over the fingerprints, checkpointed each round.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a component.
An empty table gives no rows; other columns are ignored; a null doc_id counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, text_bytes

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    count, n = np.zeros(64, np.int64), len(starts)
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of longs to keep, and fp, the fingerprint's 64 bits as a signed long, of each row."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in text_bytes(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(fp)], names=[*names, "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), *keep, "text"), run, ", ".join(f"{n} long" for n in [*names, "fp"]))


# --- the join -----------------------------------------------------------------------------------


def trie_pairs(codes: np.ndarray, budget: int, prefix: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the sorted distinct codes that agree on the first `prefix` bits and differ in at most `budget`.

    A trie node is a range of codes. Pairs of nodes go down a bit at a time; more than `most` at once are split up.
    """
    if len(codes) < 2:
        return
    top = codes >> np.uint64(64 - prefix) if prefix else np.zeros(len(codes), np.uint64)
    begin = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    end = np.append(begin[1:], len(codes))
    keep = end - begin > 1
    begin, end = begin[keep].astype(np.int64), end[keep].astype(np.int64)
    stack = [(begin, end, begin, end, np.zeros(len(begin), np.int8), prefix)]
    while stack:
        a0, a1, b0, b1, spent, bit = stack.pop()
        if not len(a0):
            continue
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(a0[:half], a1[:half], b0[:half], b1[:half], spent[:half], bit), (a0[half:], a1[half:], b0[half:], b1[half:], spent[half:], bit)]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            left = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            if left.any():
                yield i[left], j[left]
            a0, a1, b0, b1, spent = (x[~leaf] for x in (a0, a1, b0, b1, spent))
        if bit == 64 or not len(a0):
            continue
        same = a0 == b0
        am = _middle(codes, a0, a1, bit)
        bm = np.where(same, am, _middle(codes, b0, b1, bit))
        kids = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent)]
        cross = spent < budget
        kids.append(tuple(x[cross] for x in (a0, am, bm, b1, spent + np.int8(1))))
        other = cross & ~same
        kids.append(tuple(x[other] for x in (am, a1, b0, bm, spent + np.int8(1))))
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*kids))
        live = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        stack.append((a0[live], a1[live], b0[live], b1[live], spent[live], bit + 1))


def _middle(codes: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """In each range of codes that share their first bits, where the given bit turns to 1."""
    low, high, mask = low.copy(), high.copy(), np.uint64(1 << (63 - bit))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        one = (codes[np.minimum(mid, len(codes) - 1)] & mask) != 0
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _arranged(codes: np.ndarray, masks: list[int]) -> np.ndarray:
    """Codes with the bits of the first masks moved to the top, order kept within."""
    out = np.zeros(len(codes), np.uint64)
    for mask in masks:
        low, n = (mask & -mask).bit_length() - 1, mask.bit_count()
        out = ((codes & np.uint64(mask)) >> np.uint64(low)) | (out << np.uint64(n) if n < 64 else np.uint64(0))
    return out


def absorb(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (the smallest index of each one's component, so far) once i and j are linked; whole arrays at a time."""
    while (apart := root[i] != root[j]).any():
        i, j = i[apart], j[apart]
        x, y = root[i], root[j]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return root


def _blocks(low: int, high: int, n: int) -> list[int]:
    """Masks of n blocks that tile the bits from low up to high."""
    edges = [low + (high - low) * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _keyed(rows: DataFrame, masks: list[int], *names: str) -> DataFrame:
    """A row for each mask: choice, its number, and same, the bits of fp under it."""
    each = [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("same")) for k, m in enumerate(masks)]
    return rows.select("fp", *names, F.explode(F.array(*each)).alias("x")).select("fp", *names, "x.choice", "x.same")


def _joined(keyed: DataFrame, masks: list[int], bits: int, at_once: int = 1 << 18) -> DataFrame:
    """a, b: stars of the components within each group of keyed(fp, choice, same), masks by choice. Groups stream by, in order."""
    orders = [[m, *(_runs(~m & (1 << 64) - 1))] for m in masks]

    def lot(choice: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        names, index = np.unique(fp, return_inverse=True)
        root = np.arange(len(names))
        for k in np.unique(choice).tolist():
            own = np.flatnonzero(choice == k)
            codes = _arranged(fp[own], [r for m in orders[k] for r in _runs(m)])
            place = np.argsort(codes)
            for i, j in trie_pairs(codes[place], bits, masks[k].bit_count()):
                root = absorb(root, index[own[place[i]]], index[own[place[j]]])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[x].view(np.int64)) for x in (root[moved], moved)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy().astype(np.int64) for n in ("choice", "same", "fp")]))
            size += batch.num_rows
            if size >= at_once:
                rows = np.concatenate(held, axis=1)
                edge = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
                if len(edge):  # the last group may go on
                    yield lot(rows[0, : edge[-1] + 1], rows[2, : edge[-1] + 1].view(np.uint64))
                    rows = rows[:, edge[-1] + 1 :]
                held, size = [rows], rows.shape[1]
        if size:
            rows = np.concatenate(held, axis=1)
            yield lot(rows[0], rows[2].view(np.uint64))

    rows = keyed.select("choice", "same", "fp").repartition("choice", "same").sortWithinPartitions("choice", "same")
    return map_arrow(rows, run, "a long, b long")


def _runs(mask: int) -> list[int]:
    """A mask's runs of ones, highest first."""
    out = []
    while mask:
        low = (mask & -mask).bit_length() - 1
        n = ((mask >> low) + 1 & -((mask >> low) + 1)).bit_length() - 1
        out.append(((1 << n) - 1) << low)
        mask &= ~out[-1]
    return out[::-1]


def links(distinct: DataFrame, bits: int = 3, blocks: int = 4, hot: int = 1 << 20) -> DataFrame:
    """a < b (unsigned): links of fp that span the same components as all pairs within `bits` bits.

    Groups of more than `hot` fingerprints are split: what lies in one has its differing bits outside the
    shared ones, so two that link also agree on one of bits + 1 blocks of the rest, and those go to groups of their own.
    """
    tiles = _blocks(0, 64, blocks)
    masks = [sum(c) for c in combinations(tiles, blocks - bits)]
    keyed = _keyed(distinct.select("fp"), masks)
    large = cut(keyed.groupBy("choice", "same").count().where(F.col("count") > hot).select("choice", "same"))
    if large.isEmpty():
        return _joined(keyed, masks, bits).distinct()
    found = _joined(keyed.join(large, ["choice", "same"], "left_anti"), masks, bits)
    # bits outside a choice's mask, in bits + 1 blocks each: as many second masks for every choice
    finer = [[m | sum(part) for part in _split(~m & (1 << 64) - 1, bits + 1)] for m in masks]
    own = keyed.join(large, ["choice", "same"], "left_semi").select("fp", "choice")
    for k, some in enumerate(finer):
        found = found.union(_joined(_keyed(own.where(F.col("choice") == k).select("fp"), some), some, bits))
    return found.distinct()


def _split(mask: int, n: int) -> list[list[int]]:
    """The mask's bits in n lots of nearly equal size."""
    ones = [1 << i for i in range(64) if mask >> i & 1]
    return [ones[len(ones) * i // n : len(ones) * (i + 1) // n] for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# --- components ---------------------------------------------------------------------------------


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for nodes(node) and edges(a, b). Alternates large and small stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = cut(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        fixed = _digest(after) == _digest(edges)
        edges = after
        if fixed:
            break
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("root"))


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first())


def roots(distinct: DataFrame, bits: int = 3, blocks: int | None = None, hot: int = 1 << 20) -> DataFrame:
    """fp, root (a fingerprint of its component, the same for all of it) for distinct(fp).

    blocks: by default as many as the number of fingerprints calls for; hot: see links().
    """
    if blocks is None:
        n = distinct.count()
        blocks = 4 if n < 1 << 24 else 5 if n < 1 << 30 else 6
    found = cut(links(distinct, bits, blocks, hot))
    touched = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    out = components(touched, found).withColumnRenamed("node", "fp")
    return distinct.select("fp").join(out, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, bits: int = 3, blocks: int | None = None, hot: int = 1 << 20) -> DataFrame:
    """doc_id, fp, component_id of each row; the options are those of roots()."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = distinct.join(roots(distinct, bits, blocks, hot), "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    # a fingerprint of many copies is one row here; the copies are read where they lie, split by AQE if need be
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component: the one with the smallest doc_id (null counts as the
    smallest), of several the one with the smallest hash of the text.

    Rows are told apart by doc_id and a 128-bit hash of the text, so null and repeated ids are rows of their own; rows equal in both are one.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    keyed = docs.select(row.alias("row"), F.struct("*").alias("doc"))
    prints = cut(fingerprints(keyed.select("row.doc_id", "row.h1", "row.h2", "doc.text"), ("h1", "h2")))
    # narrow rows choose; the texts meet the chosen keys once
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h1", "h2")
    distinct = cut(prints.groupBy("fp").agg(F.min(order).alias("row")))
    kept = distinct.join(roots(distinct, **options), "fp").groupBy("root").agg(F.min("row").alias("row"))
    # plain columns as keys, so that the join's partitioning serves what follows it
    keys = {"k0": F.coalesce("row.doc_id", F.lit(0)), "k1": F.col("row.named"), "k2": F.col("row.h1"), "k3": F.col("row.h2")}
    kept = cut(kept.select(*[c.alias(k) for k, c in keys.items()]))
    return keyed.select(*[c.alias(k) for k, c in keys.items()], "doc").join(kept, [*keys], "left_semi").dropDuplicates([*keys]).select("doc.*")
