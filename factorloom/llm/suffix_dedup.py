"""Exact removal of long repeated byte strings, by prefix-free parsing.

A window is a string of `length` bytes; it is repeated if it starts at two places of the corpus. Rolling-hash
triggers (8-byte strings whose hash is 0 modulo 64; where there is none near, modulo 16) cut texts
into phrases that depend on content alone, so copies of a passage are cut alike. Each window belongs
to the first trigger in it (windows without one belong to themselves). The windows of one trigger form a block: they share the
bytes behind the trigger, whose hash is the block's key.

1. One pass emits each block's key and hash; equal blocks of a batch fold into one record first, and
   their windows are known to be repeated.
2. Records meet by key. Equal blocks: all their windows are repeated. A key with one block: nothing else
   can match. Only keys with several different blocks need their text; one place per distinct block is asked for.
3. Those texts are fetched and, key by key, put in corpus order: the suffix array of the dictionary of
   distinct phrases and the suffix array of the parse, combined; neighbours that share `length` bytes are repeated. A key
   with more than `hot` blocks (a passage with as many continuations) is not brought together: its windows go on by their
   own 128-bit hashes, and equal ones fold before they are sent.
4. Each document's repeated windows are joined and cut out.

What suffix order decides are the windows of keys with several different blocks (up to `hot`); equal blocks, windows without a
trigger (the second trigger table leaves few) and the windows of hot keys are decided by their hashes, of 128 bits each. Rows are told apart by as many. Null texts are empty. Rows with equal doc_id and text are separate places that repeat each other;
rows with equal doc_id and different texts are told apart. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, text_bytes
from .hashing import mix, powers

WIDTH = 8
_SECOND = np.random.Generator(np.random.PCG64(78)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = np.random.Generator(np.random.PCG64(79)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are parsed, and put in order, at a time: either takes some eighty times as much memory.
_GROUP, LOT = 1 << 21, 2_500_000
RECORD = np.dtype([("key", "<u8"), ("block", "<u8"), ("uid", "<i8"), ("low", "<u8"), ("n", "u1"), ("off", "u1"), ("many", "u1"), ("alone", "u1")])
SNIPPET = "key long, salt int, uid long, low long, n int, off int, many boolean, text binary"
FOUND = "uid long, kind int, payload binary"
INTERVALS, ASKED, ASKED_HOT = 0, 1, 2
_ASK = np.dtype([("key", "<u8"), ("low", "<u8"), ("n", "u1"), ("off", "u1"), ("many", "u1")])


def triggers(data: bytes, bits: int, odd: int) -> np.ndarray:
    """Places whose next 8 bytes hash to 0 in the upper bits."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64)
    eight = np.ndarray((len(data) - WIDTH + 1,), "<u8", data, strides=(1,))
    return np.flatnonzero((eight * np.uint64(odd)) >> np.uint64(64 - bits) == 0)


def _blocks(places: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int):
    """For each trigger the window starts (first, last) it owns within the ranges low..high of starts."""
    if not len(places) or not len(low):
        z = np.zeros(0, np.int64)
        return z, z, z
    own = np.searchsorted(low, places, "right") - 1
    ok = own >= 0
    places, before, own = places[ok], np.append(-1, places[:-1])[ok], own[ok]
    first = np.maximum(np.maximum(before + 1, places - reach + 1), low[own])
    last = np.minimum(places, high[own])
    ok = first <= last
    return first[ok], last[ok], places[ok]


def _rest(size: int, low, high, first, last):
    """The ranges of starts that no block owns."""
    flag = np.zeros(size + 1, np.int32)
    np.add.at(flag, low, 1)
    np.add.at(flag, high + 1, -1)
    np.add.at(flag, first, -1)
    np.add.at(flag, last + 1, 1)
    edge = np.diff((flag.cumsum() > 0).astype(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


class Hashes:
    """Two independent 64-bit hashes of any substring."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        up, self.down = powers(len(data) + 1)
        self.sums = []
        for table in (_FIRST, _SECOND):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[codes] * up[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[start]) * self.down[start] + (end - start).astype(np.uint64))


def parse(data: bytes, begins: np.ndarray, ends: np.ndarray, uids: np.ndarray, length: int) -> np.ndarray:
    """Records of all blocks of the texts data[begin:end]; low is relative to data. off is the trigger behind low, n the windows less one."""
    tail = min(60, length - 1)
    reach = min(length - tail, 250)
    low, high = begins, ends - length
    ok = high >= low
    low, high, uids, begins = low[ok], high[ok], uids[ok], begins[ok]
    h, parts, ranges = Hashes(data), [], (low, high)
    for level, (bits, odd) in enumerate(((6, 0x9E3779B97F4A7C15), (4, 0xD6E8FEB86659FD93))):
        first, last, place = _blocks(triggers(data, bits, odd), *ranges, reach)
        parts.append((first, last, place, np.full(len(first), level, np.uint64)))
        ranges = _rest(len(data), *ranges, first, last)
    alone = np.concatenate([np.arange(a, b + 1) for a, b in zip(*ranges)]) if len(ranges[0]) else np.zeros(0, np.int64)
    parts.append((alone, alone, alone, np.full(len(alone), 2, np.uint64)))
    first, last, place, level = (np.concatenate(x) for x in zip(*parts))
    out = np.zeros(len(first), RECORD)
    out["key"] = mix(h.of(0, place, place + tail) + level)
    shape = ((place - first) * 256 + (last - first)).astype(np.uint64)
    out["block"] = mix(h.of(1, first, last + length) + mix(shape + np.uint64(1)))
    out["uid"] = uids[np.searchsorted(low, first, "right") - 1]
    out["low"], out["n"], out["off"], out["alone"] = first, last - first, place - first, level == 2
    return out


# --- corpus order -------------------------------------------------------------------------------


def suffix_ranks(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes values[i:end of i's segment]; equal suffixes share a rank. values >= 0; ends: for each place the end of its segment.

    Prefix doubling, begun with as many values as fit one integer. A suffix is looked at again only while others share its
    rank and it goes on beyond what was compared. A rank is the place of its group in the order, so it need not change with others.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(values.max() + 1).bit_length())
    k = max(1, 62 // bits)
    at, left = np.arange(n), ends - np.arange(n)
    key = np.zeros(n, np.int64)
    padded = np.append(values + 1, np.zeros(k, np.int64))
    for i in range(k):
        key = (key << bits) | np.where(i < left, padded[at + i], 0)
    rank = _places(key)
    while True:
        sizes = np.bincount(rank, minlength=n)
        live = np.flatnonzero((sizes[rank] > 1) & (left >= k))
        if not len(live):
            return rank
        own = rank[live]
        nxt = np.where(left[live] > k, rank[np.minimum(live + k, n - 1)] + 1, 0)
        order = np.lexsort((nxt, own))
        own, nxt = own[order], nxt[order]
        index = np.arange(len(own))
        new_group = np.append(True, own[1:] != own[:-1])
        new = new_group | np.append(True, nxt[1:] != nxt[:-1])
        group_at = np.maximum.accumulate(np.where(new_group, index, 0))
        rank[live[order]] = own + np.maximum.accumulate(np.where(new, index, 0)) - group_at
        k *= 2


def _places(key: np.ndarray) -> np.ndarray:
    """For each key its group's place in the order."""
    order = np.argsort(key)
    sorted_ = key[order]
    first = np.append(True, sorted_[1:] != sorted_[:-1])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return rank


def corpus_order(data: bytes, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, bits: int = 4) -> np.ndarray:
    """The order of the suffixes that begin at `starts`, each up to the end of its text, by prefix-free parsing.

    begins, ends: the texts, which tile data. Phrases run from one trigger to the end of the next.
    """
    cuts = triggers(data, bits, 0x9E3779B97F4A7C15)
    text_of = np.searchsorted(begins, cuts, "right") - 1
    cuts = cuts[cuts + WIDTH <= ends[text_of]]
    cuts = np.unique(np.concatenate([cuts, begins]))
    text_of = np.searchsorted(begins, cuts, "right") - 1
    phrase_end = np.minimum(np.append(cuts[1:], len(data)) + WIDTH, ends[text_of])
    # the dictionary: distinct phrases, and which one stands at each place of the parse
    number: dict[bytes, int] = {}
    parse_ = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(cuts.tolist(), phrase_end.tolist())), np.int64, len(cuts))
    words = list(number)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word_at = sizes.cumsum() - sizes
    within = suffix_ranks(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.repeat(word_at + sizes, sizes))
    # the parse: phrases by their rank, suffixes up to the text's end
    last_of = np.append(np.flatnonzero(np.diff(text_of)) + 1, len(cuts))
    behind = np.append(suffix_ranks(_places(within[word_at[parse_]]), last_of[np.unique(text_of, return_inverse=True)[1]]) + 1, 0)
    own = np.searchsorted(cuts, starts, "right") - 1
    nxt = np.where((own + 1 < len(cuts)) & (np.append(text_of, -1)[own + 1] == text_of[own]), behind[own + 1], 0)
    return np.lexsort((nxt, within[word_at[parse_[own]] + starts - cuts[own]]))


def repeated(data: bytes, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at `starts` equal another one of them."""
    order = corpus_order(data, begins, ends, starts)
    codes, span = np.frombuffer(data, np.uint8), np.arange(length)
    same = np.zeros(len(order) + 1, bool)
    for at in range(0, len(order) - 1, 1 << 14):
        part = starts[order[at : at + (1 << 14) + 1]]
        rows = codes[part[:, None] + span]
        same[at + 1 : at + len(part)] = (rows[1:] == rows[:-1]).all(axis=1)
    out = np.zeros(len(order), bool)
    out[order] = same[:-1] | same[1:]
    return out


# --- the passes ---------------------------------------------------------------------------------


def _by_uid(uid: np.ndarray, payload: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of FOUND, one per uid."""
    if len(uid):
        order = np.argsort(uid, kind="stable")
        uid, payload = uid[order], payload[order]
        edges = np.append(np.flatnonzero(np.append(True, uid[1:] != uid[:-1])), len(uid))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(uid[a]), kind, payload[a:b].tobytes()


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (start, end) rows; touching ones are joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def _spans(low: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    return np.stack([low, low.astype(np.uint64) + n.astype(np.uint64) + np.uint64(length)], 1).astype("<u8")


def _grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= _GROUP):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _first_pass(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = np.array(column(batch, "uid"), np.int64), text_bytes(batch)
            for a, b in _grouped(texts):
                part, own = texts[a:b], uids[a:b]
                ends = np.fromiter(map(len, part), np.int64, len(part)).cumsum()
                begins = ends - np.fromiter(map(len, part), np.int64, len(part))
                records = parse(b"".join(part), begins, ends, own, length)
                if not len(records):
                    continue
                records["low"] -= begins[np.searchsorted(begins, records["low"], "right") - 1].astype(np.uint64)
                _, first, inverse, count = np.unique(mix(records["key"]) + records["block"], return_index=True, return_inverse=True, return_counts=True)
                many = count[inverse] > 1
                known = records[many]
                out = [(u % buckets, u, INTERVALS, _merged(np.frombuffer(p, "<u8").reshape(-1, 2)).tobytes()) for u, _, p in _by_uid(known["uid"], _spans(known["low"], known["n"], length), INTERVALS)]
                records["many"] = many
                records = records[first]
                bucket = (records["key"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out += [(k, 0, ASKED, records[order[x:y]].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if y > x]
                yield _rows(out, ("bucket", "uid", "kind", "payload"))

    return map_arrow(rows, run, "bucket long, uid long, kind int, payload binary")


def _rows(out: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "uid": pa.int64(), "kind": pa.int32(), "payload": pa.binary(), "key": pa.int64(), "salt": pa.int32(), "low": pa.int64(), "n": pa.int32(), "off": pa.int32(), "many": pa.bool_(), "text": pa.binary()}
    columns = list(zip(*out)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[c]) for x, c in zip(columns, names)], names=list(names))


def _meet(first: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """FOUND: repeated windows, and the places whose text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            kind, uid, payload = (column(batch, c) for c in ("kind", "uid", "payload"))
            blobs += [p for k, p in zip(kind, payload) if k == ASKED]
            known = [(u, INTERVALS, p) for k, u, p in zip(kind, uid, payload) if k == INTERVALS]
            if known:
                yield _rows(known, ("uid", "kind", "payload"))
        if not blobs:
            return
        records = np.frombuffer(b"".join(blobs), RECORD)
        records = records[np.lexsort((records["block"], records["key"]))]
        key, block = records["key"], records["block"]
        new_key = np.append(True, key[1:] != key[:-1])
        new_block = new_key | np.append(True, block[1:] != block[:-1])
        group = new_block.cumsum() - 1
        count = np.bincount(group)
        many = (count > 1) | (np.bincount(group, records["many"]) > 0)
        again = many[group] & (records["many"] == 0)
        out = list(_by_uid(records["uid"][again], _spans(records["low"][again], records["n"][again], length), INTERVALS))
        lead = records[new_block].copy()
        lead["many"] = many
        of_key = (new_key.cumsum() - 1)[new_block]
        differing = np.bincount(of_key)[of_key]
        # a window that is its own trigger is its block: nothing else of its key can match it
        open_ = (differing > 1) & (lead["alone"] == 0)
        for kind, pick in ((ASKED, open_ & (differing <= hot)), (ASKED_HOT, open_ & (differing > hot))):
            ask = np.zeros(int(pick.sum()), _ASK)
            for c in _ASK.names:
                ask[c] = lead[c][pick]
            out += _by_uid(lead["uid"][pick], ask, kind)
        for at in range(0, len(out), 20_000):
            yield _rows(out[at : at + 20_000], ("uid", "kind", "payload"))

    return map_arrow(first.repartition(buckets, "bucket"), run, FOUND)


def _fetch(asked: DataFrame, length: int, seed: int = 5) -> DataFrame:
    """SNIPPET rows for asked(uid, doc_text, asks); windows of hot keys one by one, by their hash, equal ones folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, single = [], []
            for uid, text, plain, heated in zip(column(batch, "uid"), text_bytes(batch), column(batch, "plain"), column(batch, "heated")):
                for r in np.frombuffer(b"".join(plain or ()), _ASK).tolist():
                    key, low, n, off, many = r
                    out.append((_signed(key), 0, uid, low, n, off, bool(many), text[low : low + n + length]))
                for key, low, n, off, many in np.frombuffer(b"".join(heated or ()), _ASK).tolist():
                    for i in range(n + 1):
                        digest = hashlib.blake2b(text[low + i : low + i + length], digest_size=16).digest()
                        single.append((digest, uid, low + i, bool(many)))
            folded: dict[bytes, tuple] = {}
            for digest, uid, low, many in single:
                if digest in folded:
                    # both places are repeated; one stands for them from here on, the other is sent as known
                    u, w, m = folded[digest]
                    out.append((0, 2, uid, low, 0, 0, True, b""))
                    if not m:
                        out.append((0, 2, u, w, 0, 0, True, b""))
                    folded[digest] = (u, w, True)
                else:
                    folded[digest] = (uid, low, many)
            out += [(int.from_bytes(d[:8], "little", signed=True), 1, u, w, 0, 0, m, d) for d, (u, w, m) in folded.items()]
            for at in range(0, len(out), 20_000):
                yield _rows(out[at : at + 20_000], ("key", "salt", "uid", "low", "n", "off", "many", "text"))

    return map_arrow(asked, run, SNIPPET)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(snippets: DataFrame, length: int) -> DataFrame:
    """FOUND rows of the repeated windows among the fetched texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(column(batch, c) for c in ("key", "salt", "uid", "low", "n", "off", "many", "text"))):
                # keys come sorted: a lot ends between two of them
                if size > LOT and row[:2] != last:
                    yield from _lot(held, length)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[7]) + 64
        yield from _lot(held, length)

    rows = snippets.repartition("key", "salt").sortWithinPartitions("salt", "key")
    return map_arrow(rows, run, FOUND)


def _lot(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    uids, lows = [], []
    texts = [r for r in rows if r[1] == 0]
    if texts:
        sizes = np.fromiter((len(r[7]) for r in texts), np.int64, len(texts))
        ends = sizes.cumsum()
        begins = ends - sizes
        n = sizes - length + 1
        starts = np.arange(int(n.sum())) + np.repeat(begins - (n.cumsum() - n), n)
        hit = np.flatnonzero(repeated(b"".join(r[7] for r in texts), begins, ends, starts, length))
        own = np.searchsorted(begins, starts[hit], "right") - 1
        single = ~np.array([r[6] for r in texts])[own]
        own, place = own[single], starts[hit][single] - begins[own[single]]
        uids.append(np.array([r[2] for r in texts], np.int64)[own])
        lows.append(np.array([r[3] for r in texts], np.int64)[own] + place)
    by_hash: dict[bytes, list] = {}
    for key, salt, uid, low, n, off, many, text in rows:
        if salt == 1:
            by_hash.setdefault(text, []).append((uid, low, many))
        elif salt == 2:
            uids.append(np.array([uid], np.int64))
            lows.append(np.array([low], np.int64))
    for places in by_hash.values():
        if len(places) > 1 or places[0][2]:
            uids.append(np.array([p[0] for p in places], np.int64))
            lows.append(np.array([p[1] for p in places], np.int64))
    if uids:
        uid, low = np.concatenate(uids), np.concatenate(lows).astype(np.uint64)
        out = list(_by_uid(uid, _spans(low, np.zeros(len(low), np.uint64), length), INTERVALS))
        out = [(u, k, _merged(np.frombuffer(p, "<u8").reshape(-1, 2)).tobytes()) for u, k, p in out]
        yield _rows(out, ("uid", "kind", "payload"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows(uid, doc_id, text) with new uids where different rows share one; 128 bits tell rows apart. Of narrow rows, and most often none clash."""
    second = F.xxhash64(F.lit(1), "text", F.lit(2), "doc_id")
    pairs = rows.select("uid", second.alias("second"))
    clash = cut(pairs.groupBy("uid").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("uid"))
    if clash.isEmpty():
        return rows
    new = F.when(F.col("clash"), F.xxhash64(F.lit(3), "uid", second)).otherwise(F.col("uid"))
    return rows.join(clash.withColumn("clash", F.lit(True)), "uid", "left").select(new.alias("uid"), "doc_id", "text")


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = 4096, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs(doc_id, text); with texts also kept, the remaining bytes."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _told_apart(rows.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text"))
    found = cut(_meet(_first_pass(rows.select("uid", "text"), length, buckets), length, buckets, hot))
    asked = found.where(F.col("kind") != INTERVALS).groupBy("uid").agg(
        F.collect_list(F.when(F.col("kind") == ASKED, F.col("payload"))).alias("plain"),
        F.collect_list(F.when(F.col("kind") == ASKED_HOT, F.col("payload"))).alias("heated"),
    )
    # rows with equal doc_id and text share a uid and need to be read once: their windows are known to repeat
    fetched = rows.join(asked, "uid").select("uid", "text", "plain", "heated")
    more = _compare(_fetch(fetched, length), length)
    spans = found.where(F.col("kind") == INTERVALS).select("uid", "payload").union(more.select("uid", "payload"))
    spans = spans.groupBy("uid").agg(F.collect_list("payload").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, payload in zip(column(batch, "doc_id"), text_bytes(batch), column(batch, "payload")):
                cuts = _merged(np.frombuffer(b"".join(payload or ()), "<u8").reshape(-1, 2).astype(np.int64)).tolist()
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                row = (doc, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if texts else row)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return map_arrow(rows.join(spans, "uid", "left").select("doc_id", "text", "payload"), run, schema)
