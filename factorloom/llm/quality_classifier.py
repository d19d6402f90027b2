"""Quality classifier by importance resampling over hashed n-grams.

Two generative models, of the target text and of all text, hold how often each hashed gram (a word or a run of signs, and each pair
of neighbours) occurs. The raw model counts every document. The target model counts the good and harmless documents among at most
`label_rows` labelled ones (those with the smallest hash of their id: the documented bound on the
labelled sample). A gram's log ratio is drawn towards zero by `shrink` standard errors (words, pairs), so that rare grams say nothing. A
document's log weight is the sum of its grams' log ratios: the log ratio of the probabilities that the models give the text, so a few
telling words count the same whatever the length. Documents are then resampled without replacement by Gumbel top-k: key =
log weight + standard Gumbel noise drawn from a hash of the id, and the k largest keys are
selected. k is a parameter; by default it is the number of documents whose log weight reaches what all but `tail` of the held-out target rows
(half of them) have, set lower where no labelled bad row is near (see _threshold). The k-th key is found exactly by counting key bits 16 at a time, so neither rows nor keys are
collected; rows tied with it are all selected.

Null texts and texts of white space alone get the log weight -1e9 and are never selected. Without labelled
target rows all weights are zero and, k aside, every text with words is selected. Repeated rows get equal keys; rows with a null doc_id share their noise;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, text_bytes
from .hashing import mix, word_hashes

BITS, NOTHING, SMOOTH = 18, -1e9, 1.0
CHUNK, COUNTS = 1 << 9, "chunk long, raw binary, target binary"


@dataclass
class Model:
    ratio: np.ndarray  # float32 [2][2**BITS]: log ratio of each bucket, words then pairs
    threshold: float
    seed: int


def grams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    words = mix(hashes) >> shift
    pairs = mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]) >> shift
    return words.astype(np.int64), pairs.astype(np.int64)


def log_weight(hashes: np.ndarray, ratio: np.ndarray) -> float:
    if not len(hashes):
        return NOTHING
    words, pairs = grams(hashes)
    return float(ratio[0][words].sum(dtype=np.float64) + ratio[1][pairs].sum(dtype=np.float64))


def log_ratios(target: np.ndarray, raw: np.ndarray, shrink: tuple[float, float]) -> np.ndarray:
    """[2][buckets]: log of the target's counts over those expected were both models the same, less `shrink` standard errors."""
    expected = raw * target.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    ratio = np.log((target + SMOOTH) / (expected + SMOOTH))
    error = np.sqrt(1 / (target + SMOOTH) + 1 / (expected + SMOOTH))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - np.array(shrink)[:, None] * error, 0)


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, tail: float = 0.002, margin: float = 4.0, shrink: tuple[float, float] = (1.0, 2.0), seed: int = 7) -> Model:
    """docs(doc_id, text), labels(doc_id, quality, toxic)."""
    sample = labels.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    known = sample.select(F.col("doc_id").cast("long"), F.expr("coalesce(quality, 0) = 1 and coalesce(toxic, 0) = 0").alias("good")).toPandas()
    good, bad = (np.unique(known["doc_id"].to_numpy(np.int64)[known["good"].to_numpy(bool) == x]) for x in (True, False))
    bad = np.setdiff1d(bad, good)
    # one half of the target rows fits the model, the other tells how unseen target rows score
    halves = mix(mix(good.view(np.uint64))) & np.uint64(1) == 0
    good, held_out = good[halves], good[~halves]
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 * size), np.int64)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), text_bytes(batch)
            wanted = np.isin(np.array([0 if i is None else i for i in ids], np.int64), good) & np.array([i is not None for i in ids], bool)
            for own, hashes in zip(wanted.tolist(), word_hashes(texts)):
                words, pairs = grams(hashes)
                each = np.concatenate([words, pairs + size])
                if len(each) > size:
                    found = np.bincount(each, minlength=2 * size)
                    sums[0] += found
                    sums[1] += found * own
                else:
                    np.add.at(sums[0], each, 1)
                    if own:
                        np.add.at(sums[1], each, 1)
        parts = sums.reshape(2, -1, CHUNK)
        used = np.flatnonzero(parts[0].any(axis=1))
        yield _counts(used, parts[:, used])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw, target in zip(*(c.to_pylist() for c in batch.columns)):
                both = np.stack([np.frombuffer(raw, "<i8"), np.frombuffer(target, "<i8")])
                total[at] = total[at] + both if at in total else both
        if total:
            yield _counts(np.array(list(total)), np.stack(list(total.values()), 1))

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # counts travel as arrays of CHUNK buckets: a task has nothing to fold before it sends them
    counts = map_arrow(rows, count, COUNTS).repartition("chunk")
    raw, target = np.zeros(2 * size), np.zeros(2 * size)
    for row in map_arrow(counts, add_up, COUNTS).collect():  # 2**19 buckets at most
        at = slice(row["chunk"] * CHUNK, (row["chunk"] + 1) * CHUNK)
        raw[at], target[at] = np.frombuffer(row["raw"], "<i8"), np.frombuffer(row["target"], "<i8")
    raw, target = raw.reshape(2, size), target.reshape(2, size)
    model = Model(log_ratios(target, raw, shrink).astype(np.float32), NOTHING, seed)
    if len(good) and len(held_out):
        wanted = docs.sparkSession.createDataFrame(_ids(np.concatenate([held_out, bad])), "doc_id long")
        scored = score(docs.join(F.broadcast(wanted), "doc_id", "left_semi"), model).where(F.col("log_weight") > NOTHING)
        scored = scored.groupBy("doc_id").agg(F.min("log_weight").alias("w")).toPandas()  # label_rows rows at most
        own = np.isin(scored["doc_id"].to_numpy(np.int64), held_out)
        weights = scored["w"].to_numpy(np.float64)
        if own.any():
            model.threshold = _threshold(np.sort(weights[own]), np.sort(weights[~own]), tail, margin)
    return model


def _counts(chunks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    raw, target = ([x.tobytes() for x in np.ascontiguousarray(c, "<i8")] for c in counts)
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(raw, pa.binary()), pa.array(target, pa.binary())], names=["chunk", "raw", "target"])


def _threshold(good: np.ndarray, bad: np.ndarray, tail: float, margin: float) -> float:
    """The low end of the good weights, and below it half of the way to the next bad one, margin at most: noise then tips no clean text over."""
    least = _low(good, tail)
    below = bad[bad < least]
    return least - (min(margin, (least - below[-1]) / 2) if len(below) else margin)


def _low(weights: np.ndarray, tail: float) -> float:
    """Where the lowest `tail` of the sorted weights ends; with too few of them, their lowest twentieth is prolonged as an exponential tail."""
    least = float(weights[int(tail * len(weights))])
    if tail * len(weights) >= 5:
        return least
    edge = float(np.quantile(weights, 0.05))
    below = edge - weights[weights <= edge]
    return min(least, edge - float(below.mean()) * np.log(0.05 / tail))


def _ids(values: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"doc_id": values})


def _scores(ids: list, texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    weight = np.array([log_weight(h, model.ratio) for h in word_hashes(texts)], np.float64)
    ids64 = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    # nulls share a noise of their own
    hashed = np.where([i is None for i in ids], np.uint64(model.seed), mix(ids64 + np.uint64(model.seed))) if ids else ids64
    uniform = ((mix(hashed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return weight, weight - np.log(-np.log(uniform))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight, key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = _scores(column(batch, "doc_id"), text_bytes(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "key"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, log_weight double, key double")


def cutoff(scores: DataFrame, k: int) -> float:
    """The k-th largest key, exactly: four rounds over 16 bits each of its order-keeping form, 65,536 counts a round."""
    if k <= 0:
        return float("inf")
    scale = 1 << 24
    rows = scores.where(F.col("log_weight") > NOTHING).select(F.floor(F.col("key") * scale).cast("long").alias("whole"), "key")
    rows = rows.withColumn("whole", F.col("whole") + F.lit(1 << 62))
    low, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("whole", shift)
        inside = rows if shift == 48 else rows.where(F.shiftright("whole", shift + 16) == low)
        found = inside.groupBy((part - low * 65536).alias("part")).count().collect()
        for part_, n in sorted(((r["part"], r["count"]) for r in found), reverse=True):
            if left <= n:
                low = low * 65536 + part_
                break
            left -= n
        else:
            return float("-inf")
    return (low - (1 << 62)) / scale


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> tuple[DataFrame, Model, float]:
    """The scores (written), the model and the smallest selected key."""
    model = fit(docs, labels, **options)
    scores = cut(score(docs, model))
    if k is None:
        k = scores.where((F.col("log_weight") >= model.threshold) & (F.col("log_weight") > NOTHING)).count()
    return scores, model, cutoff(scores, k)


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """doc_id, log_weight, key, selected of each row."""
    scores, _, least = resample(docs, labels, k, **options)
    return scores.withColumn("selected", (F.col("key") >= least) & (F.col("log_weight") > NOTHING))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The rows of docs that are selected, all columns; they are scored where they lie, without a join."""
    _, model, least = resample(docs, labels, k, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = _scores(column(batch, "doc_id"), text_bytes(batch), model)
            yield batch.filter(pa.array((key >= least) & (weight > NOTHING)))

    return map_arrow(docs, run, docs.schema)
