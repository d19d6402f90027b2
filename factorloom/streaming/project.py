"""Projection of a stream of samples on a fitted model: stateless per record, so any trigger gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels
from ..operators import nmf
from ..session import TASK_BYTES, cut, ship

#: Cells that a task holds for a pass over a W that isn't broadcast.
LOT = 1 << 21


def project_stream(samples: DataFrame, model: nmf.Model, l1: float = 0.01, l2: float = 0.0, limit: int = nmf.BROADCAST_BYTES) -> DataFrame:
    """(id, weights) for streamed or batch rows (id, idx array, val array); features that the model lacks are left out.

    A W beyond the limit is cut to files of ranges of ids, which tasks read once for each lot of cells."""
    spark, k = samples.sparkSession, model.k
    ship(spark)
    w = cut(nmf.rescale(model.w.withColumnRenamed("feature_id", "id"), k)[0])
    local = nmf.localize(w, k, limit)
    if local is None:
        n = -(-w.count() * (k + 1) * 8 // TASK_BYTES)
        w = cut(w.repartitionByRange(n, "id").sortWithinPartitions("id"))
    gram = kernels.gram(local.weights) if local is not None else nmf.factor_sums(w, k)[1]
    source, most = nmf.Source(spark, local or w, k), 0 if local is not None else LOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _held(batches, most):
            sizes = np.concatenate([np.diff(np.asarray(batch.column(1).offsets)) for batch in own])
            at, values = (np.concatenate([np.asarray(batch.column(i).flatten()) for batch in own]) for i in (1, 2))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(at, kind="stable") if most else None  # a part takes a stretch of the sorted cells
            ranked = at if order is None else at[order]
            b = np.zeros((len(sizes), k))
            for ids, weights in source.parts():
                if not len(ids):
                    continue
                pick = slice(None)
                if order is not None:  # back in the order of their owners
                    pick = np.sort(order[np.searchsorted(ranked, ids[0]) : np.searchsorted(ranked, ids[-1], "right")])
                cells, place = at[pick], np.minimum(np.searchsorted(ids, at[pick]), len(ids) - 1)
                b += kernels.cross(np.where(ids[place] == cells, values[pick], 0), place, np.bincount(owner[pick], minlength=len(sizes)), weights)
            x = kernels.nnls(gram, b, l1, l2)
            yield nmf._out(pa.concat_arrays([batch.column(0) for batch in own]), x)

    return samples.select("id", "idx", "val").mapInArrow(run, "id long, weights array<double>")


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together until they have that many cells."""
    held, cells = [], 0
    for batch in batches:
        held.append(batch)
        cells += len(batch.column(1).flatten())
        if cells >= most:
            yield held
            held, cells = [], 0
    if held:
        yield held
