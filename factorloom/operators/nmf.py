"""Non-negative matrix factorization by alternating non-negative least squares, and its variants.

A = W diag(d) H; the weights of each factor sum to 1 in W and in H. A is kept twice, grouped by column
and by row (one shuffle each, written once as a bucketed table, never shuffled again); a group of more than CELLS cells is split into pieces.
In a half step the factor of the other side meets the groups of the side to be solved: it is broadcast if its measured size is under BROADCAST_BYTES. Beyond that
it is joined, by its own ids, with the other grouping: only the factor goes to the buckets, the cells stay, and each task sums its products by the id they
belong to before k numbers per id are shuffled. Masked solves need a Gram matrix per id; a factor beyond the limit streams from the shared folder
past bounded lots of ids for that. The k x k Gram matrix always fits. Factors stay DataFrames and are
cut to the shared folder each half step, so lineage stays short and survives lost executors.

Solves start from 0 (a warm start from the previous factor is compat_warm_start in the reference's
sense and not offered). l1 and l2 are those of the solver: l1 is taken from each step, l2 is added to the diagonal's inverse.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, rng
from ..session import cut, shared_dir, ship

BROADCAST_BYTES = 64 << 20
#: Cells of one row of a grouping at most, and bytes of per-id matrices that a task holds.
CELLS, HELD_BYTES = 1 << 13, 64 << 20
#: Ids of the other side that are looked at together for masked pairs.
OTHERS = 1 << 20


@dataclass
class Model:
    """W(feature_id, weights), d, H(sample_id, weights); weights are arrays of length k."""

    w: DataFrame
    d: np.ndarray
    h: DataFrame
    misc: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.d)

    @staticmethod
    def from_parts(w: DataFrame, d, h: DataFrame, **misc) -> Model:
        d = np.asarray(d, float)
        for name, part in (("w", w), ("h", h)):
            wrong = part.where(F.size("weights") != len(d)).limit(1).count()
            if wrong:
                raise ValueError(f"{name} does not have {len(d)} factors")
        return Model(w, d, h, misc)

    def long(self, side: str) -> DataFrame:
        """(feature_id or sample_id, factor, weight)."""
        df, ident = (self.w, "feature_id") if side == "w" else (self.h, "sample_id")
        return df.select(ident, F.posexplode("weights").alias("factor", "weight"))

    def subset(self, factors: list[int], samples: DataFrame | None = None) -> Model:
        factors = [int(f) for f in factors]
        pick = F.array(*[F.get("weights", f) for f in factors])
        h = self.h if samples is None else self.h.join(samples, "sample_id", "left_semi")
        return Model(self.w.select("feature_id", pick.alias("weights")), self.d[factors], h.select("sample_id", pick.alias("weights")), dict(self.misc))

    def sorted(self) -> Model:
        return self.subset(list(np.argsort(-self.d, kind="stable")))


@dataclass
class Blocks:
    """A grouped by one side: (id, piece, idx array, val array); every id of that side has a piece 0."""

    rows: DataFrame
    #: (id, pieces) of the ids in several pieces; None if there are none
    long: DataFrame | None
    #: the same cells grouped by the other side, made when asked for
    across: Callable[[], Blocks]

    @property
    def keys(self) -> list[str]:
        """What the table is bucketed by."""
        return ["id"] if self.long is None else ["id", "piece"]


def blocks(m: DataFrame, by: str, ids: DataFrame | None = None, across: Callable[[], Blocks] | None = None, cells: int = CELLS) -> Blocks:
    """Groups m, which should be written or cached: it is read for the sizes of the groups and for the groups.
    ids are only needed where some may have no cells. They meet the sizes, one row a group: ids of cells compress so well that merged partitions of a shuffle held millions in a task."""
    other = "row_id" if by == "col_id" else "col_id"
    sizes = m.groupBy(F.col(by).alias("id")).count()
    sizes = sizes if ids is None else cut(sizes)
    long = cut(sizes.where(F.col("count") > cells).select("id", (F.ceil(F.col("count") / cells) + 1).cast("int").alias("pieces")))
    none = None if ids is None else ids.select(F.col("id").cast("long")).join(sizes, "id", "left_anti")
    rows = m.select(F.col(by).alias("id"), F.col(other).alias("i"), F.col("value").alias("v"))
    if long.isEmpty():
        long, rows = None, rows.withColumn("piece", F.lit(0))
    else:
        # piece 0 of a long group is empty: it stands for the id
        rows = rows.join(long, "id", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("i"), F.col("pieces") - 1) + 1, F.lit(0)).cast("int"))
        none = long.select("id") if none is None else none.union(long.select("id"))
    keys = ["id"] if long is None else ["id", "piece"]
    n = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # shuffled as it is bucketed: a task writes one bucket
    rows = rows.repartition(n, *keys).groupBy("id", "piece").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    rows = rows.select("id", "piece", F.col("c.i").alias("idx"), F.col("c.v").alias("val"))
    if none is not None:
        rows = rows.unionByName(none.select("id", F.lit(0).alias("piece"), F.array().cast("array<bigint>").alias("idx"), F.array().cast("array<double>").alias("val")).repartition(n, *keys))
    out = Blocks(_bucketed(rows, keys, n), long, lambda: across() if across else blocks(m, other, across=lambda: out, cells=cells))
    return out


def _bucketed(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows as a table of the shared folder in n buckets of the keys: joins on those leave it where it is."""
    spark, name = rows.sparkSession, f"factorloom_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("path", f"{shared_dir(spark)}/table").bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)


def start(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, weights): uniform numbers that depend on id and factor alone, so fewer factors are a prefix of more."""
    return ids.select("id", F.array(*[rng.uniform(seed, F.col("id"), f) for f in range(k)]).alias("weights"))


def factor_sums(f: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums per factor and the Gram matrix of (id, weights), in one aggregation of k + k (k + 1) / 2 numbers."""
    ship(f.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = _matrix(batch.column(batch.schema.get_field_index("weights")), k)
            total[:k] += w.sum(axis=0)
            total[k:] += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    sums = f.select("weights").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k + k * k)
    for r in sums:
        flat[r["at"]] = r["value"]
    return flat[:k], flat[k:].reshape(k, k) + kernels.TINY * np.eye(k)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), k)


def _out(ids, x: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x, np.float64).ravel()))], names=["id", "weights"])


@dataclass
class Local:
    """A factor small enough to broadcast: sorted ids and their weights."""

    ids: np.ndarray
    weights: np.ndarray

    def unit(self) -> tuple[Local, np.ndarray]:
        """The factor with unit sums, and the sums plus 1e-15."""
        d = self.weights.sum(axis=0) + kernels.TINY
        return Local(self.ids, self.weights / d), d


def localize(f: DataFrame | Local, k: int, limit: int) -> Local | None:
    """The factor itself if its rows, counted first, are under the limit."""
    if isinstance(f, Local):
        return f
    return gather(f, k) if f.count() * (k + 1) * 8 <= limit else None


def gather(f: DataFrame, k: int) -> Local:
    """A factor whose size was checked, on the driver."""
    table = f.select("id", "weights").toArrow()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    return Local(ids[order], np.asarray(table.column("weights").combine_chunks().flatten()).reshape(-1, k)[order])


def as_rows(f: DataFrame | Local, spark: SparkSession) -> DataFrame:
    if isinstance(f, DataFrame):
        return f
    batch = _out(pa.array(f.ids, pa.int64()), f.weights)
    return spark.createDataFrame(pa.Table.from_batches([batch]))


class Source:
    """A factor that tasks read in parts: all of it at once where it is broadcast, or streamed from the files it was cut to."""

    def __init__(self, spark: SparkSession, f: DataFrame | Local, k: int):
        self.k = k
        self.shared, self.files = (spark.sparkContext.broadcast(f), []) if isinstance(f, Local) else (None, f.inputFiles())

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted ids and their weights."""
        if self.shared is not None:
            yield self.shared.value.ids, self.shared.value.weights
        for uri in self.files:
            place, path = fs.FileSystem.from_uri(uri)
            with place.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(max(1, HELD_BYTES // (8 * self.k)), columns=["id", "weights"]):
                    ids, weights = batch.column(0).to_numpy(), _matrix(batch.column(1), self.k)
                    order = np.argsort(ids)
                    yield ids[order], weights[order]


def _lots(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _with_pieces(side: Blocks, f: DataFrame) -> DataFrame:
    """f(id, ...) with a row for each piece of its id, if some have several."""
    if side.long is None:
        return f
    last = F.coalesce(F.col("pieces"), F.lit(1)) - 1
    return f.join(side.long, "id", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), last))).drop("pieces")


def _sums(rows: DataFrame, k: int) -> DataFrame:
    """(id, b): the sum of arrays b per id."""
    sums = rows.groupBy("id").agg(*[F.sum(F.get("b", i)).alias(f"b{i}") for i in range(k)])
    return sums.select("id", F.array(*[f"b{i}" for i in range(k)]).alias("b"))


def half_step(side: Blocks, f: DataFrame | Local, k: int, l1: float = 0.0, l2: float = 0.0, *, link: DataFrame | None = None, l1_rows: DataFrame | None = None,
              mask: tuple[int, int, bool] | None = None, graph: DataFrame | None = None, limit: int = BROADCAST_BYTES, update: str = "nnls", previous: DataFrame | None = None) -> DataFrame:
    """(id, weights) of one side given f(id, weights) of the other: solves for each id, unscaled.

    link(id, link) multiplies the cross products; l1_rows(id, l1) adds an l1 per id and factor; graph(dst, src,
    weight) convolves the cross products; mask = (seed, inverse density, ids are samples) leaves masked cells out.
    """
    spark, rows = side.rows.sparkSession, side.rows
    ship(spark)
    if isinstance(f, Local):
        local, gram = f, kernels.gram(f.weights)
    else:
        f = cut(f)
        _, gram = factor_sums(f, k)
        local = localize(f, k, limit)
    if mask is not None and local is not None and side.long is None:
        return _masked_step(rows, spark.sparkContext.broadcast(local), gram, k, l1, l2, mask)
    if local is not None:
        rows = _products(rows, spark.sparkContext.broadcast(local), k, mask)
        rows = rows if side.long is None else _sums(rows, k)
    else:
        sums = _carried(side.across(), f, k, mask)
        rows = rows.where("piece = 0").select("id").join(sums, "id", "left").select("id", F.coalesce("b", F.array(*[F.lit(0.0)] * k)).alias("b"))
    if mask is not None:
        rows = _less_masked(rows, Source(spark, f if local is None else local, k), k, mask)
    if graph is not None:
        edges = graph.select(F.col("dst").alias("id"), F.col("src").alias("from"), F.col("weight").alias("g"))
        moved = edges.join(rows.select(F.col("id").alias("from"), "b"), "from")
        moved = moved.groupBy("id").agg(*[F.sum(F.col("g") * F.get("b", i)).alias(f"b{i}") for i in range(k)])
        rows = rows.select("id").join(moved, "id", "left").select("id", F.array(*[F.coalesce(f"b{i}", F.lit(0.0)) for i in range(k)]).alias("b"))
    if link is not None:
        rows = rows.join(link, "id").select("id", F.zip_with("b", "link", lambda a, c: a * c).alias("b"))
    if l1_rows is not None:
        rows = rows.join(l1_rows, "id").select("id", "b", "l1")
    if previous is not None:
        rows = rows.join(previous.select("id", F.col("weights").alias("x")), "id")
    return _solve(rows, gram, k, l1, l2, update)


def _products(rows: DataFrame, shared, k: int, mask: tuple[int, int, bool] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            ids, idx, val = batch.columns
            sizes, at, values = np.diff(np.asarray(idx.offsets)), np.asarray(idx.flatten()), np.asarray(val.flatten())
            if mask is not None:
                values = np.where(_masked_cells(mask, np.repeat(np.asarray(ids), sizes), at), 0, values)
            b = kernels.cross(values, np.searchsorted(f.ids, at), sizes, f.weights)
            yield pa.RecordBatch.from_arrays(_out(ids, b).columns, names=["id", "b"])

    return rows.select("id", "idx", "val").mapInArrow(run, "id long, b array<double>")


def _carried(across: Blocks, f: DataFrame, k: int, mask: tuple[int, int, bool] | None, at_once: int = 1 << 16) -> DataFrame:
    """(id, b) of the side to be solved, from the grouping by the factor's ids: products are summed by id in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            ids, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums, parts = np.zeros((len(ids), k)), np.concatenate([h[1] for h in held])
            for i in range(k):
                sums[:, i] = np.bincount(inverse, parts[:, i], len(ids))
            return ids, sums

        for batch in _lots(batches, 64):
            own, idx, val, weights = batch.columns
            sizes, at, values = np.diff(np.asarray(idx.offsets)), np.asarray(idx.flatten()), np.asarray(val.flatten())
            if mask is not None:
                values = np.where(_masked_cells((mask[0], mask[1], mask[2]), at, np.repeat(np.asarray(own), sizes)), 0, values)
            held.append((at, values[:, None] * np.repeat(_matrix(weights, k), sizes, axis=0)))
            size += len(at)
            if size * k > at_once * 64:
                held[:] = [fold()]
                size = len(held[0][0])
                if size * k > at_once * 32:  # little folds: on with it
                    yield pa.RecordBatch.from_arrays(_out(pa.array(held[0][0]), held[0][1]).columns, names=["id", "b"])
                    held, size = [], 0
        if held:
            ids, sums = fold()
            yield pa.RecordBatch.from_arrays(_out(pa.array(ids), sums).columns, names=["id", "b"])

    # the table's buckets are those of the join: only the factor moves
    rows = across.rows.join(_with_pieces(across, f.select("id", "weights")).hint("shuffle_merge"), across.keys)
    return _sums(rows.select("id", "idx", "val", "weights").mapInArrow(run, "id long, b array<double>"), k)


def _solve(rows: DataFrame, gram: np.ndarray, k: int, l1: float, l2: float, update: str) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = {c: _matrix(batch.column(i), k * k if c == "less" else k) for i, c in enumerate(names) if c != "id"}
            if update == "ratio":
                x = part["b"] / (np.diag(gram) * part["x"] + kernels.TINY)
            else:
                own = gram - part["less"].reshape(-1, k, k) if "less" in part else gram
                x = kernels.nnls(own, part["b"], l1 + part.get("l1", 0.0), l2)
            yield _out(batch.column(0), x)

    return rows.mapInArrow(run, "id long, weights array<double>")


def _less_masked(rows: DataFrame, source: Source, k: int, mask: tuple[int, int, bool]) -> DataFrame:
    """rows(id, b) and less: the Gram matrix of the factor's rows that are masked for the id."""
    seed, inverse, by_sample = mask
    lot = max(1, HELD_BYTES // (8 * k * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, lot):
            own, less = np.asarray(batch.column(0)), np.zeros((batch.num_rows, k, k))
            for ids, weights in source.parts():
                for at in range(0, len(ids), OTHERS):
                    some, w = ids[at : at + OTHERS], weights[at : at + OTHERS]
                    for a, b, hit in rng.masked_blocks(seed, inverse, by_sample, own, some):
                        less[a] += (hit.astype(float) @ kernels.pairs(w[b])).reshape(-1, k, k)
            columns = [*batch.columns, _out(batch.column(0), less.reshape(-1, k * k)).column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "b", "less"])

    return rows.mapInArrow(run, "id long, b array<double>, less array<double>")


def _masked_step(rows, shared, gram, k, l1, l2, mask) -> DataFrame:
    seed, inverse, by_sample = mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            ids, idx, val = (batch.column(i) for i in range(3))
            for at in range(0, batch.num_rows, 256):
                own = np.asarray(ids)[at : at + 256]
                part_i, part_v = idx.slice(at, 256), val.slice(at, 256)
                sizes = np.diff(np.asarray(part_i.offsets))
                place, values = np.searchsorted(f.ids, np.asarray(part_i.flatten())), np.asarray(part_v.flatten()).copy()
                out = _masked(seed, inverse, by_sample, own, f.ids)
                values[out[place, np.repeat(np.arange(len(own)), sizes)]] = 0
                b = kernels.cross(values, place, sizes, f.weights)
                yield _out(ids.slice(at, 256), kernels.nnls(kernels.masked_gram(f.weights, gram, out), b, l1, l2))

    return rows.select("id", "idx", "val").mapInArrow(run, "id long, weights array<double>")


def _masked(seed: int, inverse: int, by_sample: bool, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """[other][own]: which cells are masked; the hash takes (sample, feature)."""
    return rng.masked_np(seed, own[None, :], other[:, None], inverse) if by_sample else rng.masked_np(seed, other[:, None], own[None, :], inverse)


def _masked_cells(mask: tuple[int, int, bool], own: np.ndarray, other: np.ndarray) -> np.ndarray:
    seed, inverse, by_sample = mask
    return rng.masked_np(seed, own, other, inverse) if by_sample else rng.masked_np(seed, other, own, inverse)


def rescale(f: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """The factor with unit sums, and the sums plus 1e-15."""
    f = cut(f)
    d = factor_sums(f, k)[0] + kernels.TINY
    return f.select("id", F.array(*[F.get("weights", i) / float(d[i]) for i in range(k)]).alias("weights")), d


def distance(a: DataFrame, b: DataFrame, k: int) -> float:
    """1 - Pearson correlation over all entries of two factors."""
    both = a.select("id", F.col("weights").alias("x")).join(b.select("id", F.col("weights").alias("y")), "id")
    cells = both.select(F.explode(F.arrays_zip("x", "y")).alias("p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    means = cells.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    dx, dy = F.col("x") - F.lit(means["mx"]), F.col("y") - F.lit(means["my"])
    sums = cells.agg(F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy")).first()
    scale = (sums["xx"] * sums["yy"]) ** 0.5 if sums["xx"] else 0.0
    # a constant factor has no correlation: not converged
    return 1 - sums["xy"] / scale if scale else 1.0


@dataclass
class Problem:
    """A matrix ready to be factorized."""

    by_col: Blocks
    by_row: Blocks
    features: DataFrame
    samples: DataFrame


def problem(m: DataFrame, features: DataFrame | None = None, samples: DataFrame | None = None, cells: int = CELLS) -> Problem:
    """features(id), samples(id): all ids of either side, where some have no cells."""
    m = cut(m.select("row_id", "col_id", "value"))  # what m is made from is evaluated once
    given_f, given_s = (None if ids is None else cut(ids.select("id")) for ids in (features, samples))
    by_col = blocks(m, "col_id", given_s, lambda: by_row, cells)
    by_row = blocks(m, "row_id", given_f, lambda: by_col, cells)
    features, samples = (cut(m.select(F.col(by).alias("id")).distinct()) if given is None else given for by, given in (("row_id", given_f), ("col_id", given_s)))
    return Problem(by_col, by_row, features, samples)


def pair(x) -> tuple[float, float]:
    """A penalty for (w, h)."""
    return (float(x[0]), float(x[1])) if isinstance(x, (tuple, list)) else (float(x), float(x))


def als(p: Problem, w: DataFrame, k: int, tol: float, maxit: int, step_h: Callable, step_w: Callable, trace: Callable | None = None, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, np.ndarray, DataFrame, int, float]:
    """Alternates until 1 - corr(w, previous w) is at most tol. trace(i, w, d, h, tol) may stop it.

    Factors that are under the limit by the counted ids stay on the driver between half steps, which then are one job each.
    """
    spark = p.features.sparkSession
    if max(p.features.count(), p.samples.count()) * (k + 1) * 8 <= limit:
        w, moved, i = gather(w, k), 1.0, 0
        for i in range(1, maxit + 1):
            h, d = gather(step_h(w), k).unit()
            before = w
            w, d = gather(step_w(h), k).unit()
            x, y = (a.weights.ravel() - a.weights.mean() for a in (w, before))
            scale = float(np.sqrt((x @ x) * (y @ y)))
            moved = 1 - float(x @ y) / scale if scale else 1.0
            if trace is not None and trace(i - 1, w, d, h, moved):
                break
            if moved <= tol:
                break
        return as_rows(w, spark), d, as_rows(h, spark), i, moved
    w, moved, i, h, d = cut(w), 1.0, 0, None, np.ones(k)
    for i in range(1, maxit + 1):
        h, d = rescale(step_h(w), k)
        h = cut(h)
        before = w
        w, d = rescale(step_w(h), k)
        w = cut(w)
        moved = distance(w, before, k)
        if trace is not None and trace(i - 1, w, d, h, moved):
            break
        if moved <= tol:
            break
    return w, d, h, i, moved


def _model(w, d, h, **misc) -> Model:
    return Model(w.withColumnRenamed("id", "feature_id"), d, h.withColumnRenamed("id", "sample_id"), misc).sorted()


def run_nmf(m: DataFrame, rank: int | DataFrame, tol: float = 1e-4, maxit: int = 100, l1=0.01, l2=0.0, seed: int = 1, features: DataFrame | None = None, samples: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> Model:
    """rank: a number of factors, or a first W as (id, weights). Factors come sorted by d."""
    p = problem(m, features, samples)
    return fit(p, rank, tol, maxit, l1, l2, seed, limit)


def fit(p: Problem, rank, tol=1e-4, maxit=100, l1=0.01, l2=0.0, seed=1, limit=BROADCAST_BYTES) -> Model:
    k = rank if isinstance(rank, int) else rank.select(F.size("weights")).first()[0]
    w = start(p.features, k, seed) if isinstance(rank, int) else rank
    (l1w, l1h), (l2w, l2h) = pair(l1), pair(l2)
    w, d, h, n, moved = als(p, w, k, tol, maxit, lambda w: half_step(p.by_col, w, k, l1h, l2h, limit=limit), lambda h: half_step(p.by_row, h, k, l1w, l2w, limit=limit), limit=limit)
    return _model(w, d, h, iter=n, tol=moved)


def run_linked_nmf(m: DataFrame, rank: int, link_h: DataFrame | None = None, link_w: DataFrame | None = None, tol=1e-4, maxit=100, l1=0.01, l2=0.0, seed=1) -> Model:
    """link_h(id, link), link_w(id, link): 0/1 arrays of length rank that shut factors out of samples or features."""
    if link_h is None and link_w is None:
        raise ValueError("a link matrix is needed")
    for link in (link_h, link_w):
        if link is not None and link.where(F.size("link") != rank).limit(1).count():
            raise ValueError(f"links must have {rank} factors")
    p, (l1w, l1h), (l2w, l2h) = problem(m), pair(l1), pair(l2)
    w, d, h, n, moved = als(p, start(p.features, rank, seed), rank, tol, maxit, lambda w: half_step(p.by_col, w, rank, l1h, l2h, link=link_h), lambda h: half_step(p.by_row, h, rank, l1w, l2w, link=link_w))
    return _model(w, d, h, iter=n, tol=moved, link_h=link_h, link_w=link_w)


def run_graph_nmf(m: DataFrame, graph: DataFrame, rank: int, tol=1e-4, maxit=100, l1=0.01, l2=0.0, seed=1) -> Model:
    """graph(dst, src, weight) over samples: cross products are summed over neighbours, and W sees the convolved H."""
    p, (l1w, l1h), (l2w, l2h) = problem(m), pair(l1), pair(l2)

    def step_w(h: DataFrame) -> DataFrame:
        edges = graph.select(F.col("src").alias("id"), F.col("dst"), F.col("weight").alias("g"))
        spread = edges.join(as_rows(h, edges.sparkSession), "id").groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("g") * F.get("weights", i)).alias(f"x{i}") for i in range(rank)])
        spread = p.samples.join(spread, "id", "left").select("id", F.array(*[F.coalesce(f"x{i}", F.lit(0.0)) for i in range(rank)]).alias("weights"))
        return half_step(p.by_row, spread, rank, l1w, l2w)

    w, d, h, n, moved = als(p, start(p.features, rank, seed), rank, tol, maxit, lambda w: half_step(p.by_col, w, rank, l1h, l2h, graph=graph), step_w)
    return _model(w, d, h, iter=n, tol=moved)


def batch_l1(h: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """(batch, l1): per factor the batch's mean loading less the mean of the other batches' means; batches(id, batch)."""
    means = h.join(batches, "id").groupBy("batch").agg(*[F.avg(F.get("weights", i)).alias(f"m{i}") for i in range(k)])
    total = means.agg(F.count("*").alias("n"), *[F.sum(f"m{i}").alias(f"t{i}") for i in range(k)])
    other = lambda i: (F.col(f"t{i}") - F.col(f"m{i}")) / F.greatest(F.col("n") - 1, F.lit(1))
    return means.crossJoin(F.broadcast(total)).select("batch", F.array(*[F.col(f"m{i}") - other(i) for i in range(k)]).alias("l1"))


def run_batch_nmf(m: DataFrame, batches: DataFrame, rank: int, tol=1e-4, maxit=100, l1=0.01, l2=0.0, seed=1) -> Model:
    """Balances factors over batches(id, batch): a factor that a batch loads on more is penalized there (experimental)."""
    p, (l1w, l1h), (l2w, l2h) = problem(m), pair(l1), pair(l2)
    last: list[DataFrame] = []

    def step_h(w: DataFrame) -> DataFrame:
        extra = batches.join(batch_l1(last[-1], batches, rank), "batch").select("id", "l1") if last else None
        h = cut(half_step(p.by_col, w, rank, l1h, l2h, l1_rows=extra))
        last[:] = [rescale(h, rank)[0]]
        return h

    w, d, h, n, moved = als(p, start(p.features, rank, seed), rank, tol, maxit, step_h, lambda h: half_step(p.by_row, h, rank, l1w, l2w))
    return _model(w, d, h, iter=n, tol=moved)


def run_ratio_nmf(m: DataFrame, rank: int, tol=1e-4, maxit=100, seed=1) -> Model:
    """The experimental ratio update h = (w'A) / (|w_f|^2 h), likewise w; nothing is scaled and d stays 1."""
    p = problem(m)
    w, h, n, moved = cut(start(p.features, rank, seed)), cut(start(p.samples, rank, seed + 1)), 0, 1.0
    for n in range(1, maxit + 1):
        h = cut(half_step(p.by_col, w, rank, update="ratio", previous=h))
        before, w = w, cut(half_step(p.by_row, h, rank, update="ratio", previous=w))
        moved = distance(w, before, rank)
        if moved <= tol:
            break
    return Model(w.withColumnRenamed("id", "feature_id"), np.ones(rank), h.withColumnRenamed("id", "sample_id"), {"iter": n, "tol": moved})


def project(m: DataFrame, w: DataFrame, l1: float = 0.01, l2: float = 0.0, scaled: bool = True) -> Model:
    """Loads new samples on w(feature_id, weights): w is scaled, H solved from 0 and scaled. Without scaled, as it comes."""
    ids = w.withColumnRenamed("feature_id", "id")
    k = ids.select(F.size("weights")).first()[0]
    ids = rescale(ids, k)[0] if scaled else ids
    m = cut(m.select("row_id", "col_id", "value"))
    shared = m.join(ids.select(F.col("id").alias("row_id")), "row_id", "left_semi")
    side = blocks(shared, "col_id", m.select(F.col("col_id").alias("id")).distinct())
    h = half_step(side, ids, k, l1, l2)
    h, d = rescale(h, k) if scaled else (h, np.ones(k))
    return Model(w, d, h.withColumnRenamed("id", "sample_id"))


def project_matrix(m: DataFrame, w: DataFrame, l1: float = 0.01, l2: float = 0.0, codes: DataFrame | None = None, reorder: bool = False) -> Model:
    """Normalizes raw counts, balances groups (codes), keeps common features, projects, and sorts if asked to."""
    from . import prepare

    if prepare.is_raw(m):
        m = prepare.log_normalize(m)
    if codes is not None:
        m = prepare.weight_by_split(m, codes)
    model = project(m, w, l1, l2)
    return model.sorted() if reorder else model


def test_error(p: Problem, w: DataFrame | Local, d: np.ndarray, h: DataFrame | Local, k: int, seed: int, inverse: int, limit: int = BROADCAST_BYTES) -> float:
    """Mean over samples of the mean squared error at masked cells (zeros included); 0 for a sample without any."""
    spark = p.features.sparkSession
    if isinstance(w, Local):
        local = Local(w.ids, w.weights * d)
    else:
        scaled = cut(w.select("id", F.array(*[F.get("weights", i) * float(d[i]) for i in range(k)]).alias("weights")))
        local = localize(scaled, k, limit) or scaled
    source = Source(spark, local, k)
    mask, bits = (seed, inverse, True), rng.class_bits(inverse)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the masked cells that are there add to the loss of a zero."""
        for batch in _lots(batches, 256):
            own, idx, val, h_own = np.asarray(batch.column(0)), batch.column(1), batch.column(2), _matrix(batch.column(3), k)
            owner, at, values = np.repeat(np.arange(len(own)), np.diff(np.asarray(idx.offsets))), np.asarray(idx.flatten()), np.asarray(val.flatten())
            hit = _masked_cells(mask, own[owner], at)
            owner, at, values = owner[hit], at[hit], values[hit]
            loss = np.zeros(len(own))
            for ids, weights in source.parts():
                place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                here = ids[place] == at
                guess = (weights[place[here]] * h_own[owner[here]]).sum(axis=1)
                loss += np.bincount(owner[here], values[here] ** 2 - 2 * values[here] * guess, len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(loss), pa.array(np.zeros(len(own), np.int64))], names=["id", "loss", "n"])

    def zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The masked pairs and their loss if all cells there were zero: (w h)^2, for few factors by the Gram matrix of the masked w."""
        for batch in batches:
            own, h_own = np.asarray(batch.column(0)), _matrix(batch.column(1), k)
            loss, n = np.zeros(len(own)), np.zeros(len(own))
            grams = np.zeros((len(own), 1 + k * k)) if k <= 4 else None
            for ids, weights in source.parts():
                for at in range(0, len(ids), OTHERS):
                    some, w = ids[at : at + OTHERS], weights[at : at + OTHERS]
                    wide = np.concatenate([np.ones((len(w), 1)), kernels.pairs(w)], axis=1) if grams is not None else w
                    for a, b, hit in rng.masked_blocks(seed, inverse, True, own, some):
                        hit = hit.astype(float)
                        if grams is not None:
                            grams[a] += hit @ wide[b]
                        else:
                            n[a] += hit.sum(axis=1)
                            loss[a] += ((h_own[a] @ wide[b].T) ** 2 * hit).sum(axis=1)
            if grams is not None:
                n, loss = grams[:, 0], (grams[:, 1:] * kernels.pairs(h_own)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(loss), pa.array(n.astype(np.int64))], names=["id", "loss", "n"])

    samples = as_rows(h, spark).select("id", "weights")
    rows = p.by_col.rows.join(_with_pieces(p.by_col, samples), p.by_col.keys).select("id", "idx", "val", "weights")
    # samples of a class are masked for the same classes of features: they should meet in a task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classed = samples.repartition(tasks, rng.sample_class(seed, F.col("id"), bits)).sortWithinPartitions(rng.sample_class(seed, F.col("id"), bits))
    schema = "id long, loss double, n long"
    each = rows.mapInArrow(cells, schema).unionByName(classed.mapInArrow(zeros, schema)).groupBy("id").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return each.agg(F.avg(F.when(F.col("n") > 0, F.col("loss") / F.col("n")).otherwise(0.0))).first()[0]
