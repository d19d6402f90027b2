"""Choosing the number of factors: masked fits, cross-validation, rank search."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import nmf

FITS = 4
TRACE = "k int, rep int, test_error double, iter int, tol double, overfit_score double"


def masked_fit(p: nmf.Problem, k: int, rep: int = 1, tol=1e-4, maxit=100, l1=0.01, l2=0.0, seed=1, inverse_density=20, tol_overfit=1e-4, every=5, limit=nmf.BROADCAST_BYTES) -> list[tuple]:
    """Trace rows of a fit that never sees the masked cells. Each `every` iterations the test error is taken; a rise above the
    least one by tol_overfit, relative to their sum, ends the fit."""
    (l1w, l1h), (l2w, l2h) = nmf.pair(l1), nmf.pair(l2)
    rows, state = [], {}

    def note(i, w, d, h, moved) -> bool:
        state.update(i=i, w=w, d=d, h=h, moved=moved, noted=i % every == 0)
        return i % every == 0 and record(i)

    def record(i) -> bool:
        error = nmf.test_error(p, state["w"], state["d"], state["h"], k, seed + rep, inverse_density, limit)
        least = min([error, *[r[2] for r in rows]])
        score = (error - least) / (error + least) if error + least > 0 else 0.0
        rows.append((k, rep, error, i, state["moved"], score))
        return score > tol_overfit

    nmf.als(
        p, nmf.start(p.features, k, rep), k, tol, maxit,
        lambda w: nmf.half_step(p.by_col, w, k, l1h, l2h, mask=(seed + rep, inverse_density, True), limit=limit),
        lambda h: nmf.half_step(p.by_row, h, k, l1w, l2w, mask=(seed + rep, inverse_density, False), limit=limit), note, limit,
    )
    if not state["noted"]:
        record(state["i"] + 1)
    return rows


def cross_validate(m: DataFrame, ranks: list[int], n_replicates: int = 3, test_density: float = 0.05, trace_every: int = 5, **options) -> DataFrame:
    """The traces of every rank and replicate; starts are nested in rank, masks differ by replicate. Fits are independent: FITS run side by side."""
    p = nmf.problem(m)
    fits = [(k, rep) for k in ranks for rep in range(1, n_replicates + 1)]
    with ThreadPoolExecutor(FITS) as pool:
        found = list(pool.map(lambda x: masked_fit(p, *x, inverse_density=round(1 / test_density), every=trace_every, **options), fits))
    return m.sparkSession.createDataFrame([r for rows in found for r in rows], TRACE)


def best_rank_rows(rows: list[tuple], tol_overfit: float = 1e-4) -> int:
    """best_rank on trace rows (k, rep, test_error, iter, ...) that the driver made itself."""
    found = []
    for rep in dict.fromkeys(r[1] for r in rows):
        own = [r for r in rows if r[1] == rep]
        top = max(r[0] for r in own) + 1
        for k in dict.fromkeys(r[0] for r in own):
            e = [r[2] for r in own if r[0] == k]
            if k < top and len(e) > 1:
                least, rise = e[0], 0.0
                for before, after in zip(e, e[1:]):
                    least = min(least, before)
                    rise = max(rise, (after - least) / (after + least))
                if rise > tol_overfit:
                    top = k
        last = {}
        for r in own:
            if r[0] < top and (r[0] not in last or r[3] > last[r[0]][3]):
                last[r[0]] = r
        found.append(min(last.values(), key=lambda r: (r[2], r[0]))[0] if last else 2)
    return math.floor(sum(found) / len(found))


def best_rank(trace: DataFrame, tol_overfit: float = 1e-4) -> DataFrame:
    """One row, best: per replicate, ranks from the first overfit one on go; of the rest, the one with the least last error (2 if none). The mean, rounded down."""
    steps = W.partitionBy("rep", "k").orderBy("iter")
    before = F.min("test_error").over(steps.rowsBetween(W.unboundedPreceding, -1))
    rises = trace.withColumn("rise", (F.col("test_error") - before) / (F.col("test_error") + before))
    per_rank = rises.groupBy("rep", "k").agg(F.coalesce(F.max("rise"), F.lit(0.0)).alias("rise"), F.max_by("test_error", "iter").alias("last"))
    limit = F.coalesce(F.min(F.when(F.col("rise") > tol_overfit, F.col("k"))).over(W.partitionBy("rep")), F.lit(1 << 30))
    ok = per_rank.withColumn("top", limit)
    best = ok.groupBy("rep").agg(F.coalesce(F.min_by(F.when(F.col("k") < F.col("top"), F.col("k")), F.when(F.col("k") < F.col("top"), F.struct("last", "k"))), F.lit(2)).alias("k"))
    return best.agg(F.floor(F.avg("k")).cast("int").alias("best"))


def ard_nmf(m: DataFrame, k_init: int = 2, k_max: int = 100, k_min: int = 2, n_replicates: int = 1, tol: float = 1e-5, cv_tol: float = 1e-4, maxit: int = 100, l1=0.01, l2=0.0,
            learning_rate: float = 1.0, tol_overfit: float = 1e-3, trace_every: int = 1, test_density: float = 0.05, seed: int = 1, limit: int = nmf.BROADCAST_BYTES) -> nmf.Model:
    """Finds the rank by a line search that grows, shrinks or bisects, then fits without a mask. misc has the trace."""
    p, rows = nmf.problem(m), []
    for rep in range(1, n_replicates + 1):
        step, rank, top, own = 1.0, k_init, k_max, []
        while step >= 1 and k_min <= rank <= top and rank not in {r[0] for r in own}:
            found = masked_fit(p, rank, rep, cv_tol, maxit, l1, l2, seed, round(1 / test_density), tol_overfit, trace_every, limit)
            own += found
            if found[-1][5] >= tol_overfit:
                top = rank
            kept = [r for r in own if r[0] < top]
            best = best_rank_rows(kept, tol_overfit) if kept else 2
            tried = sorted({r[0] for r in own})
            if best not in tried:
                break
            at = tried.index(best)
            if at == len(tried) - 1:
                step *= 1 + learning_rate
                rank = best + math.floor(step)
            elif at == 0:
                if math.floor(step) < best:
                    rank, step = best - math.floor(step), step * (1 + learning_rate)
                else:
                    rank = best // 2
            else:
                low, high = best - tried[at - 1], tried[at + 1] - best
                if low <= 1 and high <= 1:
                    break
                rank = best - low // 2 if low >= high else best + high // 2
        rows += own
    best = best_rank_rows(rows, tol_overfit)
    model = nmf.fit(p, best, tol, maxit, l1, l2, seed, limit)
    model.misc["trace"] = m.sparkSession.createDataFrame(rows, TRACE)
    return model


def rank_plot(trace: DataFrame, tol_overfit: float = 1e-4, detail: int = 1) -> DataFrame:
    """The plotted rows. detail 1: last error of each (rep, k) over the replicate's least, and the best rank; 2: the errors from iteration 5 on."""
    if detail == 2:
        return trace.where("iter >= 5").select("rep", "k", "iter", "test_error")
    last = trace.groupBy("rep", "k").agg(F.max_by("test_error", "iter").alias("error"))
    rel = last.withColumn("rel", F.col("error") / F.min("error").over(W.partitionBy("rep")))
    return rel.crossJoin(F.broadcast(best_rank(trace, tol_overfit))).select("rep", "k", "rel", (F.col("k") == F.col("best")).alias("is_best"))


def run(m: DataFrame, k=None, codes: DataFrame | None = None, features: DataFrame | None = None, reps: int = 3, tol: float = 1e-5, maxit: int = 100, l1=0.01, l2=0.0, learning_rate=0.8, tol_overfit=1e-4, trace_every=5, k_max: int = 10_000) -> nmf.Model:
    """The whole way: raw counts are normalized, features(row_id, place) chosen, groups balanced by codes(sample_id, code);
    k None searches the rank, a list is cross-validated, a number is fitted."""
    from . import prepare

    if prepare.is_raw(m):
        m = prepare.log_normalize(m)
    if features is not None:
        m = prepare.select_features(m, features)
    if codes is not None:
        m = prepare.weight_by_split(m, codes)
    m = nmf.cut(m)
    if k is None:
        return ard_nmf(m, k_max=k_max, n_replicates=reps, tol=tol, maxit=maxit, l1=l1, l2=l2, learning_rate=learning_rate, tol_overfit=tol_overfit, trace_every=trace_every)
    if isinstance(k, (list, tuple)):
        trace = cross_validate(m, list(k), reps, tol=tol * 10, maxit=maxit, l1=l1, l2=l2, tol_overfit=tol_overfit, trace_every=trace_every)
        model = nmf.run_nmf(m, best_rank(trace, tol_overfit).first()[0], tol, maxit, l1, l2)
        model.misc["trace"] = trace
        return model
    return nmf.run_nmf(m, k, tol, maxit, l1, l2)


def run_on(spark: SparkSession, path: str, **options) -> nmf.Model:
    return run(spark.read.parquet(path), **options)
