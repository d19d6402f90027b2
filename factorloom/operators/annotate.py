"""What factors mean: group summaries, shared factors and links, moderated tests, and the tables behind the plots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from ..functions import stats
from . import prepare


def group_means(h: DataFrame, groups: DataFrame) -> DataFrame:
    """(factor, level, mean, n, ss): means over all samples of a group, absent weights count as 0; h(sample_id, factor, weight), groups(sample_id, level)."""
    sizes = groups.groupBy("level").agg(F.count("*").alias("n"))
    sums = h.join(groups, "sample_id").groupBy("factor", "level").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    cells = h.select("factor").distinct().crossJoin(F.broadcast(sizes))  # factors x levels, both few
    full = cells.join(sums, ["factor", "level"], "left").fillna(0.0, ["s", "q"])
    return full.select("factor", "level", (F.col("s") / F.col("n")).alias("mean"), "n", (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ss"))


def metadata_summary(h: DataFrame, groups: DataFrame) -> DataFrame:
    """(factor, level, share): group means over their sum; null where a factor is 0 everywhere."""
    total = F.sum("mean").over(W.partitionBy("factor"))
    return group_means(h, groups).select("factor", "level", (F.col("mean") / F.nullif(total, F.lit(0.0))).alias("share"))


def link_table(h: DataFrame, groups: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(factor, level, link): 0 where share * groups is under the cutoff."""
    shares = metadata_summary(h, groups)
    n = F.count("*").over(W.partitionBy("factor"))
    return shares.select("factor", "level", F.when(F.col("share") * n < cutoff, 0.0).otherwise(1.0).alias("link"))


def link_matrix(h: DataFrame, groups: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """(id, link array) per sample, as run_linked_nmf takes it."""
    table = link_table(h, groups, cutoff).groupBy("level").agg(F.sort_array(F.collect_list(F.struct("factor", "link"))).alias("l"))
    return groups.join(F.broadcast(table), "level").select(F.col("sample_id").alias("id"), F.col("l.link").alias("link"))


def shared_factors(h: DataFrame, groups: DataFrame) -> DataFrame:
    return _least_share(h, groups).where("least <> 0").select("factor")


def unique_factors(h: DataFrame, groups: DataFrame) -> DataFrame:
    return _least_share(h, groups).where("least = 0").select("factor")


def _least_share(h: DataFrame, groups: DataFrame) -> DataFrame:
    return metadata_summary(h, groups).groupBy("factor").agg(F.min("share").alias("least"))


def run_linked(m: DataFrame, h: DataFrame, groups: DataFrame, rank: int, cutoff: float = 0.5, codes: DataFrame | None = None, **options):
    """Refits with factors shut out of groups that hardly use them; the model's misc has the link table."""
    from . import nmf

    if codes is not None:
        m = prepare.weight_by_split(m, codes)
    model = nmf.run_linked_nmf(m, rank, link_h=nmf.cut(link_matrix(h, groups, cutoff)), **options)
    model.misc["link_matrix"] = link_table(h, groups, cutoff)
    return model


def model_fit(h: DataFrame, groups: DataFrame, center: bool = True) -> DataFrame:
    """Per factor and group: mean (less the factor's grand mean if centred), n, residual variance s2 and its degrees of freedom."""
    means = group_means(h, groups)
    f = W.partitionBy("factor")
    n, groups_ = F.sum("n").over(f), F.count("*").over(f)
    grand = F.sum(F.col("mean") * F.col("n")).over(f) / n
    return means.select(
        "factor", "level", (F.col("mean") - (grand if center else F.lit(0.0))).alias("coef"), "n", (F.sum("ss").over(f) / F.nullif(n - groups_, F.lit(0))).alias("s2"), (n - groups_).alias("df")
    )


def moderated(fit: DataFrame, proportion: float = 0.01) -> DataFrame:
    """Adds t, df_total, lods. The variance prior comes from the factors' variances (one number each), by moments of their logs; this is the plain, not the robust, estimate.

    Without any variance, t is infinite, and null where the coefficient is 0 too (a factor that is 0 everywhere): that is no evidence.
    """
    per_factor = fit.groupBy("factor").agg(F.first("s2").alias("s2"), F.first("df").alias("df")).toPandas()
    ok = per_factor["s2"] > 0
    df = float(per_factor["df"].iloc[0]) if len(per_factor) else 1.0
    d0, s0 = stats.fit_variance_prior(per_factor.loc[ok, "s2"].to_numpy(float), df) if ok.sum() > 1 else (0.0, 1.0)
    pooled = float(per_factor["df"].sum()) if len(per_factor) else 1.0
    post = F.lit(s0) if math.isinf(d0) else (F.lit(d0 * s0) + F.col("df") * F.greatest("s2", F.lit(0.0))) / F.nullif(F.lit(d0) + F.col("df"), F.lit(0.0))
    total = min(df + d0, pooled)
    endless = F.when(post == 0, F.when(F.col("coef") > 0, math.inf).when(F.col("coef") < 0, -math.inf))
    out = fit.withColumn("t", F.coalesce(F.col("coef") / F.nullif(F.sqrt(post / F.col("n")), F.lit(0.0)), endless)).withColumn("df_total", F.lit(float(total)))
    # log odds with a prior variance of coefficients bounded to (0.1, 4) standard deviations of the residuals
    var_prior = F.greatest(F.lit(0.01), F.lit(1.0)) / F.lit(max(s0, 1e-300))
    r = (1.0 / F.col("n") + var_prior) / (1.0 / F.col("n"))
    t2 = F.col("t") * F.col("t")
    ratio = F.when(t2 == math.inf, r).otherwise((t2 + F.col("df_total")) / F.nullif(t2 / r + F.col("df_total"), F.lit(0.0)))
    kernel = (t2 * (1 - 1 / r) / 2) if math.isinf(d0) else (1 + F.col("df_total")) / 2 * F.log(ratio)
    return out.withColumn("lods", F.lit(math.log(proportion / (1 - proportion))) - F.log(r) / 2 + kernel)


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of Student's t."""
    return pd.Series(1 - stats.t_cdf(t.to_numpy(float), df.to_numpy(float)))


def model_results(fit: DataFrame, tail: str = "pos", noneg: bool = True, noint: bool = True) -> DataFrame:
    """(group, factor, fc, p): fc is the log odds, p is adjusted over all pairs before any row goes."""
    t = F.col("t") if tail == "pos" else -F.col("t") if tail == "neg" else F.abs("t")
    p = F.when(t.isNotNull(), t_tail(t, F.col("df_total")) * (2 if tail == "std" else 1))
    rows = fit.select(F.col("level").alias("group"), "factor", F.col("lods").alias("fc"), p.alias("raw"), F.lit(1).alias("all"))
    rows = stats.false_discovery(rows, "raw", "p", ["all"], ["factor", "group"]).withColumn("p", F.when(F.col("raw").isNotNull(), F.col("p")))
    if noneg:
        rows = rows.where("fc > 0")
    if noint:
        rows = rows.where(F.col("group") != "(Intercept)")
    return rows.select("group", "factor", "fc", "p")


def annotate(h: DataFrame, meta: DataFrame, columns: list[str] | None = None, center: bool = True, max_levels: int = 200, tail: str = "pos", ident: str = "sample_id") -> DataFrame:
    """(design, group, factor, fc, p) for every categorical column."""
    out = None
    for name, design in prepare.designs(meta, columns, max_levels, ident).items():
        groups = design.select(F.col(ident).alias("sample_id"), "level")
        one = model_results(moderated(model_fit(h, groups, center)), tail).withColumn("design", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --- tables behind the plots ----------------------------------------------------------------------


def leaf_order(rows: np.ndarray, binary: bool = False) -> list[int]:
    """Leaf order of Ward's clustering (Lance-Williams on squared distances); for a few hundred rows on the driver."""
    n = len(rows)
    if n < 3:
        return list(range(n))
    if binary:
        on = rows != 0
        both, either = (on[:, None] & on[None]).sum(2), (on[:, None] | on[None]).sum(2)
        d = (1 - both / np.maximum(either, 1)) ** 2
    else:
        d = ((rows[:, None] - rows[None]) ** 2).sum(2)
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, leaves, live = np.ones(n), {i: [i] for i in range(n)}, list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        i, j = sorted((live[a], live[b]))
        for k in live:
            if k not in (i, j):
                s = size[i] + size[j] + size[k]
                d[i, k] = d[k, i] = ((size[i] + size[k]) * d[i, k] + (size[j] + size[k]) * d[j, k] - size[k] * d[i, j]) / s
        size[i] += size[j]
        leaves[i] += leaves.pop(j)
        live.remove(j)
    return leaves[live[0]]


def annotation_plot(results: DataFrame, top: float = 100.0) -> DataFrame:
    """(group, factor, fc, neglog10): missing and negative fc are 0, fc is 0 where -log10 p rounds to 0; -log10 is at most `top`; empty factors and groups go."""
    cells = results.select("group").distinct().crossJoin(results.select("factor").distinct()).join(results, ["group", "factor"], "left")
    score = F.least(-F.log10(F.greatest(F.coalesce("p", F.lit(1.0)), F.lit(1e-300))), F.lit(top)) + 0.0
    fc = F.greatest(F.coalesce("fc", F.lit(0.0)), F.lit(0.0))
    cells = cells.select("group", "factor", F.when(F.rint(score) == 0, 0.0).otherwise(fc).alias("fc"), score.alias("neglog10"))
    by = lambda c: F.max("fc").over(W.partitionBy(c)) > 0
    return cells.withColumn("a", by("group")).withColumn("b", by("factor")).where("a and b").drop("a", "b")


def metadata_plot(h: DataFrame, groups: DataFrame) -> DataFrame:
    """Stacked shares: (factor label, group, share, upto)."""
    upto = F.sum("share").over(W.partitionBy("factor").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    return metadata_summary(h, groups).select(F.concat(F.lit("NMF_"), (F.col("factor") + 1).cast("string")).alias("label"), F.col("level").alias("group"), "share", upto.alias("upto"))
