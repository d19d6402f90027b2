"""Set enrichment of factor weights: running-sum scores, permutation p-values, heatmap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rng, stats


def sized_sets(sets: DataFrame, features: DataFrame, min_size: int = 10, max_size: int = 500) -> DataFrame:
    """Members that are features, of sets with more than min_size and fewer than max_size of them; sets(set_id, feature_id)."""
    known = sets.select("set_id", "feature_id").distinct().join(features.select("feature_id").distinct(), "feature_id", "left_semi")
    n = known.groupBy("set_id").agg(F.count("*").alias("n")).where((F.col("n") > min_size) & (F.col("n") < max_size))
    return known.join(n, "set_id")


def rank_features(w: DataFrame) -> DataFrame:
    """(factor, feature_id, weight, pos, total): features with any weight, by weight downwards, then id; w(feature_id, factor, weight)."""
    used = w.groupBy("feature_id").agg(F.max("weight").alias("m")).where("m <> 0").select("feature_id")
    rows = w.join(used, "feature_id", "left_semi")
    by = W.partitionBy("factor")
    return rows.select("factor", "feature_id", "weight", F.row_number().over(by.orderBy(F.col("weight").desc(), "feature_id")).alias("pos"), F.count("*").over(by).alias("total"))


def enrichment_scores(w: DataFrame, sets: DataFrame, min_size: int = 10, max_size: int = 500) -> DataFrame:
    """(set_id, factor, n, es): the largest running sum; it is reached at a member, so only members are looked at."""
    ranked = rank_features(w)
    members = sized_sets(sets, ranked, min_size, max_size)
    return _scores(ranked.join(members, "feature_id"), ["set_id", "factor"], F.col("pos"))


def _scores(rows: DataFrame, by: list[str], pos: Column) -> DataFrame:
    rows = rows.withColumn("_pos", pos)
    group, running = W.partitionBy(*by), W.partitionBy(*by).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    hit = F.sum(F.abs("weight")).over(running) / F.nullif(F.sum(F.abs("weight")).over(group), F.lit(0.0))
    miss = (F.col("_pos") - F.count("*").over(running)) / (F.col("total") - F.col("n"))
    rows = rows.withColumn("_run", F.coalesce(hit, F.lit(0.0)) - miss)
    return rows.groupBy(*by, "n").agg(F.greatest(F.max("_run"), F.lit(0.0)).alias("es"))


def gsea(w: DataFrame, sets: DataFrame, min_size: int = 10, max_size: int = 500, permutations: int = 100, seed: int = 1) -> DataFrame:
    """(set_id, factor, es, nes, pval, padj): p from permuted positions, drawn by the counter-based hash; 1 / (permutations + 1) at least.

    The null of a set depends on its size and the factor alone, so sets of one size share it.
    """
    ranked = rank_features(w)
    observed = enrichment_scores(w, sets, min_size, max_size)
    sizes = observed.select("n", "factor").distinct()
    draws = sizes.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = rng.hash64(seed, F.col("perm") * 1_000_003 + F.col("factor"), F.col("feature_id"))
    chosen = F.row_number().over(W.partitionBy("factor", "perm").orderBy(order, "feature_id"))
    shuffled = ranked.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("draw", chosen).where(F.col("draw") < max_size)
    null = draws.join(shuffled, ["factor", "perm"]).where("draw <= n")
    null = _null_scores(null)
    both = observed.join(null.withColumnRenamed("es", "null_es"), ["n", "factor"])
    out = both.groupBy("set_id", "factor", "n").agg(
        F.first("es").alias("es"), F.avg("null_es").alias("mean"), F.sum((F.col("null_es") >= F.col("es")).cast("int")).alias("above"), F.count("*").alias("perms"),
    )
    out = out.select("set_id", "factor", "es", (F.col("es") / F.nullif("mean", F.lit(0.0))).alias("nes"), ((F.col("above") + 1) / (F.col("perms") + 1)).alias("pval"))
    return stats.false_discovery(out, "pval", "padj", ["factor"], ["set_id"])


def _null_scores(rows: DataFrame) -> DataFrame:
    by = ["n", "factor", "perm"]
    rows = rows.withColumn("_pos", F.col("pos"))
    group, running = W.partitionBy(*by), W.partitionBy(*by).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    hit = F.coalesce(F.sum(F.abs("weight")).over(running) / F.nullif(F.sum(F.abs("weight")).over(group), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("_run", hit - (F.col("_pos") - F.count("*").over(running)) / (F.col("total") - F.col("n")))
    return rows.groupBy(*by).agg(F.greatest(F.max("_run"), F.lit(0.0)).alias("es"))


def pad(results: DataFrame) -> DataFrame:
    """Every set with every factor, nulls where there was no row."""
    return results.select("set_id").distinct().crossJoin(results.select("factor").distinct()).join(results, ["set_id", "factor"], "left")


def heatmap(results: DataFrame, per_factor: int = 3, drop_common: bool = True) -> DataFrame:
    """(set_id, factor, share, label): a factor's top sets by their share of -log10 padj among significant ones; of those picked, sets significant in over half the factors go."""
    score = -F.log10(F.greatest(F.coalesce("padj", F.lit(1.0)), F.lit(1e-300)))
    rows = pad(results).withColumn("score", score)
    by_set = W.partitionBy("set_id")
    rows = rows.withColumn("share", F.col("score") / F.nullif(F.sum("score").over(by_set), F.lit(0.0)))
    limit = -F.log10(F.lit(0.05))
    rows = rows.withColumn("hits", F.sum((F.col("score") > limit).cast("int")).over(by_set)).withColumn("k", F.count("*").over(by_set))
    top = F.row_number().over(W.partitionBy("factor").orderBy(F.round("share", 9).desc(), "set_id"))
    picked = rows.where(F.col("score") > limit).withColumn("r", top).where(F.col("r") <= per_factor).select("set_id").distinct()
    if drop_common:
        rows = rows.where(F.col("hits") <= F.col("k") / 2)
    name = F.col("set_id").cast("string")
    label = F.when(F.length(name) > 48, F.concat(F.substring(name, 1, 45), F.lit("..."))).otherwise(name)
    return rows.join(picked, "set_id", "left_semi").select("set_id", "factor", "share", label.alias("label"))
