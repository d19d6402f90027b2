"""Normalization, group balancing, re-binning, coding and design matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import average_rank, inverse_normal
from ..session import cut


def log_normalize(m: DataFrame, scale_factor: float = 1e4) -> DataFrame:
    """log1p(value / column sum * scale). The sums are aggregated before they meet the cells."""
    sums = m.groupBy("col_id").agg(F.sum("value").alias("_s"))
    return m.join(sums, "col_id").select("row_id", "col_id", F.log1p(F.col("value") / F.col("_s") * scale_factor).alias("value")).where("value <> 0")


def raw_counts(m: DataFrame) -> DataFrame:
    """One row: whether all values are whole numbers."""
    return m.agg((F.sum(F.col("value").cast("long")) == F.sum("value")).alias("is_raw"))


def is_raw(m: DataFrame) -> bool:
    return bool(raw_counts(m).first()[0])


def group_codes(meta: DataFrame, column: str, ident: str = "sample_id") -> DataFrame:
    """sample_id and code: places of the levels in sorted order, from 0. Null levels are refused."""
    levels = meta.select(F.col(column).alias("level")).distinct()
    if not levels.where("level is null").isEmpty():
        raise ValueError(f"{column} has missing values")
    # the levels of a category are few; ranking them needs one task
    coded = levels.select("level", (F.dense_rank().over(W.orderBy("level")) - 1).alias("code"))
    return meta.join(coded, meta[column] == coded["level"]).select(ident, "code")


def weight_by_split(m: DataFrame, codes: DataFrame) -> DataFrame:
    """Scales each group's cells so that its total equals that of group 0, which must have cells; codes(sample_id, code)."""
    cells = m.join(codes.withColumnRenamed("sample_id", "col_id"), "col_id")
    totals = cut(cells.groupBy("code").agg(F.sum("value").alias("s")))
    first = totals.where("code = 0").first()
    if first is None and not totals.isEmpty():
        raise ValueError("no sample of group 0 has cells")
    scaled = F.col("value") / (F.col("s") / F.lit(first["s"] if first else 1.0))
    return cells.join(totals, "code").select("row_id", "col_id", F.when(F.col("code") == 0, F.col("value")).otherwise(scaled).alias("value"))


def select_features(m: DataFrame, features: DataFrame) -> DataFrame:
    """Rows named by features(row_id, place); the new row_id is the place."""
    return m.join(features, "row_id").select(F.col("place").cast("long").alias("row_id"), "col_id", "value")


def rasterize_rows(m: DataFrame, n_rows: int, n: int = 10) -> DataFrame:
    """Means of blocks of n rows (zeros count); a last block that isn't full is dropped."""
    full = n_rows // n * n
    return m.where(F.col("row_id") < full).groupBy(F.floor(F.col("row_id") / n).cast("long").alias("row_id"), "col_id").agg((F.sum("value") / n).alias("value"))


def rescale_spatial(coords: DataFrame) -> DataFrame:
    """To a lattice: per axis less the minimum, over the maximum, over the median step of the distinct values; rounded half to even."""
    out = coords
    for axis in ("x", "y"):
        low_high = coords.agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
        unit = coords.crossJoin(F.broadcast(low_high)).select(((F.col(axis) - F.col("_a")) / (F.col("_b") - F.col("_a"))).alias("u")).distinct()
        # in ranges: steps within each, and those from one range to the next
        ranged = cut(unit.repartitionByRange("u").select("u", F.spark_partition_id().alias("p")))
        within = ranged.select((F.col("u") - F.lag("u").over(W.partitionBy("p").orderBy("u"))).alias("d"))
        edges = ranged.groupBy("p").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
        between = edges.select((F.col("lo") - F.lag("hi").over(W.orderBy("lo"))).alias("d"))
        step = within.unionByName(between).agg(F.median("d").alias("_d"))
        both = low_high.crossJoin(step)
        out = out.crossJoin(F.broadcast(both)).withColumn(axis, F.rint((F.col(axis) - F.col("_a")) / (F.col("_b") - F.col("_a")) * (1 / F.col("_d")))).drop("_a", "_b", "_d")
    return out


def normal_scores(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Inverse normal of (average rank - 0.5) / number of distinct values; null where value is or where that is not below 1."""
    present = F.when(F.col(value).isNotNull(), 1)
    rank = average_rank(F.col(value), [*map(F.col, by), present])
    level = F.when(F.col(value).isNotNull(), F.dense_rank().over(W.partitionBy(*by, present).orderBy(value)))
    df = df.withColumn("_rank", rank).withColumn("_level", level)
    distinct = F.max("_level").over(W.partitionBy(*by))
    share = F.when(F.col(value).isNotNull(), (F.col("_rank") - 0.5) / distinct)
    return df.withColumn("share", share).drop("_rank", "_level").withColumn("score", inverse_normal("share"))


def categorical_columns(meta: DataFrame, columns: list[str] | None = None, max_levels: int = 200) -> list[str]:
    """Categorical columns with 2 to max_levels levels; all are counted in one aggregation."""
    kinds = dict(meta.dtypes)
    asked = [c for c in (columns or meta.columns) if kinds.get(c) in ("string", "boolean", "int", "tinyint", "smallint")]
    if not asked:
        return []
    counts = meta.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in asked]).first()
    near = [c for c in asked if counts[c] <= 2 * max_levels]
    exact = meta.agg(*[F.countDistinct(c).alias(c) for c in near]).first() if near else {}
    return [c for c in near if 2 <= exact[c] <= max_levels]


def level_counts(meta: DataFrame, columns: list[str], max_levels: int = 200) -> DataFrame:
    """column, n_levels, kept of each column."""
    counts = meta.agg(*[F.countDistinct(c).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column, n_levels)").withColumn("kept", F.col("n_levels").between(2, max_levels))


def model_matrix(meta: DataFrame, field: str, ident: str = "sample_id", one_hot: bool = True) -> DataFrame:
    """Long form (sample_id, level, value): one-hot, or an intercept and all levels but the first. Null levels drop out."""
    rows = meta.where(F.col(field).isNotNull()).select(ident, F.col(field).cast("string").alias("level"), F.lit(1.0).alias("value"))
    if one_hot:
        return rows
    first = rows.agg(F.min("level").alias("first"))
    dummies = rows.crossJoin(F.broadcast(first)).where("level <> first").drop("first")
    return rows.select(ident, F.lit("(Intercept)").alias("level"), "value").unionByName(dummies)


def designs(meta: DataFrame, columns: list[str] | None = None, max_levels: int = 200, ident: str = "sample_id") -> dict[str, DataFrame]:
    return {c: model_matrix(meta, c, ident) for c in categorical_columns(meta, columns, max_levels) if c != ident}


def check_designs(found: dict[str, DataFrame]) -> None:
    for name, design in found.items():
        if not {"level", "value"} <= set(design.columns):
            raise ValueError(f"design {name} lacks level or value")


def factor_weights(ranges: DataFrame, w: DataFrame, factors: list[int]) -> DataFrame:
    """ranges(feature_id, ...) with one column per factor's weight."""
    wide = w.where(F.col("factor").isin(factors)).groupBy("feature_id").pivot("factor", factors).agg(F.first("weight"))
    named = wide.select("feature_id", *[F.col(str(f)).alias(f"NMF_{f}") for f in factors])
    return ranges.join(named, "feature_id")


def make_unique(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get .1, .2 ... behind the first."""
    k = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("."), k.cast("string"))))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b) and their share within a."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy(a)))


def majority(df: DataFrame, a: str, b: str) -> DataFrame:
    """The most frequent b of each a; ties go to the smallest."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.groupBy(a).agg(F.min_by(b, F.struct(-F.col("n"), F.col(b))).alias("label"), F.max("n").alias("n"))


def quality_control(m: DataFrame, marked: DataFrame, least: int = 200, most: int = 2500, share: float = 0.05) -> DataFrame:
    """The cells of samples with more than `least` and fewer than `most` features, of whose total the marked(row_id) features hold less than `share`."""
    cells = m.join(marked.select("row_id", F.lit(1).alias("mark")), "row_id", "left")
    sums = cells.groupBy("col_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.when(F.col("mark") == 1, F.col("value")).otherwise(0.0)).alias("t"))
    kept = sums.where((F.col("n") > least) & (F.col("n") < most) & (F.col("t") < share * F.col("s"))).select("col_id")
    return m.join(kept, "col_id", "left_semi").select("row_id", "col_id", "value")
