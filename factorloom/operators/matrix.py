"""Sparse matrices as DataFrames (row_id, col_id, value) without zeros, and their compressed forms.

Everything is an equi-join or an aggregation on an id, so it partitions by row or by column. Compressed
forms hold one row per column (csc), or per column and distinct value (vcsc, and ivcsc with delta-coded
indices); Parquet's dictionary and delta encodings do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# --- construction -------------------------------------------------------------------------------


def from_coo(df: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value") -> DataFrame:
    """Cells that occur more than once are added up; zeros and nulls go."""
    cells = df.groupBy(F.col(row).cast("long").alias("row_id"), F.col(col).cast("long").alias("col_id")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    return cells.where("value <> 0")


def from_csc(columns: DataFrame) -> DataFrame:
    """(col_id, idx array, val array), one row per column."""
    cell = F.explode(F.arrays_zip("idx", "val")).alias("c")
    return columns.select("col_id", cell).select(F.col("c.idx").cast("long").alias("row_id"), "col_id", F.col("c.val").cast("double").alias("value")).where("value <> 0")


def from_csc_arrays(spark, indices: Sequence[int], pointers: Sequence[int], values: Sequence[float]) -> DataFrame:
    """From the three arrays of a matrix that the driver holds."""
    rows = [(j, list(map(int, indices[a:b])), list(map(float, values[a:b]))) for j, (a, b) in enumerate(zip(pointers, pointers[1:])) if b > a]
    return from_csc(spark.createDataFrame(rows, "col_id long, idx array<long>, val array<double>"))


def from_dense(vectors: DataFrame, ident: str, values: str, row_major: bool = False) -> DataFrame:
    """One dense vector per row of the input: a column of the matrix, or a row if row_major."""
    cells = vectors.select(F.col(ident).cast("long").alias("a"), F.posexplode(values).alias("b", "value"))
    return cells.select(F.col("b" if not row_major else "a").cast("long").alias("row_id"), F.col("a" if not row_major else "b").cast("long").alias("col_id"), F.col("value").cast("double").alias("value")).where("value <> 0")


def rle_decode(runs: DataFrame, keys: Sequence[str] = (), value: str = "value", n: str = "n", at: str = "at", where: str = "true") -> DataFrame:
    """Runs (value, n) in order of `at` to single values with their place: a column's run-length coding undone. Only runs that meet `where` are written out."""
    before = F.coalesce(F.sum(n).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("_b", before).where(where).select(*keys, F.posexplode(F.array_repeat(value, F.col(n).cast("int"))).alias("_k", value), "_b").select(*keys, (F.col("_b") + F.col("_k")).alias("place"), value)


# --- compressed forms ---------------------------------------------------------------------------


def to_csc(m: DataFrame) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("row_id", "value")))
    return m.groupBy("col_id").agg(cells.alias("c")).select("col_id", F.col("c.row_id").alias("idx"), F.col("c.value").alias("val"))


def to_vcsc(m: DataFrame) -> DataFrame:
    return m.groupBy("col_id", "value").agg(F.sort_array(F.collect_list("row_id")).alias("idx"))


def to_ivcsc(m: DataFrame) -> DataFrame:
    """As vcsc, indices as gaps; width is the bytes that the largest gap needs."""
    gaps = F.transform("idx", lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get("idx", i - 1)))
    out = to_vcsc(m).select("col_id", "value", gaps.alias("gaps"))
    return out.withColumn("width", byte_width(F.array_max("gaps")))


def byte_width(x: Column) -> Column:
    out = F.lit(1)
    for n in range(1, 8):
        out = F.when(x >= F.lit(1 << (8 * n)), n + 1).otherwise(out)
    return out


def from_vcsc(v: DataFrame) -> DataFrame:
    return v.select(F.explode("idx").alias("row_id"), "col_id", "value")


def from_ivcsc(v: DataFrame) -> DataFrame:
    return v.select("col_id", "value", F.posexplode("gaps").alias("k", "gap")).select(
        F.sum("gap").over(W.partitionBy("col_id", "value").orderBy("k").rowsBetween(W.unboundedPreceding, 0)).alias("row_id"), "col_id", "value"
    )


def to_dense(m: DataFrame, n_rows: int) -> DataFrame:
    """(col_id, values array of n_rows): columns without cells are absent."""
    columns = to_csc(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most := max(1, (1 << 22) // n_rows)):
                part = batch.slice(at, most)
                idx, val = part.column(1), part.column(2)
                own = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(idx.offsets)))
                dense = np.zeros((part.num_rows, n_rows))
                dense[own, np.asarray(idx.flatten())] = np.asarray(val.flatten())
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * n_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], names=["col_id", "values"])

    return columns.select(F.col("col_id").cast("long"), F.col("idx").cast("array<long>"), F.col("val").cast("array<double>")).mapInArrow(run, "col_id long, values array<double>")


def byte_size(m: DataFrame, level: int, n_cols: int, value_bytes: int = 4, index_bytes: int = 8) -> DataFrame:
    """One row: the bytes that the matrix takes at a compression level (1 csc, 2 vcsc, 3 ivcsc)."""
    if level == 1:
        size = 24 + (value_bytes + index_bytes) * F.count("*") + index_bytes * (n_cols + 1)
        return m.agg(size.cast("long").alias("bytes"))
    if level == 2:
        runs = m.groupBy("col_id", "value").agg(F.count("*").alias("n"))
        size = index_bytes * n_cols + F.sum((value_bytes + index_bytes) + index_bytes * F.col("n"))
        return runs.agg(size.cast("long").alias("bytes"))
    gap = F.col("row_id") - F.coalesce(F.lag("row_id").over(W.partitionBy("col_id", "value").orderBy("row_id")), F.lit(0))
    runs = m.withColumn("gap", gap).groupBy("col_id", "value").agg(F.count("*").alias("n"), byte_width(F.max("gap")).alias("w"))
    return runs.agg(F.sum(value_bytes + 1 + F.col("w") * (F.col("n") + 1)).cast("long").alias("bytes"))


# --- access -------------------------------------------------------------------------------------


def coefficient(m: DataFrame, places: DataFrame) -> DataFrame:
    """(row_id, col_id) pairs with their value, 0 where there is none."""
    return places.join(m, ["row_id", "col_id"], "left").select("row_id", "col_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def vector(m: DataFrame, col_id: int) -> DataFrame:
    return m.where(F.col("col_id") == col_id).select("row_id", "value")


def vector_info(m: DataFrame) -> DataFrame:
    """Per column: stored cells and distinct values."""
    return m.groupBy("col_id").agg(F.count("*").alias("n_indices"), F.countDistinct("value").alias("n_values"))


def dimensions(m: DataFrame) -> DataFrame:
    return m.agg((F.max("row_id") + 1).alias("n_rows"), (F.max("col_id") + 1).alias("n_cols"), F.count("*").alias("nnz"))


def iterate(m: DataFrame) -> DataFrame:
    """Cells in storage order by column: place in the column, and whether a run of equal values begins."""
    w = W.partitionBy("col_id").orderBy("value", "row_id")
    return m.select("col_id", "row_id", "value", (F.row_number().over(w) - 1).alias("place"), F.coalesce(F.lag("value").over(w) != F.col("value"), F.lit(True)).alias("new_run"))


# --- arithmetic ---------------------------------------------------------------------------------


def scale(m: DataFrame, factor: float) -> DataFrame:
    return m.withColumn("value", F.col("value") * factor).where("value <> 0")


def times_vector(m: DataFrame, x: DataFrame) -> DataFrame:
    """A x for x(col_id, x): (row_id, value); partial sums before the shuffle."""
    return m.join(x, "col_id").groupBy("row_id").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def times_matrix(m: DataFrame, b: DataFrame) -> DataFrame:
    """A B for B(col_id, k, x): (row_id, k, value)."""
    return m.join(b, "col_id").groupBy("row_id", "k").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def outer_sums(m: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Sum per column; with ids(col_id), 0 for columns without cells."""
    out = m.groupBy("col_id").agg(F.sum("value").alias("total"))
    return out if ids is None else ids.select("col_id").join(out, "col_id", "left").fillna(0.0, ["total"])


def inner_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("row_id").agg(F.sum("value").alias("total"))


def extremes(m: DataFrame, by: str, n_other: int) -> DataFrame:
    """Largest and smallest value per column or row; an absent cell counts as 0."""
    full = F.count("*") == n_other
    return m.groupBy(by).agg(
        F.when(full, F.max("value")).otherwise(F.greatest(F.max("value"), F.lit(0.0))).alias("largest"),
        F.when(full, F.min("value")).otherwise(F.least(F.min("value"), F.lit(0.0))).alias("smallest"),
    )


def summary(m: DataFrame) -> DataFrame:
    """One row: trace, total, Frobenius norm."""
    v = F.col("value")
    return m.agg(F.coalesce(F.sum(F.when(F.col("row_id") == F.col("col_id"), v)), F.lit(0.0)).alias("trace"), F.sum(v).alias("total"), F.sqrt(F.sum(v * v)).alias("norm"))


def vector_lengths(m: DataFrame) -> DataFrame:
    return m.groupBy("col_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.sum("value").alias("total"), F.count("*").alias("nnz"))


def column_dots(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """Dot products of the columns named by pairs(a, b); a pair without common rows gives 0."""
    left = pairs.join(m.withColumnRenamed("col_id", "a").withColumnRenamed("value", "x"), "a")
    both = left.join(m.withColumnRenamed("col_id", "b").withColumnRenamed("value", "y"), ["b", "row_id"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("dot", F.lit(0.0)).alias("dot"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def append(matrices: Sequence[DataFrame], widths: Sequence[int]) -> DataFrame:
    """Columns side by side; widths are the matrices' column counts."""
    out, at = None, 0
    for m, n in zip(matrices, widths):
        part = m.select("row_id", (F.col("col_id") + at).alias("col_id"), "value")
        out, at = part if out is None else out.unionByName(part), at + n
    return out


def slice_columns(m: DataFrame, start: int, end: int) -> DataFrame:
    return m.where((F.col("col_id") >= start) & (F.col("col_id") < end)).withColumn("col_id", F.col("col_id") - start)


def chunks(m: DataFrame, n_cols: int, n: int) -> list[DataFrame]:
    """Disjoint column chunks."""
    cuts = [n_cols * i // n for i in range(n + 1)]
    return [slice_columns(m, a, b) for a, b in zip(cuts, cuts[1:])]


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either that the other lacks; equal matrices give no rows. One shuffle: signed counts by cell."""
    cells = a.select("row_id", "col_id", "value", F.lit(1).alias("s")).unionByName(b.select("row_id", "col_id", "value", F.lit(-1).alias("s")))
    return cells.groupBy("row_id", "col_id", "value").agg(F.sum("s").alias("s")).where("s <> 0")


def equal(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty()
