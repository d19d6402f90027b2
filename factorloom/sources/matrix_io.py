"""Sources and sinks of matrices and models: Parquet, in both groupings, and containers of named tables."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, matrix, nmf, prepare, rank


@dataclass
class Container:
    """Assays (matrices), metadata, reductions (models) and graphs by name."""

    assays: dict[str, DataFrame] = field(default_factory=dict)
    meta: DataFrame | None = None
    reductions: dict[str, nmf.Model] = field(default_factory=dict)
    graphs: dict[str, DataFrame] = field(default_factory=dict)

    def assay(self, name: str | None = None) -> DataFrame:
        return self.assays[name or next(iter(self.assays))]

    def reduction(self, name: str = "nmf") -> nmf.Model:
        return self.reductions[name]

    def covariate(self, name: str) -> DataFrame:
        return self.meta.select("sample_id", name)

    def set_covariate(self, values: DataFrame, name: str) -> None:
        self.meta = self.meta.drop(name).join(values.select("sample_id", name), "sample_id", "left")


def write_matrix(m: DataFrame, path: str, partitions: int | None = None) -> None:
    """Both groupings, sorted within files so that the id ranges prune and delta encoding bites."""
    for by, other in (("col_id", "row_id"), ("row_id", "col_id")):
        rows = m.repartitionByRange(partitions, by) if partitions else m.repartitionByRange(by)
        rows.sortWithinPartitions(by, "value", other).write.mode("overwrite").parquet(f"{path}/by_{by}")


def read_matrix(spark: SparkSession, path: str, by: str = "col_id") -> DataFrame:
    return spark.read.parquet(f"{path}/by_{by}")


def build(chunks: list[DataFrame], widths: list[int]) -> DataFrame:
    """Chunks side by side in one matrix."""
    return matrix.append(chunks, widths)


def write_model(model: nmf.Model, path: str) -> None:
    spark = model.w.sparkSession
    model.w.write.mode("overwrite").parquet(f"{path}/w")
    model.h.write.mode("overwrite").parquet(f"{path}/h")
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.d)], "factor int, d double").write.mode("overwrite").parquet(f"{path}/d")


def read_model(spark: SparkSession, path: str) -> nmf.Model:
    d = spark.read.parquet(f"{path}/d").orderBy("factor").toPandas()["d"].to_numpy()
    return nmf.Model.from_parts(spark.read.parquet(f"{path}/w"), np.asarray(d), spark.read.parquet(f"{path}/h"))


def file_name(title: str) -> str:
    return re.sub("[^a-zA-Z]", "", title)


def pipeline(spark: SparkSession, source: str, title: str, target: str, meta: DataFrame | None = None, **options) -> nmf.Model:
    """Reads a matrix, normalizes raw counts, fits, annotates, and writes model, annotation, metadata and run time below target/<title's letters>."""
    began = time.time()
    m = read_matrix(spark, source)
    model = rank.run(m, **options)
    out = f"{target}/{file_name(title)}"
    write_model(model, out)
    if meta is not None:
        meta.write.mode("overwrite").parquet(f"{out}/metadata")
        found = annotate.annotate(model.long("h"), meta)
        if found is not None:
            found.write.mode("overwrite").parquet(f"{out}/annotation")
    spark.createDataFrame([(title, time.time() - began)], "dataset string, runtime double").write.mode("overwrite").parquet(f"{out}/run")
    return model


def run_lengths(runs: DataFrame) -> DataFrame:
    """A run-length coded column (col_id, at, value, n) as cells: the place in the column is the row. Runs of zeros count for the places, but make no cells."""
    return matrix.rle_decode(runs, ["col_id"], where="value <> 0").select(F.col("place").alias("row_id"), "col_id", "value")


__all__ = ["Container", "build", "file_name", "pipeline", "prepare", "read_matrix", "read_model", "run_lengths", "write_matrix", "write_model"]
