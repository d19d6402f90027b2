"""The matrices that the queries work on, from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import widen


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return widen(spark.read.parquet(f"{sf}/{name}.parquet"))


def parts_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity of each part bought by each customer: (row_id, col_id, value)."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("row_id"), F.col("o_custkey").alias("col_id")).agg(F.sum("l_quantity").alias("value"))


M = "m AS MATERIALIZED (SELECT l_partkey AS row_id, o_custkey AS col_id, SUM(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("level"))


SEG = "seg AS (SELECT c_custkey AS sample_id, c_mktsegment AS level FROM customer)"


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for H: per customer the spending by order status, (sample_id, factor, weight), exact to the cent."""
    status = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).cast("int") - 1
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample_id"), status.alias("factor")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e8).alias("weight"))


H = """h AS MATERIALIZED (SELECT o_custkey AS sample_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END AS factor,
 CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e8 AS weight FROM orders GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"))


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 25).cast("double").alias("x"), F.floor(F.col("vec_id") / 25).cast("double").alias("y"))


V = "v AS (SELECT vec_id AS sample_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
C = "c AS (SELECT vec_id AS sample_id, CAST(vec_id % 25 AS DOUBLE) AS x, CAST(vec_id // 25 AS DOUBLE) AS y FROM embeddings)"
