"""Spatial and factor-space neighbour graphs as edge tables (dst, src, weight).

Points meet through grid cells as wide as the radius: each point is copied to its nine cells, so the join is
by equality and no pair further apart than two cells is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.distances import METRICS


def near_pairs(coords: DataFrame, radius: float, closed: bool = True) -> DataFrame:
    """(dst, src, d) with d <= radius (or < if not closed), pairs of a point with itself included; coords(sample_id, x, y)."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    here = coords.select(F.col("sample_id").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    there = coords.select(F.col("sample_id").alias("src"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("gx"), cell("y").alias("gy"), near.alias("o"))
    there = there.select("src", "x2", "y2", (F.col("gx") + F.col("o.a")).alias("cx"), (F.col("gy") + F.col("o.b")).alias("cy"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d = here.join(there, ["cx", "cy"]).select("dst", "src", F.sqrt(dx * dx + dy * dy).alias("d"))
    return d.where(F.col("d") <= radius if closed else F.col("d") < radius)


def spatial_graph(coords: DataFrame, max_dist: float, max_k: int = 100) -> DataFrame:
    """The first max_k neighbours by id nearer than max_dist, the point itself included; (max_dist - d) / max_dist, shares per dst."""
    first = F.row_number().over(W.partitionBy("dst").orderBy("src"))
    edges = near_pairs(coords, max_dist, closed=False).withColumn("r", first).where(F.col("r") <= max_k)
    edges = edges.withColumn("w", (max_dist - F.col("d")) / max_dist).where("w > 0")
    return edges.select("dst", "src", (F.col("w") / F.sum("w").over(W.partitionBy("dst"))).alias("weight"))


def local_knn(vectors: DataFrame, coords: DataFrame, k: int, radius: float, metric: str = "euclidean", similarity: bool = False, max_dist: float = 0.0) -> DataFrame:
    """k nearest in factor space among spatial neighbours; vectors(sample_id, v). Ties go to the smaller id; zero distances take a place but are no edges."""
    pairs = near_pairs(coords, radius).where("dst <> src").select("dst", "src")
    both = pairs.join(vectors.select(F.col("sample_id").alias("dst"), F.col("v").alias("p")), "dst").join(vectors.select(F.col("sample_id").alias("src"), F.col("v").alias("q")), "src")
    # rounded to 9 digits, so that equal distances tie whatever the order of summation
    value = F.round(METRICS[metric](F.col("p"), F.col("q")), 9)
    if similarity and metric in ("jaccard", "cosine"):
        value = F.round(1 - value, 9)
    found = both.select("dst", "src", value.alias("weight"))
    if max_dist:
        found = found.where(F.col("weight") <= max_dist)
    rank = F.row_number().over(W.partitionBy("dst").orderBy("weight", "src"))
    return found.withColumn("r", rank).where((F.col("r") <= k) & (F.col("weight") != 0)).drop("r")


def shared_neighbours(graph: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Jaccard similarity of neighbour sets above the minimum; each node with neighbours has 1 with itself."""
    nb = graph.select("dst", "src").distinct()
    sizes = nb.groupBy("dst").agg(F.count("*").alias("n"))
    a, b = nb.withColumnRenamed("dst", "a"), nb.withColumnRenamed("dst", "b")
    common = a.join(b, "src").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    full = common.join(sizes.select(F.col("dst").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("dst").alias("b"), F.col("n").alias("nb")), "b")
    found = full.select(F.col("a").alias("dst"), F.col("b").alias("src"), (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("weight"))
    return found.where(F.col("weight") > min_similarity).unionByName(sizes.select("dst", F.col("dst").alias("src"), F.lit(1.0).alias("weight")))


def find_local_neighbours(vectors: DataFrame, coords: DataFrame, k: int = 20, radius: float = 4.0, metric: str = "euclidean", use_dist: bool = True, compute_snn: bool = True,
                          prune_snn: float = 1 / 15, prune_knn: float = 0.1, return_dist: bool = False) -> dict[str, DataFrame]:
    """The neighbour graph (1s unless distances are asked for), and the shared-neighbour graph."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    if k < 1 or radius <= 0:
        raise ValueError("k and radius must be positive")
    knn = local_knn(vectors, coords, k, radius, metric, not use_dist, prune_knn)
    if not return_dist:
        knn = knn.withColumn("weight", F.lit(1.0))
    return {"knn": knn} | ({"snn": shared_neighbours(knn, prune_snn)} if compute_snn else {})


def edge_clusters(graph: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per node the number of its edges in each cluster; clusters(dst, src, cluster)."""
    return graph.join(clusters, ["dst", "src"]).groupBy("dst", "cluster").agg(F.count("*").alias("n"))


def differentiate(h: DataFrame, graph: DataFrame) -> DataFrame:
    """Per edge and factor the rise and the fall from dst to src; h(sample_id, factor, weight)."""
    a = h.select(F.col("sample_id").alias("src"), "factor", F.col("weight").alias("s"))
    b = h.select(F.col("sample_id").alias("dst"), "factor", F.col("weight").alias("t"))
    both = graph.select("dst", "src").join(a, "src").join(b, ["dst", "factor"])
    change = F.col("t") - F.col("s")
    return both.select("dst", "src", "factor", F.greatest(change, F.lit(0.0)).alias("up"), F.greatest(-change, F.lit(0.0)).alias("down"))
