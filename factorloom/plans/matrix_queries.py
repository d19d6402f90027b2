"""Queries of the matrix, preparation and kernel operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distances, rng
from ..operators import matrix, prepare
from ..session import cut, shared_dir
from ..sources import ivsparse, matrix_io
from . import fit_sql
from .fixtures import SEG, C, H, M, V, lattice, parts_customers, segments, shares, t, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


# --- sources ------------------------------------------------------------------------------------


@query("s1_rle_decode", f"WITH {M} SELECT row_id, col_id, value FROM m")
def s1(spark, sf):
    """Columns are run-length coded over their full height, then decoded."""
    m = parts_customers(spark, sf)
    from pyspark.sql import Window as W

    w = W.partitionBy("col_id").orderBy("row_id")
    gap = F.col("row_id") - F.coalesce(F.lag("row_id").over(w), F.lit(-1)) - 1
    runs = m.withColumn("gap", gap).select("col_id", F.explode(F.array(
        F.struct((F.col("row_id") * 2).alias("at"), F.lit(0.0).alias("value"), F.col("gap").alias("n")),
        F.struct((F.col("row_id") * 2 + 1).alias("at"), F.col("value"), F.lit(1).cast("long").alias("n")))).alias("r")).select("col_id", "r.*")
    return matrix_io.run_lengths(runs).select(F.col("row_id").cast("long").alias("row_id"), "col_id", "value")


@query("s3_write_both_groupings", f"WITH {M} SELECT row_id, col_id, value FROM m")
def s3(spark, sf):
    path = shared_dir(spark) + "/matrix"
    matrix_io.write_matrix(parts_customers(spark, sf), path)
    return matrix_io.read_matrix(spark, path, "row_id").select("row_id", "col_id", "value")


@query("s5_read_saved", f"WITH {M} SELECT row_id, col_id, value FROM m WHERE col_id BETWEEN 10 AND 40")
def s5(spark, sf):
    path = shared_dir(spark) + "/matrix"
    matrix_io.write_matrix(parts_customers(spark, sf), path)
    return matrix_io.read_matrix(spark, path).where("col_id between 10 and 40").select("row_id", "col_id", "value")


@query("s7_build_from_chunks", f"WITH {M} SELECT row_id, col_id, value FROM m WHERE col_id < 100 UNION ALL SELECT row_id, col_id, value FROM m WHERE col_id >= 100")
def s7(spark, sf):
    m = parts_customers(spark, sf)
    rest = m.where("col_id >= 100").withColumn("col_id", F.col("col_id") - 100)
    return matrix_io.build([m.where("col_id < 100"), rest], [100, 0])


# --- compressed forms ---------------------------------------------------------------------------


@query("s6_ivsparse", f"WITH {M} SELECT row_id, col_id, value FROM m")
def s6(spark, sf):
    """Written to the compressed binary file and read back."""
    m, path = cut(parts_customers(spark, sf)), f"{shared_dir(spark)}.ivsparse"
    top = m.agg(F.max("row_id"), F.max("col_id")).first()
    ivsparse.write(m, path, top[0] + 1, top[1] + 1)
    return ivsparse.read(spark, path, 1 << 16)


@query("v1_from_csc", f"WITH {M} SELECT row_id, col_id, value FROM m")
def v1(spark, sf):
    return matrix.from_csc(matrix.to_csc(parts_customers(spark, sf)))


@query("v2_from_coo", "SELECT l_partkey AS row_id, l_suppkey AS col_id, SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING SUM(l_quantity) <> 0")
def v2(spark, sf):
    return matrix.from_coo(t(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query("v3_from_dense", "SELECT CAST(i - 1 AS BIGINT) AS row_id, vec_id AS col_id, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i) WHERE embedding[i] <> 0")
def v3(spark, sf):
    return matrix.from_dense(t(spark, sf, "embeddings"), "vec_id", "embedding")


@query("v3_from_dense_row_major", "SELECT vec_id AS row_id, CAST(i - 1 AS BIGINT) AS col_id, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i) WHERE embedding[i] <> 0")
def v3b(spark, sf):
    return matrix.from_dense(t(spark, sf, "embeddings"), "vec_id", "embedding", row_major=True)


@query("v4_from_vectors", f"WITH {M} SELECT row_id, CASE col_id WHEN 7 THEN 0 ELSE 1 END AS col_id, value FROM m WHERE col_id IN (7, 11)")
def v4(spark, sf):
    m = parts_customers(spark, sf)
    one = lambda j: matrix.vector(m, j).withColumn("col_id", F.lit(0).cast("long"))
    out = matrix.append([one(7), one(11)], [1, 1])
    return out.select("row_id", F.col("col_id").cast("int").alias("col_id"), "value")


@query("v5_convert_levels", f"WITH {M} SELECT row_id, col_id, value FROM m")
def v5(spark, sf):
    m = parts_customers(spark, sf)
    back = matrix.from_vcsc(matrix.to_vcsc(matrix.from_ivcsc(matrix.to_ivcsc(m))))
    return back.select("row_id", "col_id", "value")


@query("v5_to_dense", "WITH a AS (SELECT l_suppkey AS j, l_linenumber AS i, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2), j AS (SELECT DISTINCT j FROM a) SELECT j.j AS col_id, string_agg(CAST(CAST(COALESCE(a.v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY r.i) AS v FROM j CROSS JOIN range(0, 8) r(i) LEFT JOIN a ON a.j = j.j AND a.i = r.i GROUP BY 1")
def v5d(spark, sf):
    m = matrix.from_coo(t(spark, sf, "lineitem"), "l_linenumber", "l_suppkey", "l_quantity")
    return matrix.to_dense(m, 8).select("col_id", F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), ",").alias("v"))


@query("v6_compress_vcsc", f"WITH {M} SELECT col_id, value, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS idx FROM m GROUP BY 1, 2")
def v6(spark, sf):
    return matrix.to_vcsc(parts_customers(spark, sf)).select("col_id", "value", F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx"))


_GAPS = "g AS (SELECT col_id, value, row_id, row_id - COALESCE(LAG(row_id) OVER (PARTITION BY col_id, value ORDER BY row_id), 0) AS gap FROM m)"
_WIDTH = "CASE WHEN MAX(gap) >= 16777216 THEN 4 WHEN MAX(gap) >= 65536 THEN 3 WHEN MAX(gap) >= 256 THEN 2 ELSE 1 END"


@query("v6_compress_ivcsc", f"WITH {M}, {_GAPS} SELECT col_id, value, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY row_id) AS gaps, {_WIDTH} AS width FROM g GROUP BY 1, 2")
def v6b(spark, sf):
    return matrix.to_ivcsc(parts_customers(spark, sf)).select("col_id", "value", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("gaps"), "width")


@query("v7_byte_size", f"""WITH {M}, {_GAPS}, n AS (SELECT MAX(col_id) + 1 AS c, COUNT(*) AS nnz FROM m), r AS (SELECT col_id, value, COUNT(*) AS k, {_WIDTH} AS w FROM g GROUP BY 1, 2)
SELECT 1 AS level, CAST(24 + 12 * nnz + 8 * (c + 1) AS BIGINT) AS bytes FROM n UNION ALL SELECT 2, CAST(8 * (SELECT c FROM n) + SUM(12 + 8 * k) AS BIGINT) FROM r UNION ALL SELECT 3, CAST(SUM(5 + w * (k + 1)) AS BIGINT) FROM r""")
def v7(spark, sf):
    m = cut(parts_customers(spark, sf))
    n = matrix.dimensions(m).first()["n_cols"]
    out = None
    for level in (1, 2, 3):
        one = matrix.byte_size(m, level, n).select(F.lit(level).alias("level"), "bytes")
        out = one if out is None else out.unionByName(one)
    return out


# --- access and arithmetic ----------------------------------------------------------------------


@query("v8_coefficient", f"WITH {M}, p AS (SELECT p_partkey AS row_id, CAST(3 AS BIGINT) AS col_id FROM part) SELECT p.row_id, p.col_id, COALESCE(value, 0) AS value FROM p LEFT JOIN m USING (row_id, col_id)")
def v8(spark, sf):
    places = t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.lit(3).cast("long").alias("col_id"))
    return matrix.coefficient(parts_customers(spark, sf), places)


@query("v9_vector", f"WITH {M} SELECT row_id, value FROM m WHERE col_id = 7")
def v9(spark, sf):
    return matrix.vector(parts_customers(spark, sf), 7)


@query("v9_vector_info", f"WITH {M} SELECT col_id, COUNT(*) AS n_indices, COUNT(DISTINCT value) AS n_values FROM m GROUP BY 1")
def v9b(spark, sf):
    return matrix.vector_info(parts_customers(spark, sf))


@query("v10_dimensions", f"WITH {M} SELECT MAX(row_id) + 1 AS n_rows, MAX(col_id) + 1 AS n_cols, COUNT(*) AS nnz FROM m")
def v10(spark, sf):
    return matrix.dimensions(parts_customers(spark, sf))


@query("v11_scalar", f"WITH {M} SELECT row_id, col_id, value * 2.5 AS value FROM m")
def v11(spark, sf):
    return matrix.scale(parts_customers(spark, sf), 2.5)


@query("v12_times_vector", f"WITH {M} SELECT row_id, round(SUM(value * c_acctbal), 2) AS value FROM m JOIN customer ON col_id = c_custkey GROUP BY 1")
def v12(spark, sf):
    x = t(spark, sf, "customer").select(F.col("c_custkey").alias("col_id"), F.col("c_acctbal").alias("x"))
    return rounded(matrix.times_vector(parts_customers(spark, sf), x), "value", digits=2)


@query("v13_times_matrix", f"WITH {M} SELECT row_id, c_mktsegment AS k, SUM(value) AS value FROM m JOIN customer ON col_id = c_custkey GROUP BY 1, 2")
def v13(spark, sf):
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("col_id"), F.col("c_mktsegment").alias("k"), F.lit(1.0).alias("x"))
    return matrix.times_matrix(parts_customers(spark, sf), b)


@query("v14_outer_sums", f"WITH {M} SELECT c_custkey AS col_id, COALESCE(SUM(value), 0) AS total FROM customer LEFT JOIN m ON col_id = c_custkey GROUP BY 1")
def v14(spark, sf):
    return matrix.outer_sums(parts_customers(spark, sf), t(spark, sf, "customer").select(F.col("c_custkey").alias("col_id")))


@query("v14_inner_sums", f"WITH {M} SELECT row_id, SUM(value) AS total FROM m GROUP BY 1")
def v14b(spark, sf):
    return matrix.inner_sums(parts_customers(spark, sf))


_EXT = "SELECT {0}, CASE WHEN COUNT(*) = {1} THEN MAX(value) ELSE GREATEST(MAX(value), 0) END AS largest, CASE WHEN COUNT(*) = {1} THEN MIN(value) ELSE LEAST(MIN(value), 0) END AS smallest FROM m GROUP BY 1"


@query("v15_column_extremes", f"WITH {M} " + _EXT.format("col_id", "(SELECT COUNT(*) FROM part)"))
def v15(spark, sf):
    return matrix.extremes(parts_customers(spark, sf), "col_id", t(spark, sf, "part").count())


@query("v15_row_extremes", f"WITH {M} " + _EXT.format("row_id", "(SELECT COUNT(*) FROM customer)"))
def v15b(spark, sf):
    return matrix.extremes(parts_customers(spark, sf), "row_id", t(spark, sf, "customer").count())


@query("v16_summary", f"WITH {M} SELECT COALESCE(SUM(CASE WHEN row_id = col_id THEN value END), 0) AS trace, SUM(value) AS total, round(sqrt(SUM(value * value)), 6) AS norm FROM m")
def v16(spark, sf):
    return rounded(matrix.summary(parts_customers(spark, sf)), "norm")


@query("v17_transpose", f"WITH {M} SELECT col_id AS row_id, row_id AS col_id, value FROM m")
def v17(spark, sf):
    return matrix.transpose(parts_customers(spark, sf))


@query("v18_append", f"WITH {M} SELECT row_id, col_id, value FROM m UNION ALL SELECT row_id, col_id + 20000, value FROM m WHERE col_id < 50")
def v18(spark, sf):
    m = parts_customers(spark, sf)
    return matrix.append([m, m.where("col_id < 50")], [20000, 50])


@query("v19_slice", f"WITH {M} SELECT row_id, col_id - 20 AS col_id, value FROM m WHERE col_id >= 20 AND col_id < 60")
def v19(spark, sf):
    return matrix.slice_columns(parts_customers(spark, sf), 20, 60)


@query("v20_difference", f"WITH {M}, b AS (SELECT row_id, col_id, CASE WHEN row_id = 5 THEN value + 1 ELSE value END AS value FROM m) SELECT row_id, col_id, value, CAST(1 AS BIGINT) AS s FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM b) UNION ALL SELECT row_id, col_id, value, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM m)")
def v20(spark, sf):
    m = parts_customers(spark, sf)
    return matrix.difference(m, m.withColumn("value", F.when(F.col("row_id") == 5, F.col("value") + 1).otherwise(F.col("value"))))


@query("v22_vector_lengths", f"WITH {M} SELECT col_id, round(sqrt(SUM(value * value)), 6) AS norm, SUM(value) AS total, COUNT(*) AS nnz FROM m GROUP BY 1")
def v22(spark, sf):
    return rounded(matrix.vector_lengths(parts_customers(spark, sf)), "norm")


@query("v22_dots", f"WITH {M}, p AS (SELECT a.c_custkey AS a, a.c_custkey + 1 AS b FROM customer a) SELECT p.a, p.b, COALESCE(SUM(x.value * y.value), 0) AS dot FROM p LEFT JOIN m x ON x.col_id = p.a LEFT JOIN m y ON y.col_id = p.b AND y.row_id = x.row_id GROUP BY 1, 2")
def v22b(spark, sf):
    pairs = t(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return matrix.column_dots(parts_customers(spark, sf), pairs)


@query("v23_iterate", f"WITH {M} SELECT col_id, row_id, value, ROW_NUMBER() OVER w - 1 AS place, COALESCE(LAG(value) OVER w <> value, TRUE) AS new_run FROM m WINDOW w AS (PARTITION BY col_id ORDER BY value, row_id)")
def v23(spark, sf):
    return matrix.iterate(parts_customers(spark, sf)).withColumn("place", F.col("place").cast("long"))


# --- preparation --------------------------------------------------------------------------------


@query("p1_log_normalize", f"WITH {M} SELECT row_id, col_id, round(ln(1 + value / SUM(value) OVER (PARTITION BY col_id) * 10000), 6) AS value FROM m")
def p1(spark, sf):
    return rounded(prepare.log_normalize(parts_customers(spark, sf)), "value")


@query("p2_raw_counts", f"WITH {M} SELECT SUM(CAST(trunc(value) AS BIGINT)) = SUM(value) AS is_raw FROM m")
def p2(spark, sf):
    return prepare.raw_counts(parts_customers(spark, sf))


@query("p3_weight_by_split", f"WITH {M}, {SEG}, k AS (SELECT sample_id, DENSE_RANK() OVER (ORDER BY level) - 1 AS code FROM seg), s AS (SELECT code, SUM(value) AS s FROM m JOIN k ON col_id = sample_id GROUP BY 1) SELECT row_id, col_id, round(CASE WHEN code = 0 THEN value ELSE value / (s / (SELECT s FROM s WHERE code = 0)) END, 6) AS value FROM m JOIN k ON col_id = sample_id JOIN s USING (code)")
def p3(spark, sf):
    codes = prepare.group_codes(segments(spark, sf), "level")
    return rounded(prepare.weight_by_split(parts_customers(spark, sf), codes), "value")


@query("p4_group_codes", f"WITH {SEG} SELECT sample_id, CAST(DENSE_RANK() OVER (ORDER BY level) - 1 AS INTEGER) AS code FROM seg")
def p4(spark, sf):
    return prepare.group_codes(segments(spark, sf), "level").withColumn("code", F.col("code").cast("int"))


@query("p5_select_features", f"WITH {M}, f AS (SELECT p_partkey AS row_id, ROW_NUMBER() OVER (ORDER BY p_partkey DESC) - 1 AS place FROM part WHERE p_size <= 10) SELECT CAST(place AS BIGINT) AS row_id, col_id, value FROM m JOIN f USING (row_id)")
def p5(spark, sf):
    from pyspark.sql import Window as W

    f = t(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("row_id"), (F.row_number().over(W.orderBy(F.col("p_partkey").desc())) - 1).alias("place"))
    return prepare.select_features(parts_customers(spark, sf), f)


@query("p6_rasterize", f"WITH {M}, n AS (SELECT COUNT(*) // 7 * 7 AS n FROM part) SELECT row_id // 7 AS row_id, col_id, round(SUM(value) / 7, 6) AS value FROM m WHERE row_id < (SELECT n FROM n) GROUP BY 1, 2")
def p6(spark, sf):
    return rounded(prepare.rasterize_rows(parts_customers(spark, sf), t(spark, sf, "part").count(), 7), "value")


@query("p7_rescale_spatial", f"WITH {C} SELECT sample_id, x, y FROM c")
def p7(spark, sf):
    """A lattice that was scaled to 0..1 and shifted comes back."""
    c = lattice(spark, sf)
    m = c.agg(F.max("x").alias("a"), F.max("y").alias("b"))
    return prepare.rescale_spatial(c.crossJoin(m).select("sample_id", (F.col("x") / F.col("a") * 3 + 5).alias("x"), (F.col("y") / F.col("b") - 2).alias("y")))


_NORMIT = """WITH r AS (SELECT event_id, event_type, round_even(value, 0) AS v FROM events),
q AS (SELECT *, RANK() OVER (PARTITION BY event_type ORDER BY v) + (COUNT(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS rk, DENSE_RANK() OVER (PARTITION BY event_type ORDER BY v) AS dr FROM r)
SELECT event_id, round((rk - 0.5) / MAX(dr) OVER (PARTITION BY event_type), 6) AS share FROM q"""


@query("p8_normal_scores", _NORMIT)
def p8(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "event_type", F.rint("value").alias("v"))
    return rounded(prepare.normal_scores(rows, "v", ["event_type"]).select("event_id", "share"), "share")


@query("p9_level_counts", "SELECT 'c_mktsegment' AS \"column\", COUNT(DISTINCT c_mktsegment) AS n_levels, COUNT(DISTINCT c_mktsegment) BETWEEN 2 AND 200 AS kept FROM customer UNION ALL SELECT 'c_nationkey', COUNT(DISTINCT c_nationkey), COUNT(DISTINCT c_nationkey) BETWEEN 2 AND 200 FROM customer UNION ALL SELECT 'c_name', COUNT(DISTINCT c_name), COUNT(DISTINCT c_name) BETWEEN 2 AND 200 FROM customer")
def p9(spark, sf):
    return prepare.level_counts(t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey", "c_name"])


@query("p10_model_matrix", f"WITH {SEG} SELECT sample_id, level, 1.0::DOUBLE AS value FROM seg")
def p10(spark, sf):
    return prepare.model_matrix(segments(spark, sf), "level")


@query("p10_model_matrix_intercept", f"WITH {SEG} SELECT sample_id, '(Intercept)' AS level, 1.0::DOUBLE AS value FROM seg UNION ALL SELECT sample_id, level, 1.0::DOUBLE FROM seg WHERE level <> (SELECT MIN(level) FROM seg)")
def p10b(spark, sf):
    return prepare.model_matrix(segments(spark, sf), "level", one_hot=False)


@query("p11_designs", "SELECT c_custkey AS sample_id, c_mktsegment AS level, 'c_mktsegment' AS design FROM customer UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR), 'c_nationkey' FROM customer")
def p11(spark, sf):
    meta = t(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), "c_mktsegment", "c_nationkey")
    found = prepare.designs(meta)
    prepare.check_designs(found)
    out = [d.select("sample_id", "level", F.lit(name).alias("design")) for name, d in found.items()]
    return out[0].unionByName(out[1])


@query("p12_differentiate", f"""WITH {H}, e AS (SELECT sample_id AS dst, sample_id + 1 AS src FROM h GROUP BY 1) SELECT dst, src, a.factor, round(GREATEST(b.weight - a.weight, 0), 8) AS up, round(GREATEST(a.weight - b.weight, 0), 8) AS down
FROM e JOIN h a ON a.sample_id = src JOIN h b ON b.sample_id = dst AND b.factor = a.factor""")
def p12(spark, sf):
    from ..operators import graph

    h = shares(spark, sf)
    edges = h.select(F.col("sample_id").alias("dst"), (F.col("sample_id") + 1).alias("src")).distinct()
    return rounded(graph.differentiate(h, edges), "up", "down", digits=8)


@query("p13_factor_weights", f"WITH {H} SELECT c_custkey AS feature_id, c_name, MAX(CASE WHEN factor = 0 THEN weight END) AS \"NMF_0\", MAX(CASE WHEN factor = 1 THEN weight END) AS \"NMF_1\" FROM customer JOIN h ON sample_id = c_custkey WHERE factor IN (0, 1) GROUP BY 1, 2")
def p13(spark, sf):
    w = shares(spark, sf).withColumnRenamed("sample_id", "feature_id")
    return prepare.factor_weights(t(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), "c_name"), w, [0, 1])


@query("p14_chunks", f"WITH {M} SELECT row_id, col_id - 37 AS col_id, value FROM m WHERE col_id >= 37 AND col_id < 75")
def p14(spark, sf):
    return matrix.chunks(parts_customers(spark, sf), 150, 4)[1]


@query("p15_blocked_transpose", f"WITH {M} SELECT col_id AS row_id, row_id AS col_id, value FROM m")
def p15(spark, sf):
    """Transposed chunk by chunk: columns of the chunks come back as rows at their offsets."""
    m, n = parts_customers(spark, sf), t(spark, sf, "customer").count()
    out = None
    for k, chunk in enumerate(matrix.chunks(m, n, 3)):
        one = matrix.transpose(chunk).withColumn("row_id", F.col("row_id") + n * k // 3)
        out = one if out is None else out.unionByName(one)
    return out


@query("a12_quality_control", f"WITH {M}, q AS (SELECT col_id, COUNT(*) AS n, SUM(value) AS s, SUM(CASE WHEN p_brand = 'Brand#11' THEN value ELSE 0 END) AS t FROM m JOIN part ON p_partkey = row_id GROUP BY 1) SELECT row_id, col_id, value FROM m WHERE col_id IN (SELECT col_id FROM q WHERE n > 20 AND n < 60 AND t < 0.05 * s)")
def quality_control(spark, sf):
    """Customers with more than 20 and fewer than 60 parts, and less than 5 % of the quantity of one brand."""
    marked = t(spark, sf, "part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("row_id"))
    return prepare.quality_control(parts_customers(spark, sf), marked, 20, 60, 0.05)


# --- kernels ------------------------------------------------------------------------------------


@query("n3_gram", f"WITH {H} SELECT a.factor AS f, b.factor AS g, round(SUM(a.weight * b.weight) + CASE WHEN a.factor = b.factor THEN 1e-15 ELSE 0 END, 4) AS value FROM h a JOIN h b ON a.sample_id = b.sample_id GROUP BY 1, 2")
def n3(spark, sf):
    """The Gram matrix of factors, from per-partition products."""
    from ..operators import nmf

    rows = _arrays(shares(spark, sf))
    g = nmf.factor_sums(rows, 3)[1]
    return rounded(spark.createDataFrame([(i, j, float(g[i, j])) for i in range(3) for j in range(3)], "f int, g int, value double"), "value", digits=4)


def _arrays(h):
    one = lambda f: F.coalesce(F.max(F.when(F.col("factor") == f, F.col("weight"))), F.lit(0.0))
    return h.groupBy(F.col("sample_id").alias("id")).agg(F.array(*[one(f) for f in range(3)]).alias("weights"))


@query("n5_scale", f"WITH {H}, d AS (SELECT factor, SUM(weight) + 1e-15 AS d FROM h GROUP BY 1), i AS (SELECT DISTINCT sample_id FROM h) SELECT i.sample_id AS id, d.factor, round(COALESCE(weight, 0) / d, 9) AS weight FROM i CROSS JOIN d LEFT JOIN h ON h.sample_id = i.sample_id AND h.factor = d.factor")
def n5(spark, sf):
    from ..operators import nmf

    f, _ = nmf.rescale(_arrays(shares(spark, sf)), 3)
    return rounded(f.select("id", F.posexplode("weights").alias("factor", "weight")), "weight", digits=9)


@query("n6_cor", f"WITH {H} SELECT round(1 - corr(a.weight, b.weight), 8) AS value FROM (SELECT i.sample_id, f AS factor, COALESCE(weight, 0) AS weight FROM (SELECT DISTINCT sample_id FROM h) i CROSS JOIN range(0, 3) r(f) LEFT JOIN h ON h.sample_id = i.sample_id AND h.factor = f) a JOIN (SELECT i.sample_id, f AS factor, COALESCE(weight, 0) AS weight FROM (SELECT DISTINCT sample_id FROM h) i CROSS JOIN range(0, 3) r(f) LEFT JOIN h ON h.sample_id = i.sample_id AND h.factor = f) b ON a.sample_id = b.sample_id AND a.factor = 2 - b.factor")
def n6(spark, sf):
    from ..operators import nmf

    a = cut(_arrays(shares(spark, sf)))
    value = nmf.distance(a, a.select("id", F.reverse("weights").alias("weights")), 3)
    return spark.createDataFrame([(round(value, 8),)], "value double")


@query("n7_cross_products", f"WITH {M} SELECT col_id, p_size % 4 AS factor, SUM(value * p_size) AS b FROM m JOIN part ON row_id = p_partkey GROUP BY 1, 2")
def n7(spark, sf):
    """Cross products of each sample with a sparse W (part size on factor size % 4): the shuffled form of a half step."""
    w = t(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") % 4).alias("factor"), F.col("p_size").cast("double").alias("w"))
    m = parts_customers(spark, sf)
    return m.join(w, "row_id").groupBy("col_id", "factor").agg(F.sum(F.col("value") * F.col("w")).alias("b"))


_HASHES = f"WITH {M}, {fit_sql.hashed('h', 'SELECT col_id AS s, row_id AS f FROM m', 123)} "


@query("n13_hash_mask", _HASHES + "SELECT s AS sample, f AS feature, CAST(x % 20 AS BIGINT) AS draw, x % 20 = 0 AS masked, CAST(x % 1000003 AS BIGINT) AS rest FROM h")
def n13(spark, sf):
    """The draw of every cell of the matrix."""
    x, m = rng.hash64(123, F.col("col_id"), F.col("row_id")), parts_customers(spark, sf)
    return m.select(F.col("col_id").alias("sample"), F.col("row_id").alias("feature"), rng.unsigned_mod(x, 20).alias("draw"), rng.masked(123, F.col("col_id"), F.col("row_id"), 20).alias("masked"), rng.unsigned_mod(x, 1_000_003).alias("rest"))


@query("n13_uniform", _HASHES + "SELECT s AS sample, f AS feature, round(CAST(x AS DOUBLE) / 18446744073709551616, 9) AS u FROM h")
def n13b(spark, sf):
    return parts_customers(spark, sf).select(F.col("col_id").alias("sample"), F.col("row_id").alias("feature"), F.round(rng.uniform(123, F.col("col_id"), F.col("row_id")), 9).alias("u"))


@query("n12_masked_error", f"""WITH {M}, {fit_sql.hashed('h', 'SELECT c_custkey AS s, p_partkey AS f FROM customer CROSS JOIN part', 123)},
z AS MATERIALIZED (SELECT s, f FROM h WHERE x % 20 = 0), e AS (SELECT s, power(COALESCE(value, 0) - 2.0, 2) AS e FROM z LEFT JOIN m ON row_id = f AND col_id = s), q AS (SELECT s, AVG(e) AS e FROM e GROUP BY 1)
SELECT round(SUM(e) / (SELECT COUNT(*) FROM customer), 6) AS test_error FROM q""")
def n12(spark, sf):
    """Error at the masked cells of all parts and customers, under the rank-1 model W = 1, d = 2, H = 1."""
    from ..operators import nmf

    import numpy as np

    ids = lambda name, key: t(spark, sf, name).select(F.col(key).alias("id"))
    p = nmf.problem(parts_customers(spark, sf), ids("part", "p_partkey"), ids("customer", "c_custkey"))
    one = lambda x: x.select("id", F.array(F.lit(1.0)).alias("weights"))
    return spark.createDataFrame([(round(float(nmf.test_error(p, one(p.features), np.array([2.0]), one(p.samples), 1, 123, 20)), 6),)], "test_error double")


@query("n14_distances", f"""WITH {V} SELECT a.sample_id AS a, b.sample_id AS b, round(1 - list_dot_product(a.v, b.v) / (list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - list_dot_product(a.v, b.v)), 6) AS jaccard,
round(list_distance(a.v, b.v), 6) AS euclidean, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))), 6) AS manhattan,
list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] <> z[2] THEN 1.0::DOUBLE ELSE 0 END)) AS hamming,
round(list_sum(list_transform(a.v, lambda z: abs(z) + 0.01)) * ln(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (abs(z[1]) + 0.01) / (abs(z[2]) + 0.01)))), 5) AS kl,
round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM v a JOIN v b ON b.sample_id = a.sample_id + 1""")
def n14(spark, sf):
    v = vectors(spark, sf)
    pairs = v.select(F.col("sample_id").alias("a"), F.col("v").alias("p")).join(v.select((F.col("sample_id") - 1).alias("a"), F.col("sample_id").alias("b"), F.col("v").alias("q")), "a")
    p, q = F.col("p"), F.col("q")
    positive = lambda x: F.transform(x, lambda y: F.abs(y) + 0.01)
    return pairs.select(
        "a", "b", F.round(distances.jaccard(p, q), 6).alias("jaccard"), F.round(distances.euclidean(p, q), 6).alias("euclidean"), F.round(distances.manhattan(p, q), 6).alias("manhattan"),
        distances.hamming(p, q).alias("hamming"), F.round(distances.kullback(positive(p), positive(q)), 5).alias("kl"), F.round(distances.cosine(p, q), 6).alias("cosine"),
    )
