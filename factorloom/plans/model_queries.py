"""Queries of the factorizations, graphs, annotation and enrichment, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stats
from ..operators import annotate, enrich, graph, matrix, nmf, prepare, rank
from ..session import cut, shared_dir
from ..sources import matrix_io
from ..streaming import project as stream
from . import fit_sql
from .fixtures import SEG, C, H, M, V, lattice, parts_customers, segments, shares, t, vectors
from .matrix_queries import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def normalized(spark, sf):
    return prepare.log_normalize(parts_customers(spark, sf))


def small(spark, sf):
    """Users by event type and hour: a matrix that many fits can run on."""
    events = t(spark, sf, "events").select("user_id", "event_type", "ts")
    kinds = events.select("event_type").distinct().withColumn("e", F.dense_rank().over(W.orderBy("event_type")) - 1)
    hour = F.hour("ts") + 24 * F.col("e")
    return events.join(F.broadcast(kinds), "event_type").groupBy(hour.cast("long").alias("row_id"), F.col("user_id").alias("col_id")).agg(F.count("*").cast("double").alias("value"))


def ones(ids):
    return ids.select("id", F.array(F.lit(1.0)).alias("weights"))


# --- rank 1: the solver has a closed form, so SQL can follow ----------------------------------------

_A = f"{M}, a AS MATERIALIZED (SELECT row_id, col_id, ln(1 + value / SUM(value) OVER (PARTITION BY col_id) * 10000) AS v FROM m)"
_STEP = "{h} AS MATERIALIZED (SELECT {by} AS id, GREATEST(0, SUM(v * w) / (SELECT SUM(w * w) + 1e-15 FROM {w}) - 0.01) AS w FROM a JOIN {w} ON {w}.id = {other} GROUP BY 1), {n} AS MATERIALIZED (SELECT id, w / (SELECT SUM(w) + 1e-15 FROM {h}) AS w FROM {h})"


def _steps(times: int) -> str:
    out, w = ["w0 AS MATERIALIZED (SELECT DISTINCT row_id AS id, 1.0::DOUBLE AS w FROM a)"], "w0"
    for i in range(1, times + 1):
        out.append(_STEP.format(h=f"x{i}", n=f"h{i}", by="col_id", other="row_id", w=w))
        out.append(_STEP.format(h=f"y{i}", n=f"w{i}", by="row_id", other="col_id", w=f"h{i}"))
        w = f"w{i}"
    return ", ".join(out)


@query("n1_nnls_rank1", f"WITH {_A}, {_steps(1)} SELECT id, round(w, 8) AS weight FROM h1")
def n1(spark, sf):
    p = nmf.problem(normalized(spark, sf))
    h, _ = nmf.rescale(nmf.half_step(p.by_col, ones(p.features), 1, 0.01), 1)
    return rounded(h.select("id", F.get("weights", 0).alias("weight")), "weight", digits=8)


@query("n8_predict_shuffled", f"WITH {_A}, {_steps(1)} SELECT id, round(w, 8) AS weight FROM h1")
def n8(spark, sf):
    """The half step without a broadcast: cells join the factor."""
    p = nmf.problem(normalized(spark, sf))
    h, _ = nmf.rescale(nmf.half_step(p.by_col, ones(p.features), 1, 0.01, limit=0), 1)
    return rounded(h.select("id", F.get("weights", 0).alias("weight")), "weight", digits=8)


@query("m1_nmf_rank1", f"WITH {_A}, {_steps(2)} SELECT 'w' AS side, id, round(w, 8) AS weight FROM w2 UNION ALL SELECT 'h', id, round(w, 8) FROM h2")
def m1_rank1(spark, sf):
    """Two iterations of a rank-1 factorization."""
    p = nmf.problem(normalized(spark, sf))
    model = nmf.fit(p, ones(p.features), tol=0.0, maxit=2)
    one = lambda df, side, i: df.select(F.lit(side).alias("side"), F.col(i).alias("id"), F.round(F.get("weights", 0), 8).alias("weight"))
    return one(model.w, "w", "feature_id").unionByName(one(model.h, "h", "sample_id"))


@query("m16_project_rank1", f"WITH {_A}, w0 AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / (SELECT SUM(p_size) FROM part) AS w FROM part WHERE p_partkey IN (SELECT row_id FROM a)), " + _STEP.format(h="x1", n="h1", by="col_id", other="row_id", w="w0") + " SELECT id AS sample_id, round(w, 8) AS weight FROM h1")
def m16(spark, sf):
    w = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), F.array(F.col("p_size").cast("double")).alias("weights"))
    model = nmf.project(normalized(spark, sf), w)
    return model.h.select("sample_id", F.round(F.get("weights", 0), 8).alias("weight"))


@query("m6_ratio_step", f"""WITH {M}, g AS (SELECT COUNT(*) + 1e-15 AS g FROM (SELECT DISTINCT row_id FROM m)) SELECT col_id AS id, round(SUM(value) / ((SELECT g FROM g) * 0.5 + 1e-15), 6) AS weight FROM m GROUP BY 1""")
def m6(spark, sf):
    """One ratio update of H from W = 1 and H = 0.5."""
    p = nmf.problem(parts_customers(spark, sf))
    half = p.samples.select("id", F.array(F.lit(0.5)).alias("weights"))
    out = nmf.half_step(p.by_col, ones(p.features), 1, update="ratio", previous=half)
    return rounded(out.select("id", F.get("weights", 0).alias("weight")), "weight")


@query("n10_linked_step", f"WITH {_A}, {_steps(1)}, {SEG} SELECT c.c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE round(x1.w, 6) END AS weight FROM customer c JOIN x1 ON x1.id = c_custkey")
def n10(spark, sf):
    p = nmf.problem(normalized(spark, sf))
    link = segments(spark, sf).select(F.col("sample_id").alias("id"), F.array(F.when(F.col("level") == "BUILDING", 0.0).otherwise(1.0)).alias("link"))
    out = nmf.half_step(p.by_col, ones(p.features), 1, 0.01, link=link)
    return rounded(out.select("id", F.get("weights", 0).alias("weight")), "weight")


@query("n2_l1_rows_step", f"WITH {_A}, w0 AS (SELECT DISTINCT row_id AS id, 1.0::DOUBLE AS w FROM a) SELECT col_id AS id, round(GREATEST(0, SUM(v) / (SELECT SUM(w * w) + 1e-15 FROM w0) - 0.01 - (col_id % 3) / 1000), 8) AS weight FROM a GROUP BY col_id")
def n2(spark, sf):
    """A half step with an L1 of its own for each sample and factor."""
    p = nmf.problem(normalized(spark, sf))
    extra = p.samples.select("id", F.array((F.col("id") % 3) / F.lit(1000.0)).alias("l1"))
    out = nmf.half_step(p.by_col, ones(p.features), 1, 0.01, l1_rows=extra)
    return rounded(out.select("id", F.get("weights", 0).alias("weight")), "weight", digits=8)


@query("n9_batch_l1", f"WITH {H}, {SEG}, i AS (SELECT s.sample_id, level, f AS factor, COALESCE(weight, 0) AS weight FROM seg s JOIN (SELECT DISTINCT sample_id FROM h) d USING (sample_id) CROSS JOIN range(0, 3) r(f) LEFT JOIN h ON h.sample_id = s.sample_id AND h.factor = f), m AS (SELECT level, factor, AVG(weight) AS m FROM i GROUP BY 1, 2) SELECT level AS batch, factor, round(m - (SUM(m) OVER (PARTITION BY factor) - m) / (COUNT(*) OVER (PARTITION BY factor) - 1), 6) AS l1 FROM m")
def n9(spark, sf):
    from .matrix_queries import _arrays

    batches = segments(spark, sf).select(F.col("sample_id").alias("id"), F.col("level").alias("batch"))
    out = nmf.batch_l1(_arrays(shares(spark, sf)), batches, 3)
    return rounded(out.select("batch", F.posexplode("l1").alias("factor", "l1")), "l1")


_SMALL = "a AS MATERIALIZED (SELECT hour(ts) + 24 * e AS row_id, user_id AS col_id, CAST(COUNT(*) AS DOUBLE) AS v FROM events JOIN (SELECT event_type, ROW_NUMBER() OVER (ORDER BY event_type) - 1 AS e FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY 1, 2)"
_PAIRS = "SELECT s, f FROM (SELECT DISTINCT col_id AS s FROM a) CROSS JOIN (SELECT DISTINCT row_id AS f FROM a)"


def _mask(name: str, seed: int) -> str:
    return fit_sql.hashed(f"{name}_x", _PAIRS, seed) + f", {name} AS MATERIALIZED (SELECT s, f FROM {name}_x WHERE x % 20 = 0)"


@query("n11_masked_step", f"WITH {_SMALL}, {_mask('z', 7)}, {fit_sql.start('w0', 'SELECT DISTINCT row_id AS id FROM a', 1)}, {fit_sql.half('x', 'col_id', 'w0', mask='z')} SELECT id, round(a, 4) AS a, round(b, 4) AS b FROM x")
def n11(spark, sf):
    p = nmf.problem(small(spark, sf))
    out = nmf.half_step(p.by_col, nmf.start(p.features, 2, 1), 2, 0.01, mask=(7, 20, True))
    return out.select("id", F.round(F.get("weights", 0), 4).alias("a"), F.round(F.get("weights", 1), 4).alias("b"))


@query("n11_masked_step_streamed", SQL["n11_masked_step"])
def n11b(spark, sf):
    """The same with a factor beyond the broadcast limit: it streams past the ids."""
    p = nmf.problem(small(spark, sf), cells=16)
    out = nmf.half_step(p.by_col, nmf.start(p.features, 2, 1), 2, 0.01, mask=(7, 20, True), limit=0)
    return out.select("id", F.round(F.get("weights", 0), 4).alias("a"), F.round(F.get("weights", 1), 4).alias("b"))


# --- fits of rank 2, checked whole; higher ranks are checked against numpy twins in the tests --------


def _factors(model, digits=6):
    return model.long("h").select("sample_id", "factor", F.round("weight", digits).alias("weight"))


_FIT2 = f"WITH {_A}, {fit_sql.fit(2)} {fit_sql.factors('h2', 'w2_d')}"


@query("m1_run_nmf", _FIT2)
def m1(spark, sf):
    return _factors(nmf.run_nmf(normalized(spark, sf), 2, tol=0.0, maxit=2))


@query("m1_run_nmf_bucketed", _FIT2)
def m1_bucketed(spark, sf):
    """Factors beyond the broadcast limit: they are joined with the bucketed cells."""
    return _factors(nmf.run_nmf(normalized(spark, sf), 2, tol=0.0, maxit=2, limit=0))


@query("m1_run_nmf_rank4")
def m1_rank4(spark, sf):
    return _factors(nmf.run_nmf(normalized(spark, sf), 4, maxit=4))


@query("m3_nmf_chunks", _FIT2)
def m3(spark, sf):
    """The chunks of a matrix side by side give the fit of the whole."""
    m = cut(normalized(spark, sf))
    top = m.agg(F.max("col_id")).first()[0] + 1
    return _factors(nmf.run_nmf(matrix_io.build([m.where(F.col("col_id") < top // 2), m.where(F.col("col_id") >= top // 2).withColumn("col_id", F.col("col_id") - top // 2)], [top // 2, 0]), 2, tol=0.0, maxit=2))


@query("m4_nmf_compressed", _FIT2)
def m4(spark, sf):
    """A fit of what was compressed by distinct value and delta-coded."""
    m = normalized(spark, sf)
    return _factors(nmf.run_nmf(matrix.from_ivcsc(matrix.to_ivcsc(m)).select("row_id", "col_id", "value"), 2, tol=0.0, maxit=2))


_DENSE = f"{V}, a AS MATERIALIZED (SELECT i - 1 + CASE WHEN v[i] < 0 THEN 64 ELSE 0 END AS row_id, sample_id AS col_id, abs(v[i]) AS v FROM v, range(1, 65) r(i) WHERE v[i] <> 0)"


@query("m2_nmf_dense", f"WITH {_DENSE}, {fit_sql.fit(3)} {fit_sql.factors('h3', 'w3_d')}")
def m2(spark, sf):
    """Embeddings split into positive and negative parts."""
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("col_id"), F.posexplode("embedding").alias("i", "x"))
    m = v.select((F.col("i") + F.when(F.col("x") < 0, 64).otherwise(0)).cast("long").alias("row_id"), "col_id", F.abs(F.col("x").cast("double")).alias("value")).where("value > 0")
    return _factors(nmf.run_nmf(m, 2, tol=0.0, maxit=3))


# the second iteration's loadings are penalized by how far a batch's means are from the others' in the first
_BATCH = f"""WITH {_A}, {SEG}, {fit_sql.fit(1)}, bm AS (SELECT level, AVG(a) AS ma, AVG(b) AS mb FROM h1 JOIN seg ON sample_id = id GROUP BY 1),
bx AS (SELECT level, ma - (SUM(ma) OVER () - ma) / greatest(COUNT(*) OVER () - 1, 1) AS ea, mb - (SUM(mb) OVER () - mb) / greatest(COUNT(*) OVER () - 1, 1) AS eb FROM bm), ex AS (SELECT sample_id AS id, ea, eb FROM seg JOIN bx USING (level)),
{fit_sql.half("h2_raw", "col_id", "w1", extra="ex")}, {fit_sql.unit("h2", "h2_raw")}, {fit_sql.half("w2_raw", "row_id", "h2")}, {fit_sql.unit("w2", "w2_raw")} {fit_sql.factors("h2", "w2_d")}"""


@query("m5_batch_nmf", _BATCH)
def m5(spark, sf):
    batches = segments(spark, sf).select(F.col("sample_id").alias("id"), F.col("level").alias("batch"))
    return _factors(nmf.run_batch_nmf(normalized(spark, sf), batches, 2, tol=0.0, maxit=2))


def _ratio(name: str, by: str, w: str, x: str) -> str:
    other = "row_id" if by == "col_id" else "col_id"
    p = f"(SELECT {by} AS id, SUM(v * a) AS p, SUM(v * b) AS q FROM a JOIN {w} w ON w.id = {other} GROUP BY 1)"
    return f"{name} AS MATERIALIZED (SELECT id, p / (g * x.a + 1e-15) AS a, q / (k * x.b + 1e-15) AS b FROM {p} JOIN {x} x USING (id) CROSS JOIN (SELECT SUM(a * a) + 1e-15 AS g, SUM(b * b) + 1e-15 AS k FROM {w}))"


_ONE = "SELECT id AS sample_id, CAST({0} AS INTEGER) AS factor, round({1}, 6) AS weight FROM {2}"
_RATIO = ", ".join([fit_sql.start("w0", "SELECT DISTINCT row_id AS id FROM a", 1), fit_sql.start("h0", "SELECT DISTINCT col_id AS id FROM a", 2), _ratio("h1", "col_id", "w0", "h0"), _ratio("w1", "row_id", "h1", "w0"), _ratio("h2", "col_id", "w1", "h1")])


@query("m6_ratio_nmf", f"WITH {_A}, {_RATIO} {_ONE.format(0, 'a', 'h2')} UNION ALL {_ONE.format(1, 'b', 'h2')}")
def m6_fit(spark, sf):
    return _factors(nmf.run_ratio_nmf(normalized(spark, sf), 2, maxit=2))


# links from the mean loadings by segment of a first fit
_LINKED = f"""WITH {_A}, {SEG}, {fit_sql.fit(2, prefix="f_")}, fl AS (SELECT sample_id, factor, CAST(weight AS DOUBLE) AS weight FROM ({fit_sql.factors("f_h2", "f_w2_d", 15)})),
fm AS (SELECT factor, level, COALESCE(SUM(weight), 0) / ANY_VALUE(n) AS mean FROM fl JOIN seg USING (sample_id) JOIN (SELECT level, COUNT(*) AS n FROM seg GROUP BY 1) USING (level) GROUP BY 1, 2),
fk AS (SELECT factor, level, CASE WHEN mean / SUM(mean) OVER (PARTITION BY factor) * COUNT(*) OVER (PARTITION BY factor) < 0.95 THEN 0.0 ELSE 1.0 END AS link FROM fm),
lk AS (SELECT sample_id AS id, MAX(link) FILTER (factor = 0) AS la, MAX(link) FILTER (factor = 1) AS lb FROM seg JOIN fk USING (level) GROUP BY 1),
{fit_sql.fit(2, h_link="lk")} {fit_sql.factors("h2", "w2_d")}"""


@query("m7_linked_nmf", _LINKED)
def m7(spark, sf):
    m = cut(normalized(spark, sf))
    h = nmf.run_nmf(m, 2, tol=0.0, maxit=2)
    return _factors(annotate.run_linked(m, h.long("h"), segments(spark, sf), 2, 0.95, tol=0.0, maxit=2))


_SPREAD = "{{name}} AS MATERIALIZED (SELECT dst AS id, SUM(g * p) AS p, SUM(g * q) AS q FROM gr JOIN (SELECT col_id AS src, SUM(v * a) AS p, SUM(v * b) AS q FROM a JOIN {w} w ON w.id = row_id GROUP BY 1) USING (src) GROUP BY 1)"
_GRAPH = ", ".join(
    x for n in (1,) for x in (
        fit_sql.half(f"h{n}_raw", "col_id", f"w{n - 1}", products=_SPREAD.format(w=f"w{n - 1}")), fit_sql.unit(f"h{n}", f"h{n}_raw"),
        f"hs{n} AS MATERIALIZED (SELECT dst AS id, SUM(g * a) AS a, SUM(g * b) AS b FROM gr JOIN h{n} ON id = src GROUP BY 1)",
        fit_sql.half(f"w{n}_raw", "row_id", f"hs{n}"), fit_sql.unit(f"w{n}", f"w{n}_raw"),
    )
)


# one iteration: smoothed loadings are so alike that the descent stops short of the closed form beyond it
@query("m10_graph_nmf", f"""WITH {C}, ge AS (SELECT a.sample_id AS dst, b.sample_id AS src, 1 - sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2 AS u FROM c a JOIN c b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2),
gr AS MATERIALIZED (SELECT dst, src, u / SUM(u) OVER (PARTITION BY dst) AS g FROM ge WHERE u > 0), {V}, a AS MATERIALIZED (SELECT i - 1 AS row_id, sample_id AS col_id, abs(v[i]) AS v FROM v, range(1, 65) r(i) WHERE v[i] <> 0),
{fit_sql.start("w0", "SELECT DISTINCT row_id AS id FROM a", 1)}, {_GRAPH} {fit_sql.factors("h1", "w1_d")}""")
def m10(spark, sf):
    v = t(spark, sf, "embeddings").select(F.col("vec_id").alias("col_id"), F.posexplode("embedding").alias("row_id", "x"))
    m = v.select(F.col("row_id").cast("long").alias("row_id"), "col_id", F.abs(F.col("x").cast("double")).alias("value")).where("value > 0")
    return _factors(nmf.run_graph_nmf(m, cut(graph.spatial_graph(lattice(spark, sf), 2.0)), 2, tol=0.0, maxit=1))


def _trace(k: int, rep: int, at: dict[int, int], first: str = "") -> tuple[str, str]:
    """CTEs of a masked fit, and the rows of its trace: at has the iteration noted for each number of iterations done."""
    p = f"k{k}r{rep}_"
    ctes = f"{_mask(p + 'z', 1 + rep)}, {fit_sql.fit(max(at), rank=k, seed=rep, prefix=p, mask=p + 'z')}"
    rows = [f"SELECT CAST({k} AS INTEGER) AS k, CAST({rep} AS INTEGER) AS rep, CAST({i} AS INTEGER) AS iter, round({fit_sql.test_error(f'{p}h{n}', f'{p}w{n}', p + 'z')}, 6) AS test_error" for n, i in at.items()]
    return ctes, " UNION ALL ".join(rows)


def _traces(*parts: tuple[str, str]) -> str:
    return f"WITH {_SMALL}, {', '.join(p[0] for p in parts)} " + " UNION ALL ".join(p[1] for p in parts)


def _noted(trace):
    return trace.select("k", "rep", "iter", F.round("test_error", 6).alias("test_error"))


@query("m11_cross_validate", _traces(*[_trace(k, rep, {1: 0, 3: 2}) for k in (1, 2) for rep in (1, 2)]))
def m11(spark, sf):
    return _noted(rank.cross_validate(small(spark, sf), [1, 2], n_replicates=2, maxit=3, trace_every=2, tol=0.0, tol_overfit=1.0))


@query("m12_masked_fit", _traces(_trace(2, 1, {1: 0, 2: 1, 3: 2})))
def m12(spark, sf):
    p = nmf.problem(small(spark, sf))
    return _noted(spark.createDataFrame(rank.masked_fit(p, 2, tol=0.0, maxit=3, every=1, tol_overfit=1.0), rank.TRACE))


@query("m12_masked_fit_streamed", SQL["m12_masked_fit"])
def m12b(spark, sf):
    """The same with factors beyond the broadcast limit."""
    p = nmf.problem(small(spark, sf), cells=64)
    return _noted(spark.createDataFrame(rank.masked_fit(p, 2, tol=0.0, maxit=3, every=1, tol_overfit=1.0, limit=0), rank.TRACE))


@query("m13_rank_search", _traces(*[_trace(k, 1, {1: 0, 2: 1}) for k in (1, 2)]))
def m13(spark, sf):
    """A search from rank 1 up, one by one, to its limit of 2."""
    return _noted(rank.ard_nmf(small(spark, sf), k_init=1, k_min=1, k_max=2, maxit=2, cv_tol=0.0, tol_overfit=1.0, learning_rate=0.0).misc["trace"])


_BALANCED = f"""WITH {_A}, {SEG}, k AS (SELECT sample_id, DENSE_RANK() OVER (ORDER BY level) - 1 AS code FROM seg), ks AS (SELECT code, SUM(v) AS s FROM a JOIN k ON col_id = sample_id GROUP BY 1),
ab AS MATERIALIZED (SELECT row_id, col_id, CASE WHEN code = 0 THEN v ELSE v / (s / (SELECT s FROM ks WHERE code = 0)) END AS v FROM a JOIN k ON col_id = sample_id JOIN ks USING (code)), {fit_sql.fit(2, matrix="ab")} {fit_sql.factors("h2", "w2_d")}"""


@query("m15_run", _BALANCED)
def m15(spark, sf):
    return _factors(rank.run(parts_customers(spark, sf), k=2, codes=prepare.group_codes(segments(spark, sf), "level"), tol=0.0, maxit=2))


@query("m17_project_matrix", f"WITH {_A}, {fit_sql.fit(1)}, {fit_sql.half('pr_raw', 'col_id', 'w1')}, {fit_sql.unit('pr', 'pr_raw')} {fit_sql.factors('pr', 'pr_d')}")
def m17(spark, sf):
    """Raw counts of all customers, normalized and loaded on the factors of a fit."""
    model = nmf.run_nmf(normalized(spark, sf), 2, tol=0.0, maxit=1)
    return _factors(nmf.project_matrix(parts_customers(spark, sf), model.w, reorder=True))


@query("m16_project_stream", f"WITH {_A}, {fit_sql.fit(1)}, {fit_sql.half('pr', 'col_id', 'w1')} {fit_sql.factors('pr', 'w1_d', 1)}")
def m16_stream(spark, sf):
    """The batch form of the stream's function: the same rows in either."""
    model = nmf.run_nmf(normalized(spark, sf), 2, tol=0.0, maxit=1)
    out = stream.project_stream(nmf.blocks(nmf.cut(normalized(spark, sf)), "col_id").rows, model)
    return out.select(F.col("id").alias("sample_id"), F.posexplode("weights").alias("factor", "weight")).withColumn("weight", F.round("weight", 1))


@query("s2_pipeline", _FIT2)
def s2(spark, sf):
    path = shared_dir(spark)
    matrix_io.write_matrix(parts_customers(spark, sf), f"{path}/m")
    meta = segments(spark, sf).withColumnRenamed("level", "segment")
    matrix_io.pipeline(spark, f"{path}/m", "Parts & customers 1", path, meta, k=2, tol=0.0, maxit=2)
    return spark.read.parquet(f"{path}/Partscustomers/h").select("sample_id", F.posexplode("weights").alias("factor", "weight")).withColumn("weight", F.round("weight", 6))


@query("s9_model_parts", f"WITH {H} SELECT sample_id, factor, weight FROM (SELECT i.sample_id, CAST(f AS INTEGER) AS factor, COALESCE(weight, 0) AS weight FROM (SELECT DISTINCT sample_id FROM h) i CROSS JOIN range(0, 3) r(f) LEFT JOIN h ON h.sample_id = i.sample_id AND h.factor = f)")
def s9(spark, sf):
    from .matrix_queries import _arrays

    h = _arrays(shares(spark, sf)).withColumnRenamed("id", "sample_id")
    w = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), F.array(*[F.lit(1.0)] * 3).alias("weights"))
    path = shared_dir(spark)
    matrix_io.write_model(nmf.Model.from_parts(w, [3.0, 2.0, 1.0], h), path)
    return matrix_io.read_model(spark, path).long("h")


@query("s10_subset", f"WITH {H}, {SEG}, p AS (SELECT sample_id FROM seg WHERE level = 'MACHINERY') SELECT i.sample_id, CAST(CASE f WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS factor, COALESCE(weight, 0) AS weight FROM (SELECT DISTINCT sample_id FROM h WHERE sample_id IN (SELECT sample_id FROM p)) i CROSS JOIN (VALUES (2), (0)) r(f) LEFT JOIN h ON h.sample_id = i.sample_id AND h.factor = f")
def s10(spark, sf):
    from .matrix_queries import _arrays

    h = _arrays(shares(spark, sf)).withColumnRenamed("id", "sample_id")
    w = t(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), F.array(*[F.lit(1.0)] * 3).alias("weights"))
    model = nmf.Model.from_parts(w, [3.0, 2.0, 1.0], h)
    return model.subset([2, 0], segments(spark, sf).where("level = 'MACHINERY'").select("sample_id")).long("h")


# --- group summaries ------------------------------------------------------------------------------

_MEANS = f"{H}, {SEG}, z AS (SELECT level, COUNT(*) AS n FROM seg GROUP BY 1), g AS (SELECT f.factor, z.level, z.n, COALESCE(SUM(h.weight), 0) / z.n AS mean, COALESCE(SUM(h.weight * h.weight), 0) AS q, COALESCE(SUM(h.weight), 0) AS s FROM (SELECT DISTINCT factor FROM h) f CROSS JOIN z JOIN seg ON seg.level = z.level LEFT JOIN h ON h.sample_id = seg.sample_id AND h.factor = f.factor GROUP BY 1, 2, 3), sh AS (SELECT factor, level, mean / NULLIF(SUM(mean) OVER (PARTITION BY factor), 0) AS share FROM g)"


@query("a2_metadata_summary", f"WITH {_MEANS} SELECT factor, level, round(share, 6) AS share FROM sh")
def a2(spark, sf):
    return rounded(annotate.metadata_summary(shares(spark, sf), segments(spark, sf)), "share")


@query("m8_link_table", f"WITH {_MEANS} SELECT factor, level, CASE WHEN share * COUNT(*) OVER (PARTITION BY factor) < 0.99 THEN 0.0::DOUBLE ELSE 1.0 END AS link FROM sh")
def m8(spark, sf):
    return annotate.link_table(shares(spark, sf), segments(spark, sf), 0.99)


_HOLES = "weight * CASE WHEN factor = 2 AND level = 'BUILDING' THEN 0 ELSE 1 END"
_LEAST = f"WITH {H}, {SEG}, hh AS (SELECT sample_id, factor, level, {_HOLES} AS weight FROM h JOIN seg USING (sample_id)), z AS (SELECT level, COUNT(*) AS n FROM seg GROUP BY 1), g AS (SELECT factor, level, SUM(weight) / n AS mean FROM hh JOIN z USING (level) GROUP BY factor, level, n), l AS (SELECT factor, MIN(mean) AS least FROM g GROUP BY 1) SELECT factor FROM l WHERE least "


def _with_hole(spark, sf):
    h = shares(spark, sf).join(segments(spark, sf), "sample_id")
    return h.select("sample_id", "factor", F.when((F.col("factor") == 2) & (F.col("level") == "BUILDING"), 0.0).otherwise(F.col("weight")).alias("weight"))


@query("m9_shared_factors", _LEAST + "<> 0")
def m9(spark, sf):
    return annotate.shared_factors(_with_hole(spark, sf), segments(spark, sf))


@query("m9_unique_factors", _LEAST + "= 0")
def m9b(spark, sf):
    return annotate.unique_factors(_with_hole(spark, sf), segments(spark, sf))


@query("a3_model_fit", f"WITH {_MEANS} SELECT factor, level, round(mean - SUM(mean * n) OVER w / SUM(n) OVER w, 6) AS coef, n, round(SUM(q - s * s / n) OVER w / (SUM(n) OVER w - COUNT(*) OVER w), 6) AS s2, CAST(SUM(n) OVER w - COUNT(*) OVER w AS BIGINT) AS df FROM g WINDOW w AS (PARTITION BY factor)")
def a3(spark, sf):
    return rounded(annotate.model_fit(shares(spark, sf), segments(spark, sf)), "coef", "s2")


@query("a4_model_results")
def a4(spark, sf):
    return annotate.model_results(annotate.moderated(annotate.model_fit(_with_hole(spark, sf), segments(spark, sf))), tail="std", noneg=False)


@query("a1_annotate")
def a1(spark, sf):
    meta = t(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), "c_mktsegment", "c_nationkey")
    return annotate.annotate(_with_hole(spark, sf), meta, tail="std")


_P = "p AS (SELECT event_id, event_type, (CAST(event_id AS DOUBLE) * 37 % 1009 + 1) / 5000 AS p FROM events)"


@query("a5_false_discovery", f"WITH {_P}, r AS (SELECT *, COUNT(*) OVER (PARTITION BY event_type) AS n, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY p DESC, event_id DESC) AS r FROM p) SELECT event_id, round(LEAST(1, MIN(p * n / (n - r + 1)) OVER (PARTITION BY event_type ORDER BY r)), 6) AS adjusted FROM r")
def a5(spark, sf):
    p = t(spark, sf, "events").select("event_id", "event_type", ((F.col("event_id").cast("double") * 37 % 1009 + 1) / 5000).alias("p"))
    return rounded(stats.false_discovery(p, "p", "adjusted", ["event_type"], ["event_id"]).select("event_id", "adjusted"), "adjusted")


def _annotations(spark, sf):
    """Made-up results: brands by factor, with holes."""
    rows = t(spark, sf, "part").where("p_size % 3 <> 0").groupBy(F.col("p_brand").alias("group"), (F.col("p_size") % 5).alias("factor"))
    return rows.agg((F.sum(F.col("p_size")) / 100.0 - 1.0).alias("fc"), (1.0 / F.pow(F.lit(2.0), F.count("*") % 9)).alias("p"))


_ANN = "an AS (SELECT p_brand AS \"group\", p_size % 5 AS factor, SUM(p_size) / 100.0::DOUBLE - 1.0 AS fc, 1.0 / power(2.0, COUNT(*) % 9) AS p FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2)"


@query("a8_annotation_plot", f"""WITH {_ANN}, c AS (SELECT g."group", f.factor, LEAST(-log10(COALESCE(p, 1)), 100) AS s, GREATEST(COALESCE(fc, 0), 0) AS fc FROM (SELECT DISTINCT "group" FROM an) g CROSS JOIN (SELECT DISTINCT factor FROM an) f LEFT JOIN an ON an."group" = g."group" AND an.factor = f.factor),
d AS (SELECT "group", factor, CASE WHEN round_even(s, 0) = 0 THEN 0 ELSE fc END AS fc, s FROM c), e AS (SELECT *, MAX(fc) OVER (PARTITION BY "group") AS a, MAX(fc) OVER (PARTITION BY factor) AS b FROM d) SELECT "group", factor, round(fc, 6) AS fc, round(s, 6) + 0.0 AS neglog10 FROM e WHERE a > 0 AND b > 0""")
def a8(spark, sf):
    return rounded(annotate.annotation_plot(_annotations(spark, sf)), "fc", "neglog10")


@query("a11_metadata_plot", f"WITH {_MEANS} SELECT concat('NMF_', factor + 1) AS label, level AS \"group\", round(share, 6) AS share, round(SUM(share) OVER (PARTITION BY factor ORDER BY level ROWS UNBOUNDED PRECEDING), 6) AS upto FROM sh")
def a11(spark, sf):
    return rounded(annotate.metadata_plot(shares(spark, sf), segments(spark, sf)), "share", "upto")


@query("a12_contingency", "SELECT lang, source, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY lang), 6) AS freq FROM documents GROUP BY 1, 2")
def a12(spark, sf):
    return rounded(prepare.contingency(t(spark, sf, "documents"), "lang", "source"), "freq")


@query("a12_majority", "WITH c AS (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment AS label, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM c) WHERE r = 1")
def a12b(spark, sf):
    return prepare.majority(t(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("a12_make_unique", "SELECT p_partkey, p_brand || CASE WHEN k = 0 THEN '' ELSE '.' || k END AS unique_name FROM (SELECT p_partkey, p_brand, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)")
def a12c(spark, sf):
    return prepare.make_unique(t(spark, sf, "part"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("a13_leaf_order")
def a13(spark, sf):
    rows = annotate.metadata_summary(shares(spark, sf), segments(spark, sf)).groupBy("level").pivot("factor", [0, 1, 2]).agg(F.first("share")).orderBy("level").toPandas()
    order = annotate.leaf_order(rows[["0", "1", "2"]].to_numpy(float))
    return spark.createDataFrame([(i, rows["level"][k]) for i, k in enumerate(order)], "place int, level string")


# --- best rank ------------------------------------------------------------------------------------

_TRACE = [(2, 1, 0.5, 0), (2, 1, 0.4, 5), (3, 1, 0.45, 0), (3, 1, 0.3, 5), (3, 1, 0.3, 9), (5, 1, 0.4, 0), (5, 1, 0.2, 5), (5, 1, 0.25, 9), (4, 1, 0.31, 0), (2, 2, 0.5, 0), (2, 2, 0.45, 5), (6, 2, 0.4, 0), (6, 2, 0.1, 5), (6, 2, 0.4, 7), (2, 3, 0.4, 0), (2, 3, 0.9, 1), (7, 4, 0.3, 0), (8, 4, 0.3, 0)]
_VALUES = "tr(k, rep, test_error, iter) AS (VALUES " + ", ".join(map(str, _TRACE)) + ")"
_BEST = f"""{_VALUES}, b AS (SELECT *, MIN(test_error) OVER (PARTITION BY rep, k ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tr),
q AS (SELECT rep, k, COALESCE(MAX((test_error - before) / (test_error + before)), 0) AS rise, arg_max(test_error, iter) AS last FROM b GROUP BY 1, 2),
l AS (SELECT *, COALESCE(MIN(CASE WHEN rise > 1e-4 THEN k END) OVER (PARTITION BY rep), 1000000) AS top FROM q), o AS (SELECT r.rep, COALESCE((SELECT k FROM l WHERE l.rep = r.rep AND k < top ORDER BY last, k LIMIT 1), 2) AS k FROM (SELECT DISTINCT rep FROM l) r), best AS (SELECT CAST(floor(AVG(k)) AS INTEGER) AS best FROM o)"""


def _trace(spark):
    return spark.createDataFrame([(k, r, float(e), i, 0.0, 0.0) for k, r, e, i in _TRACE], rank.TRACE)


@query("m14_best_rank", f"WITH {_BEST} SELECT best FROM best")
def m14(spark, sf):
    return rank.best_rank(_trace(spark))


@query("a10_rank_plot", f"WITH {_BEST} SELECT rep, k, round(last / MIN(last) OVER (PARTITION BY rep), 6) AS rel, k = (SELECT best FROM best) AS is_best FROM q")
def a10(spark, sf):
    return rounded(rank.rank_plot(_trace(spark)), "rel")


# --- graphs ---------------------------------------------------------------------------------------

_SG = f"{C}, e AS (SELECT a.sample_id AS dst, b.sample_id AS src, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM c a JOIN c b ON abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3)"


@query("g1_spatial_graph", f"WITH {_SG}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dst ORDER BY src) AS r FROM e WHERE d < 2.5) SELECT dst, src, round(((2.5 - d) / 2.5) / SUM((2.5 - d) / 2.5) OVER (PARTITION BY dst), 6) AS weight FROM k WHERE r <= 12")
def g1(spark, sf):
    return rounded(graph.spatial_graph(lattice(spark, sf), 2.5, 12), "weight")


_KNN = f"{_SG}, {V}, n AS (SELECT dst, src, round(list_distance(a.v, b.v), 9) AS weight FROM e JOIN v a ON a.sample_id = dst JOIN v b ON b.sample_id = src WHERE d <= 3 AND dst <> src), knn AS (SELECT dst, src, weight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dst ORDER BY weight, src) AS r FROM n) WHERE r <= 5 AND weight <> 0)"


@query("g2_local_knn", f"WITH {_KNN} SELECT dst, src, round(weight, 6) AS weight FROM knn")
def g2(spark, sf):
    return rounded(graph.local_knn(vectors(spark, sf), lattice(spark, sf), 5, 3.0), "weight")


_SNN = "s AS (SELECT dst, COUNT(*) AS n FROM knn GROUP BY 1), i AS (SELECT a.dst AS a, b.dst AS b, COUNT(*) AS c FROM knn a JOIN knn b ON a.src = b.src AND a.dst <> b.dst GROUP BY 1, 2), snn AS (SELECT a AS dst, b AS src, c / (x.n + y.n - c) AS weight FROM i JOIN s x ON x.dst = a JOIN s y ON y.dst = b)"


@query("g3_shared_neighbours", f"WITH {_KNN}, {_SNN} SELECT dst, src, round(weight, 6) AS weight FROM snn WHERE weight > 0.1 UNION ALL SELECT dst, dst, 1.0 FROM s")
def g3(spark, sf):
    knn = graph.local_knn(vectors(spark, sf), lattice(spark, sf), 5, 3.0)
    return rounded(graph.shared_neighbours(knn, 0.1), "weight")


@query("g4_find_neighbours", f"WITH {_KNN}, {_SNN} SELECT dst, src, round(weight, 6) AS weight FROM snn WHERE weight > 1.0 / 15 UNION ALL SELECT dst, dst, 1.0 FROM s")
def g4(spark, sf):
    found = graph.find_local_neighbours(vectors(spark, sf), lattice(spark, sf), 5, 3.0, prune_knn=0.0)
    return rounded(found["snn"], "weight")


@query("g5_edge_clusters", f"WITH {_KNN} SELECT dst, (dst + src) % 4 AS cluster, COUNT(*) AS n FROM knn GROUP BY 1, 2")
def g5(spark, sf):
    knn = cut(graph.local_knn(vectors(spark, sf), lattice(spark, sf), 5, 3.0))
    return graph.edge_clusters(knn, knn.select("dst", "src", ((F.col("dst") + F.col("src")) % 4).alias("cluster")))


# --- enrichment -----------------------------------------------------------------------------------


def _weights(spark, sf):
    """A stand-in for W: per part three whole-number weights, some 0."""
    p = t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("feature_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("factor"), "p_size").select(
        "feature_id", "factor", ((F.col("p_size") * (F.col("factor") + 3) + F.col("feature_id") * 7) % 50).cast("double").alias("weight"))


def _sets(spark, sf):
    return t(spark, sf, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("feature_id"))


_ES = """w AS (SELECT p_partkey AS feature_id, f AS factor, CAST((p_size * (f + 3) + p_partkey * 7) % 50 AS DOUBLE) AS weight FROM part, range(0, 3) r(f)),
u AS (SELECT * FROM w WHERE feature_id IN (SELECT feature_id FROM w GROUP BY 1 HAVING MAX(weight) <> 0)), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY weight DESC, feature_id) AS pos, COUNT(*) OVER (PARTITION BY factor) AS total FROM u),
st AS (SELECT p_brand AS set_id, p_partkey AS feature_id, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_partkey IN (SELECT feature_id FROM u)),
j AS (SELECT set_id, factor, n, pos, total, weight, SUM(weight) OVER (PARTITION BY set_id, factor ORDER BY pos) / SUM(weight) OVER (PARTITION BY set_id, factor) AS hit, ROW_NUMBER() OVER (PARTITION BY set_id, factor ORDER BY pos) AS k FROM rk JOIN st USING (feature_id) WHERE n > 3 AND n < 2000),
es AS (SELECT set_id, factor, n, GREATEST(MAX(hit - (pos - k) / (total - n)), 0) AS es FROM j GROUP BY 1, 2, 3)"""


@query("a6_enrichment_scores", f"WITH {_ES} SELECT set_id, CAST(factor AS INTEGER) AS factor, n, round(es, 6) AS es FROM es")
def a6(spark, sf):
    return rounded(enrich.enrichment_scores(_weights(spark, sf), _sets(spark, sf), 3, 2000), "es")


@query("a6_gsea")
def a6b(spark, sf):
    return enrich.gsea(_weights(spark, sf), _sets(spark, sf), 3, 2000, permutations=20)


def _tested(spark, sf):
    """Made-up adjusted p-values with holes."""
    es = enrich.enrichment_scores(_weights(spark, sf), _sets(spark, sf), 3, 2000)
    return es.select("set_id", "factor", F.pow(F.lit(10.0), -((F.col("n") + 2 * F.col("factor")) % 4) - F.col("factor") / 10).alias("padj")).where("padj < 0.9")


_PADJ = f"{_ES}, te AS (SELECT set_id, factor, power(10.0, -((n + 2 * factor) % 4) - factor / 10) AS padj FROM es WHERE power(10.0, -((n + 2 * factor) % 4) - factor / 10) < 0.9), pd AS (SELECT s.set_id, f.factor, padj FROM (SELECT DISTINCT set_id FROM te) s CROSS JOIN (SELECT DISTINCT factor FROM te) f LEFT JOIN te USING (set_id, factor))"


@query("a7_pad", f"WITH {_PADJ} SELECT set_id, CAST(factor AS INTEGER) AS factor, round(padj, 8) AS padj FROM pd")
def a7(spark, sf):
    return rounded(enrich.pad(_tested(spark, sf)), "padj", digits=8)


_HEATMAP = f"""WITH {_PADJ}, sc AS (SELECT *, -log10(COALESCE(padj, 1)) AS s FROM pd), sh AS (SELECT *, s / NULLIF(SUM(s) OVER (PARTITION BY set_id), 0) AS share, COUNT(*) FILTER (s > -log10(0.05)) OVER (PARTITION BY set_id) AS hits, COUNT(*) OVER (PARTITION BY set_id) AS k FROM sc),
tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY round(share, 9) DESC, set_id) AS r FROM sh WHERE s > -log10(0.05)) SELECT set_id, CAST(factor AS INTEGER) AS factor, round(share, 6) AS share, set_id AS label FROM sh WHERE set_id IN (SELECT set_id FROM tp WHERE r <= 3)"""


@query("a9_heatmap_all", _HEATMAP)
def a9(spark, sf):
    return rounded(enrich.heatmap(_tested(spark, sf), drop_common=False), "share")


@query("a9_heatmap", _HEATMAP + " AND hits <= k / 2")
def a9_specific(spark, sf):
    return rounded(enrich.heatmap(_tested(spark, sf)), "share")


def flagship(spark, sf):
    """Parts x customers, log-normalized, balanced by market segment, factorized with rank 4, summed up by segment."""
    codes = prepare.group_codes(segments(spark, sf), "level")
    m = prepare.weight_by_split(normalized(spark, sf), codes)
    model = nmf.run_nmf(cut(m), 4, maxit=3)
    return annotate.metadata_summary(model.long("h"), segments(spark, sf))


QUERIES["flagship"] = flagship
