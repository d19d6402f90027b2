"""Factorizations, graphs and summaries against numpy twins and invariants."""

import math
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom import session
from factorloom.functions import kernels, rng
from factorloom.operators import annotate, enrich, graph, matrix, nmf, prepare, rank
from factorloom.plans import fixtures
from factorloom.sources import matrix_io


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    dense = (r.random((20, 3)) @ r.random((3, 15))) * (r.random((20, 15)) < 0.7)
    dense[:, 4] = 0  # a sample without cells
    cells = [(i, j, float(dense[i, j])) for i in range(20) for j in range(15) if dense[i, j]]
    ids = lambda n: spark.range(n).select("id")
    return dense, spark.createDataFrame(cells, "row_id long, col_id long, value double").cache(), ids(20), ids(15)


def twin(a, k, iterations, l1=0.01, mask=None, seed=1):
    """The same alternation on dense arrays."""
    w = rng.uniform_np(seed, np.arange(len(a))[:, None], np.arange(k)[None])

    def solve(a, w, out):
        whole = kernels.gram(w)
        keep = a if out is None else np.where(out, 0, a)
        return kernels.nnls(whole if out is None else kernels.masked_gram(w, whole, out), keep.T @ w, l1)

    for _ in range(iterations):
        h = solve(a, w, mask)
        h /= h.sum(0) + 1e-15
        w = solve(a.T, h, None if mask is None else mask.T)
        d = w.sum(0) + 1e-15
        w /= d
    return w, d, h


def arrays(df, ident):
    return np.array([r["weights"] for r in df.orderBy(ident).collect()])


@pytest.mark.parametrize("limit", [nmf.BROADCAST_BYTES, 0])
def test_fit_equals_the_twin(data, limit):
    dense, m, features, samples = data
    model = nmf.run_nmf(m, 3, tol=0, maxit=3, features=features, samples=samples, limit=limit)
    w, d, h = twin(dense, 3, 3)
    order = np.argsort(-d, kind="stable")
    assert np.allclose(model.d, d[order]) and np.allclose(arrays(model.w, "feature_id"), w[:, order]) and np.allclose(arrays(model.h, "sample_id"), h[:, order])
    assert np.allclose(arrays(model.w, "feature_id").sum(0), 1) and (np.diff(model.d) <= 0).all()
    assert (arrays(model.h, "sample_id")[4] == 0).all()


@pytest.mark.parametrize("limit", [nmf.BROADCAST_BYTES, 0])
def test_split_groups_give_the_same(data, limit):
    dense, m, features, samples = data
    p = nmf.problem(m, features, samples, cells=3)
    assert p.by_col.long is not None and p.by_row.rows.where(F.size("idx") > 9).count() == 0
    model = nmf.fit(p, 3, tol=0, maxit=2, limit=limit)
    w, d, h = twin(dense, 3, 2)
    order = np.argsort(-d, kind="stable")
    assert np.allclose(model.d, d[order]) and np.allclose(arrays(model.w, "feature_id"), w[:, order]) and np.allclose(arrays(model.h, "sample_id"), h[:, order])


def test_cells_stay_in_their_buckets(data):
    _, m, features, samples = data
    p = nmf.problem(m, features, samples)
    plan = nmf.half_step(p.by_col, nmf.start(p.features, 2, 1), 2, limit=0)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("idx" in line for line in moved) and "Bucketed: true" in plan


@pytest.mark.parametrize("limit", [nmf.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("cells", [nmf.CELLS, 4])
def test_masked_fit_equals_the_twin(data, limit, cells):
    dense, m, features, samples = data
    p = nmf.problem(m, features, samples, cells)
    rows = rank.masked_fit(p, 2, rep=1, tol=0, maxit=2, every=1, seed=1, tol_overfit=1.0, limit=limit)
    mask = rng.masked_np(2, np.arange(15)[None], np.arange(20)[:, None], 20)
    for i, row in enumerate(rows):
        w, d, h = twin(dense, 2, i + 1, mask=mask)
        error = np.where(mask, (w * d @ h.T - dense) ** 2, 0).sum(0) / np.maximum(mask.sum(0), 1)
        assert row[2] == pytest.approx(error.mean())


def test_projection_of_the_training_data(data):
    _, m, features, samples = data
    model = nmf.run_nmf(m, 2, tol=1e-6, maxit=25, l1=0, features=features, samples=samples)
    again = nmf.project(m, model.w, l1=0).h
    both = model.h.join(again.withColumnRenamed("weights", "again"), "sample_id").collect()
    assert np.allclose([r["weights"] for r in both], [r["again"] for r in both], atol=1e-3)


def test_links_shut_factors_out(spark, data):
    _, m, features, samples = data
    link = samples.select("id", F.array(F.when(F.col("id") < 7, 0.0).otherwise(1.0), F.lit(1.0)).alias("link"))
    model = nmf.run_linked_nmf(m, 2, link_h=link, maxit=2)
    h = {r["sample_id"]: r["weights"] for r in model.h.collect()}
    assert any(all(h[j][f] == 0 for j in h if j < 7) and any(h[j][f] for j in h if j >= 7) for f in (0, 1))
    with pytest.raises(ValueError):
        nmf.run_linked_nmf(m, 2)


def test_graph_fit_with_self_edges_is_the_plain_fit(data):
    _, m, _, samples = data
    present = m.select(F.col("col_id").alias("id")).distinct()
    loops = present.select(F.col("id").alias("dst"), F.col("id").alias("src"), F.lit(1.0).alias("weight"))
    a, b = nmf.run_graph_nmf(m, loops, 2, maxit=2), nmf.run_nmf(m, 2, maxit=2)
    assert np.allclose(arrays(a.h, "sample_id"), arrays(b.h, "sample_id"))


def test_best_rank_forms_agree(spark):
    rows = [(2, 1, 0.5, 0), (2, 1, 0.4, 5), (3, 1, 0.45, 0), (3, 1, 0.3, 5), (5, 1, 0.4, 0), (5, 1, 0.2, 5), (5, 1, 0.25, 9), (2, 2, 0.4, 0), (2, 2, 0.9, 1), (6, 3, 0.3, 0)]
    rows = [(k, rep, e, i, 0.0, 0.0) for k, rep, e, i in rows]
    trace = spark.createDataFrame(rows, rank.TRACE)
    assert rank.best_rank(trace).first()[0] == rank.best_rank_rows(rows) == (3 + 2 + 6) // 3


def test_batch_penalty_is_zero_for_equal_batches(spark):
    h = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(6)], "id long, weights array<double>")
    batches = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, batch string")
    assert all(r["l1"] == [0, 0] for r in nmf.batch_l1(h, batches, 2).collect())


def test_near_pairs_equal_the_nested_loop(spark):
    r = np.random.default_rng(2)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(0, 4, (120, 2)))]
    got = {(a.dst, a.src) for a in graph.near_pairs(spark.createDataFrame(points, "sample_id long, x double, y double"), 1.5).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if np.hypot(a[1] - b[1], a[2] - b[2]) <= 1.5}


def test_spatial_weights_sum_to_one(spark):
    points = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)], "sample_id long, x double, y double")
    sums = graph.spatial_graph(points, 1.6).groupBy("dst").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 25 and all(r.s == pytest.approx(1) for r in sums)


def test_group_totals_are_equal_after_weighting(spark, data):
    _, m, _, samples = data
    codes = samples.select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("code"))
    out = prepare.weight_by_split(m, codes).join(codes.withColumnRenamed("sample_id", "col_id"), "col_id")
    totals = [r[1] for r in out.groupBy("code").agg(F.sum("value")).collect()]
    assert np.allclose(totals, totals[0])


def test_equality_and_round_trips(spark, data):
    _, m, _, _ = data
    assert matrix.equal(m, matrix.from_ivcsc(matrix.to_ivcsc(m)).select(*m.columns)) and matrix.equal(matrix.transpose(matrix.transpose(m)), m)
    assert not matrix.equal(m, matrix.scale(m, 2))
    assert matrix.equal(matrix.from_csc_arrays(spark, [0, 2, 1], [0, 2, 2, 3], [1, 2, 3]), spark.createDataFrame([(0, 0, 1.0), (2, 0, 2.0), (1, 2, 3.0)], m.schema))


def test_missing_levels_are_refused(spark):
    with pytest.raises(ValueError):
        prepare.group_codes(spark.createDataFrame([(1, "a"), (2, None)], "sample_id long, level string"), "level")


def test_normal_scores_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None), (4, 2.0)], "i long, v double").withColumn("g", F.lit(1))
    got = {r.i: r for r in prepare.normal_scores(rows, "v", ["g"]).collect()}
    assert got[3].score is None and got[4].score == pytest.approx(0) and got[1].score == pytest.approx(-got[2].score)


def test_moderated_results_find_the_planted_group(spark):
    r = np.random.default_rng(4)
    h = spark.createDataFrame([(i, f, float(r.normal(1, 0.2) + 2 * (f == 1 and i % 3 == 0))) for i in range(60) for f in range(4)], "sample_id long, factor int, weight double")
    groups = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "sample_id long, level string")
    found = annotate.model_results(annotate.moderated(annotate.model_fit(h, groups))).collect()
    best = min(found, key=lambda x: x.p)
    assert (best.group, best.factor) == ("a", 1) and best.p < 1e-6


def test_enrichment_finds_the_planted_set(spark):
    w = spark.createDataFrame([(i, 0, float(100 - i if i < 20 else 1 + i % 7)) for i in range(200)], "feature_id long, factor int, weight double")
    sets = spark.createDataFrame([("top", i) for i in range(15)] + [("flat", i) for i in range(0, 200, 12)], "set_id string, feature_id long")
    got = {r.set_id: r for r in enrich.gsea(w, sets, permutations=60).collect()}
    assert got["top"].es > got["flat"].es and got["top"].pval < 0.05 < got["flat"].pval


def test_leaf_order_keeps_clusters_together():
    rows = np.array([[0, 0], [9, 9], [0, 1], [9, 8], [0, 0.5]])
    order = annotate.leaf_order(rows)
    near = [order.index(i) for i in (1, 3)]
    assert abs(near[0] - near[1]) == 1 and sorted(order) == list(range(5))


def test_stream_equals_batch(spark, data, tmp_path):
    from factorloom.streaming.project import project_stream

    _, m, _, _ = data
    model = nmf.run_nmf(m, 2, maxit=3)
    rows = nmf.blocks(m, "col_id").rows
    rows.write.parquet(str(tmp_path / "in"))
    out = project_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model)
    q = out.writeStream.format("memory").queryName("projected").start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.weights for r in spark.table("projected").collect()}
    want = {r.id: r.weights for r in project_stream(rows, model).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in got)


def test_stream_takes_a_model_beyond_the_limit(spark, data, tmp_path, monkeypatch):
    from factorloom.streaming import project

    _, m, _, _ = data
    model = nmf.run_nmf(m, 2, maxit=3)
    model = nmf.Model(model.w.where("feature_id <> 5"), model.d, model.h)  # the others know a feature that it lacks
    rows = nmf.blocks(m, "col_id", spark.range(15)).rows
    want = {r.id: r.weights for r in project.project_stream(rows, model).collect()}
    monkeypatch.setattr(project, "TASK_BYTES", 100, raising=False)  # several files of W
    for lot in (1, 30, 1 << 21):
        monkeypatch.setattr(project, "LOT", lot, raising=False)
        got = {r.id: r.weights for r in project.project_stream(rows, model, limit=0).collect()}
        assert got.keys() == want.keys() and len(got) == 15 and all(np.allclose(got[i], want[i], rtol=1e-9, atol=0) for i in got)
    rows.write.parquet(str(tmp_path / "in"))
    out = project.project_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model, limit=0)
    q = out.writeStream.format("memory").queryName("projected_beyond").start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.weights for r in spark.table("projected_beyond").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9, atol=0) for i in got)


def test_moderated_takes_factors_and_groups_without_variance(spark):
    h = spark.createDataFrame([(i, f, w) for i in range(12) for f, w in ((0, 0.1 * (i % 5) + i // 6), (1, 0.0))], "sample_id long, factor int, weight double")
    groups = spark.range(12).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 6, "a").otherwise("b").alias("level"))
    rows = annotate.model_results(annotate.moderated(annotate.model_fit(h, groups)), noneg=False).collect()
    assert len(rows) == 4 and all((r["fc"] is None and r["p"] is None) == (r["factor"] == 1) for r in rows)
    constant = h.select("sample_id", "factor", F.when(F.col("sample_id") < 6, 1.0).otherwise(0.0).alias("weight"))
    rows = annotate.model_results(annotate.moderated(annotate.model_fit(constant, groups)), noneg=False).collect()
    assert all((r["p"] == 0) == (r["group"] == "a") and math.isfinite(r["fc"]) for r in rows)
    alone = groups.select("sample_id", F.col("sample_id").cast("string").alias("level"))
    assert all(r["fc"] is None for r in annotate.model_results(annotate.moderated(annotate.model_fit(h, alone)), noneg=False).collect())


def test_fits_side_by_side_ship_the_package_once():
    sent = []
    context = SimpleNamespace(applicationId="app-of-the-test", addPyFile=lambda path: (time.sleep(0.1), sent.append(path)))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: session.ship(SimpleNamespace(sparkContext=context)), range(4)))
    assert len(sent) == 1


def test_run_lengths_write_out_no_zeros(spark):
    runs = spark.createDataFrame([(0, 0, 0.0, 2_000_000_000), (0, 1, 4.0, 2), (0, 2, 0.0, 2_000_000_000), (0, 3, 5.0, 1)], "col_id long, at long, value double, n long")
    assert {(r["row_id"], r["value"]) for r in matrix_io.run_lengths(runs).collect()} == {(2_000_000_000, 4.0), (2_000_000_001, 4.0), (4_000_000_002, 5.0)}


def test_shuffle_partitions_grow_with_a_table(spark, tmp_path, monkeypatch):
    kept = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", session._ADVISORY, "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.range(50_000).write.parquet(f"file://{tmp_path}/lineitem.parquet")
        fixtures.t(spark, f"file://{tmp_path}", "lineitem")
        assert {name: spark.conf.get(name) for name in kept} == kept  # a small table leaves them
        monkeypatch.setattr(session, "TASK_BYTES", 10_000)
        table = fixtures.t(spark, f"file://{tmp_path}", "lineitem")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 20 and int(spark.conf.get(session._ADVISORY)) == 10_000
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it makes no partitions under 1 MB
        parts = table.groupBy("id").count().select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in parts) < 10_000
        side = nmf.blocks(table.select(F.col("id").alias("row_id"), (F.col("id") % 500).alias("col_id"), F.lit(1.0).alias("value")), "col_id")
        assert len(side.rows.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file for each bucket
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_ids_without_cells_are_sought_among_sizes(data, monkeypatch):
    m, plans, write = session.cut(data[1]), [], nmf._bucketed
    monkeypatch.setattr(nmf, "_bucketed", lambda rows, keys, n: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, keys, n))
    reads = lambda plan: sum("Relation" in line and "value" in line for line in plan.splitlines())
    side = nmf.blocks(m, "col_id", data[3])
    assert sorted((r["id"], len(r["idx"])) for r in side.rows.collect()) == [(j, int((data[0][:, j] != 0).sum())) for j in range(15)]
    assert "LeftAnti" in plans[0] and reads(plans[0]) == 1  # cells are read for the groups alone
    nmf.problem(m)  # ids that come from the cells have cells
    assert len(plans) == 3 and not any("LeftAnti" in plan or reads(plan) > 1 for plan in plans[1:])


def test_read_splits_stay_small(spark, tmp_path, monkeypatch):
    names = ("spark.sql.shuffle.partitions", session._ADVISORY, "spark.sql.files.maxPartitionBytes")
    kept = {name: spark.conf.get(name) for name in names}
    try:
        spark.range(0, 200_000, 1, 20).write.parquet(f"file://{tmp_path}/lineitem.parquet")
        most = lambda: max(r["count"] for r in fixtures.t(spark, f"file://{tmp_path}", "lineitem").groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert most() > 10_000 and {name: spark.conf.get(name) for name in names} == kept  # a small table leaves them
        for name in ("TASK_BYTES", "READ_BYTES"):
            monkeypatch.setattr(session, name, 60_000, raising=False)
        assert most() == 10_000  # a file a task
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        most()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "20000b"  # never loosened
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
