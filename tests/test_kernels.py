"""Kernels and functions against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.functions import kernels, rng, stats


def loop_nnls(a, b, l1, l2):
    x, b, k = np.zeros(len(b)), b.copy(), len(b)
    for _ in range(kernels.SWEEPS):
        tol = 0.0
        for i in range(k):
            diff = b[i] / a[i, i] - l1 + l2 * x[i]
            if -diff > x[i]:
                if x[i] != 0:
                    b += a[:, i] * x[i]
                    x[i] = 0
                    tol = 1.0
            elif diff != 0:
                x[i] += diff
                b -= a[:, i] * diff
                tol += abs(diff / (x[i] + 1e-15))
        if tol / k <= 1e-8:
            break
    return x


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000), st.sampled_from([0.0, 0.01, 0.5]), st.sampled_from([0.0, 0.1]))
def test_batched_nnls_equals_the_loop(k, seed, l1, l2):
    r = np.random.default_rng(seed)
    w = r.random((12, k))
    a, b = kernels.gram(w), r.normal(1, 2, (5, k))
    got = kernels.nnls(a, b, l1, l2)
    assert np.allclose(got, [loop_nnls(a, row, l1, l2) for row in b], atol=1e-9)
    assert np.allclose(kernels.nnls(np.repeat(a[None], 5, 0), b, l1, l2), got)
    assert (got >= 0).all()


def test_rank_one_has_a_closed_form():
    a, b = np.array([[4.0]]), np.array([[8.0], [-1.0], [0.02]])
    assert np.allclose(kernels.nnls(a, b, 0.01).ravel(), [1.99, 0, 0])


def test_cross_and_masked_gram():
    r = np.random.default_rng(1)
    w, sizes = r.random((9, 3)), np.array([0, 4, 0, 5, 0])
    index, values = r.integers(0, 9, 9), r.random(9)
    want = [sum((values[j] * w[index[j]] for j in range(a, a + n)), np.zeros(3)) for a, n in zip([0, 0, 4, 4, 9], sizes)]
    assert np.allclose(kernels.cross(values, index, sizes, w), want)
    mask = r.random((9, 5)) < 0.3
    got = kernels.masked_gram(w, kernels.gram(w), mask)
    assert np.allclose(got, [kernels.gram(w[~mask[:, j]]) for j in range(5)])


def test_hash_mask_density_and_nesting():
    m = rng.masked_np(3, np.arange(300)[:, None], np.arange(400)[None], 20)
    assert 0.045 < m.mean() < 0.055
    u = rng.uniform_np(3, np.arange(1000)[:, None], np.arange(8)[None])
    assert 0.48 < u.mean() < 0.52 and 0.27 < u.std() < 0.30


def test_hash_column_equals_numpy(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", (F.col("id") * 7919 % 1000).alias("j"))
    got = rows.select("id", "j", rng.hash64(123, F.col("id"), F.col("j")).alias("h"), rng.masked(9, F.col("id"), F.col("j"), 20).alias("m"), rng.uniform(9, F.col("id"), F.col("j")).alias("u")).toPandas()
    i, j = got["id"].to_numpy(), got["j"].to_numpy()
    assert (got["h"].to_numpy() == rng.hash64_np(123, i, j).view(np.int64)).all()
    assert (got["m"].to_numpy() == rng.masked_np(9, i, j, 20)).all() and (got["u"].to_numpy() == rng.uniform_np(9, i, j)).all()


def test_special_functions():
    assert stats.digamma(1) == pytest.approx(-0.5772156649015329) and stats.trigamma(1) == pytest.approx(np.pi**2 / 6)
    for y in (0.01, 0.5, 3.0, 50.0):
        assert stats.trigamma(stats.inverse_trigamma(y)) == pytest.approx(y, rel=1e-6)
    # quantiles from printed tables
    for df, t in ((1, 6.314), (5, 2.015), (30, 1.697)):
        assert stats.t_cdf(t, df) == pytest.approx(0.95, abs=2e-4)
    assert stats.t_cdf(-1.3, 7) == pytest.approx(1 - stats.t_cdf(1.3, 7)) and stats.t_cdf(1.959964, float("inf")) == pytest.approx(0.975, abs=1e-6)


def test_variance_prior_recovers_what_was_drawn():
    r = np.random.default_rng(5)
    d0, s0, df = 8.0, 2.0, 20
    s2 = s0 * d0 / r.chisquare(d0, 20_000) * r.chisquare(df, 20_000) / df
    got = stats.fit_variance_prior(s2, df)
    assert got[0] == pytest.approx(d0, rel=0.1) and got[1] == pytest.approx(s0, rel=0.05)


def test_compressed_file_bytes_and_round_trip(spark, tmp_path):
    import struct

    from factorloom.sources import ivsparse

    cells = [(0, 0, 2.5), (7, 0, 2.5), (3, 0, -1.0), (300, 2, 2.5), (301, 2, 2.5), (0, 2, 4.0), (70_000, 4, 1.0)]
    m = spark.createDataFrame(cells, "row_id long, col_id long, value double")
    path = f"file://{tmp_path}/m.ivsparse"
    ivsparse.write(m, path, 70_001, 6)
    data = (tmp_path / "m.ivsparse").read_bytes()
    first = struct.pack("<dB", -1.0, 1) + bytes([3, 0]) + struct.pack("<dB", 2.5, 1) + bytes([0, 7, 0])
    third = struct.pack("<dBHHH", 2.5, 2, 300, 1, 0) + struct.pack("<dB", 4.0, 1) + bytes([0, 0])
    fifth = struct.pack("<dB", 1.0, 3) + (70_000).to_bytes(3, "little") + bytes(3)
    assert data == struct.pack("<6I", 3, 70_001, 6, 7, 0x01010108, 8) + struct.pack("<6Q", len(first), 0, len(third), 0, len(fifth), 0) + first + third + fifth
    for at_once in (1 << 20, 10):
        assert sorted(map(tuple, ivsparse.read(spark, path, at_once).collect())) == sorted(cells)
    ivsparse.write(m.limit(0), path, 3, 2)
    assert ivsparse.read(spark, path).collect() == []
    assert ivsparse.show(m, 8, 2).splitlines()[0] == "2.5 0" and len(ivsparse.show(m, 8, 2).splitlines()) == 8
    long = list(ivsparse.decode_column(ivsparse.encode_column([1.0], [2], [[0, *[300] * 5000]])))
    assert (long[0][1] == 300 * np.arange(5001)).all()


def test_group_balancing_needs_its_first_group(spark):
    from factorloom.operators import prepare

    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row_id long, col_id long, value double")
    codes = spark.createDataFrame([(0, 1), (1, 2)], "sample_id long, code int")
    with pytest.raises(ValueError):
        prepare.weight_by_split(m, codes)
    assert prepare.weight_by_split(m.limit(0), codes).collect() == []


@pytest.mark.parametrize("inverse", [20, 16, 7, 1])
def test_masked_blocks_have_each_masked_pair_once(inverse):
    """With classes and without; with them, pairs that can't be masked are left out."""
    r = np.random.default_rng(1)
    own, other = r.integers(0, 1 << 40, 70), r.integers(0, 1 << 40, 3000)
    for by_sample in (True, False):
        want = rng.masked_np(5, own[:, None], other[None], inverse) if by_sample else rng.masked_np(5, other[None], own[:, None], inverse)
        for classed in (1, 1 << 30):
            got, looked = np.zeros(want.shape, int), 0
            for a, b, hit in rng.masked_blocks(5, inverse, by_sample, own, other, classed):
                got[np.ix_(a, b)] += hit
                looked += hit.size
            assert (got == want).all()
            assert looked < 0.3 * want.size or inverse != 20 or classed > 1


def test_class_of_a_sample_as_a_column(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", rng.sample_class(9, F.col("id"), 13).alias("c")).collect()
    assert [r["c"] for r in rows] == [int(x) & 8191 for x in rng.left_np(9, np.array([r["id"] for r in rows]))]


def test_ivsparse_columns_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    from factorloom.sources import ivsparse

    cells = [(i, j, float(i % 3 + 1)) for j in (0, 3, 4, 90) for i in range(j, 200 + j)]
    m = spark.createDataFrame(cells, "row_id long, col_id long, value double")
    whole = type(m).collect
    monkeypatch.setattr(type(m), "toLocalIterator", None)
    monkeypatch.setattr(type(m), "collect", lambda df: [r for r in whole(df) if not any(isinstance(v, (bytes, bytearray)) for v in r)])
    monkeypatch.setattr(ivsparse, "AT_ONCE", 32)
    ivsparse.write(m, f"file://{tmp_path}/m.ivsparse", 300, 120)
    monkeypatch.undo()
    assert sorted(map(tuple, ivsparse.read(spark, f"file://{tmp_path}/m.ivsparse", 1 << 9).collect())) == sorted(cells)
