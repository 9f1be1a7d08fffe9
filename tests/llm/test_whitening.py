import math

import numpy as np
import pytest

from vecatlas.llm.whitening import _deviations, fit, jacobi, pivoted_cholesky, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, x int, i int"


def run(spark, vectors, most=16, parts=3):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    model, width = fit(df, most)
    return whitened(df, model, width).collect()


def brute(vectors, most=16):
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in enumerate(vectors)}
    rows = sorted(set(x.values()))
    n, sums = len(rows), [sum(r[j] for r in rows) for j in range(len(rows[0]))]
    y = np.array([[n * r[j] - sums[j] for j in range(len(sums))] for r in rows], dtype=np.float64) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return x, n, sums, e, u, np.trace(v)


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 20)) @ np.diag(np.linspace(0.02, 9, 20)) + 50).tolist()
    vectors += vectors[:150] + [vectors[7]] * 300
    x, n, sums, e, u, trace = brute(vectors)
    rows = run(spark, vectors)
    assert len(rows) == 16 * len(vectors)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    sign = {}
    for (i, k), r in by.items():
        d = np.array([n * c - s for c, s in zip(x[i], sums)], dtype=object)
        assert r["n"] == n and r["deviation"] == int((d * d).sum())
        want = float(np.array(d / n, dtype=np.float64) @ u[:, k - 1] / math.sqrt(e[k - 1]))
        if abs(want) > 1e-3:
            sign.setdefault(k, np.sign(want * r["whitened"]))
            assert abs(r["whitened"] * sign[k] - want) < 1e-7
        assert abs(r["explained"] - e[k - 1] / trace) < 1e-9 * r["explained"]
        assert r["identity_error"] < 1e-9


def test_rank_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, size=(60, 3)) / 64
    vectors = [[a, b, c, a + b, 5.0] for a, b, c in base.tolist()]
    rows = run(spark, vectors)
    assert {r["component"] for r in rows} == {1, 2, 3}
    assert max(r["identity_error"] for r in rows) < 1e-9
    assert abs(sum(r["explained"] for r in rows) / len(vectors) - 1) < 1e-9


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [nan, 1.0], [1.0, inf], [-inf, 1.0], [None, 1.0], [], [1.0], [3.0, -2.0], [3.0, -2.0], [1e30, 0.0], [0.5, 0.25]]
    rows = run(spark, vectors)
    assert {r["vec_id"] for r in rows} == {0, 8, 9, 11} and {r["n"] for r in rows} == {3}
    assert len(rows) == 8


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []]])
def test_nothing_varies(spark, vectors):
    assert run(spark, vectors) == []


def test_null_and_repeated_ids_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 2 else 1, rng.normal(size=300).astype(np.float32).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model, width = fit(df, 5)
    out = whitened(df, model, width).collect()
    assert len(out) == 200 and sum(r["vec_id"] is None for r in out) == 100 and out[0]["identity_error"] < 1e-9


def test_deviation_beyond_doubles_and_longs():
    x = np.array([[3_000_000_000, 1]], dtype=np.int64)
    assert _deviations(x, 1, [1, 1]) == [(3_000_000_000 - 1) ** 2]
    assert _deviations(x, 10**6, [1, 1]) == [None]
    assert _deviations(np.array([[1_000_003]]), 10**9, [10**15]) == [(3 * 10**9) ** 2]


def test_factor_and_rotations():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 12)) @ np.diag(10.0 ** np.arange(0, -12, -1))
    a = a @ a.T
    left = pivoted_cholesky(a)
    assert np.allclose(left @ left.T, a, atol=1e-12)
    values, vectors = jacobi(left)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert np.allclose(values[:6], np.linalg.eigvalsh(a)[::-1][:6], rtol=1e-8)
