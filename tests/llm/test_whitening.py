"""Whitening against the dense eigenproblem."""

import math
from collections import defaultdict

import numpy as np
import pytest

from glosswerk.llm import whitening
from glosswerk.llm.shared import read

SF = "/root/testdata/sf0.001"


def dense(x: np.ndarray, k: int = 8):
    """n, deviations, eigenvalues, eigenvectors and trace of integer vectors."""
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    v = (exact / n).T @ (exact / n) / n
    e, q = np.linalg.eigh(v)
    return n, (exact**2).sum(axis=1), e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def check(got, ids, vectors, k=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=np.int64)
    n, deviation, e, q, trace = dense(x, k)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    w = (x - x.sum(axis=0) / n) @ q / np.sqrt(e)
    signs = np.sign([[next(r.whitened for r in by_id[ids[0]] if r.component == c + 1)] for c in range(len(e))]).ravel() * np.sign(w[0])
    for i, vec_id in enumerate(ids):
        rows = sorted(by_id[vec_id], key=lambda r: r.component)
        assert [r.component for r in rows] == [*range(1, len(e) + 1)]
        assert {(r.n, r.deviation) for r in rows} == {(n, int(deviation[i]))}
        assert np.allclose([r.whitened for r in rows], w[i] * signs, atol=1e-7)
        assert np.allclose([r.explained for r in rows], e / trace, rtol=1e-10)
        assert all(r.identity_error < 1e-9 for r in rows)


def test_query_against_dense_eigenvectors(spark):
    table = read(spark, SF, "embeddings")
    rows = table.orderBy("vec_id").collect()
    check(whitening.digests(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_large_dimension_takes_several_steps(spark):
    """Three blocks do not fill the space, so the iteration itself is at work."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 120)) * np.linspace(0.2, 2.0, 120)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    check(whitening.whiten(df, tolerance=1e-12).collect(), [*range(300)], x)


@pytest.mark.parametrize("dims", [100, 400])
def test_lobpcg_on_close_eigenvalues(dims):
    r = np.random.default_rng(dims)
    a = r.normal(size=(3000, dims))
    v = a.T @ a / 3000
    values, axes = whitening.lobpcg(lambda b: v @ b, dims)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(values, want, rtol=1e-12) and np.allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() <= 1e-13 * values[0] * 1.01
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: v @ b, dims, steps=1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, 5.0, 0.25]), (None, [2.0, 1.0, -3.0]), (5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 0.0, 0.0]), (10, [1.0, 2.0]), (11, [3.0, 1.0]), (12, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, component string, n int")
    got = whitening.digests(df).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1) for r in got if r.n == 5) == sorted([-1, 1, 1, 2, 3] * 3)
    two = [r for r in got if r.vec_id in (10, 11)]
    assert {(r.vec_id, r.component, r.n) for r in two} == {(10, 1, 2), (11, 1, 2)}  # one direction has all the variance
    assert sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0]
    assert whitening.digests(df.where("vec_id = 1")).count() == 0  # equal vectors have no direction
    assert whitening.digests(df.where("vec_id > 100")).count() == 0
    assert whitening.digests(df.where("vec_id = 1")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [0.0, 0.0]), (1, [2.0**21, 1.0]), (2, [2.0**20, 3.0])]
    got = {(r.vec_id, r.deviation) for r in whitening.digests(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert got == {(k, e if e < 2**63 else None) for k, e in enumerate(exact)} and any(e > 2**62 for e in exact)
