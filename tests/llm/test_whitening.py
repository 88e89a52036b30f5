"""Operator 12 against exact sums and a dense eigensolver."""

import math

import numpy as np
import pytest

from reelspark.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, dim string, component int"


def vectors(n=700, d=12, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.linspace(3, 0.2, d)
    return (rng.standard_normal((n, d)) @ mix + 5).astype(np.float32)


def frame_of(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(a) for a in v], 1, "a", 2) for i, v in enumerate(x)] + list(extra), SCHEMA).repartition(5)


BAD = [(9000, None, 1, "a", 2), (9001, [float("nan")] + [1.0] * 11, 1, "a", 2), (9002, [None] + [1.0] * 11, 1, "a", 2),
       (9003, [float("-inf")] + [1.0] * 11, 1, "a", 2), (9004, [], 1, "a", 2)]


def test_whitening_equals_a_dense_solver(spark):
    x = vectors()
    x[5] = 0  # a zero vector takes part
    got = whitening.whiten(frame_of(spark, x, BAD)).collect()
    whole = np.floor(x.astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), whole.sum(axis=0)
    c = (n * whole - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    assert {(r.vec_id, r.component) for r in got} == {(i, k) for i in range(n) for k in range(1, 9)} and len(got) == 8 * n
    want = c @ v[:, :8] / np.sqrt(e[:8])
    mine = np.zeros_like(want)
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == sum(int(t) ** 2 for t in n * whole[r.vec_id] - s)
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-9


def test_deviation_beyond_64_bits(spark):
    x = np.array([[1e9, -1e9], [-1e9, 1e9], [3.0, 4.0]], dtype=float)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(
        [(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    whole = [[math.floor(a * 1024) + 100000 for a in v] for v in x.tolist()]
    s = [sum(c) for c in zip(*whole)]
    assert got == {i: sum((3 * a - t) ** 2 for a, t in zip(v, s)) for i, v in enumerate(whole)}
    assert max(got.values()) > 2**63


def test_ranks_dimensions_and_empty(spark):
    rng = np.random.default_rng(0)
    low = (rng.integers(-50, 50, size=(300, 3)) @ rng.integers(-3, 4, size=(3, 10))).astype(float)  # whole numbers keep the rank
    rows = [(i, [float(a) for a in v], 1, "a", 2) for i, v in enumerate(low)]
    rows += [(1000 + i, [float(i), 2.0], 1, "a", 2) for i in range(4)]  # two dimensions, one without variance
    rows += [(2000, [1.0, 2.0, 3.0], 1, "a", 2), (None, rows[0][1], 1, "a", 2), (0, rows[0][1], 1, "a", 2)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert 2000 not in by  # one row has no variance
    assert all(len(by[i]) == 3 for i in range(1, 300)) and len(by[0]) == 6 and len(by[None]) == 3
    assert [(r.component, r.n, round(r.explained, 9)) for r in by[1001]] == [(1, 4, 1.0)]
    assert all(r.identity_error < 1e-9 for r in got) and by[1][0].n == 302
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def matrices():
    rng = np.random.default_rng(7)
    q = lambda n, d: np.linalg.qr(rng.standard_normal((n, d)))[0]
    near = np.ones(30)
    near[:4], near[4:8], near[8] = 3, 3 * (1 + 1e-9 * np.arange(4)), 2
    dull = rng.standard_normal((200, 20))
    dull[:, 7], dull[:, 11] = dull[:, 2], 0
    yield "random", rng.standard_normal((300, 40))
    yield "graded", rng.standard_normal((300, 40)) * np.logspace(0, -8, 40)
    yield "all equal", q(100, 30)
    yield "clusters", q(100, 30) * near @ q(30, 30)
    yield "dependent columns", dull
    yield "rank five", rng.standard_normal((100, 5)) @ rng.standard_normal((5, 30))
    yield "one column", rng.standard_normal((9, 1))
    yield "two columns", rng.standard_normal((9, 2))
    yield "zero", np.zeros((9, 4))
    t = np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield "pairs of near eigenvalues", np.linalg.cholesky(t).T


@pytest.mark.parametrize("name, m", list(matrices()), ids=[n for n, _ in matrices()])
def test_singular_vectors(name, m):
    r = np.linalg.qr(m, mode="r")
    squares, v = bidiagonal.right_singular(r, 8)
    want = np.linalg.svd(r, compute_uv=False)
    k, top = v.shape[1], max(want[0], 1e-300)
    assert np.abs(np.sqrt(squares) - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-13
    assert np.abs(r.T @ (r @ v) - v * squares[:k]).max() <= 1e-13 * max(squares[0], 1e-300)


def test_dqds_keeps_relative_accuracy():
    """Squares over 60 powers of ten; products of the pivots are the determinant."""
    a, b = np.logspace(0, -30, 16), np.logspace(-1, -31, 15)
    squares = bidiagonal.dqds(a, b)
    assert len(squares) == 16 and (np.diff(squares) < 0).all()
    assert math.isclose(np.log(squares).sum(), 2 * np.log(a).sum(), rel_tol=1e-12)


def test_triangles_of_many_tasks(spark):
    x = vectors(400, 6, 3)
    rows = whitening.usable(frame_of(spark, x).repartition(70), "vec_id", "embedding")
    sums = whitening.exact_sums(rows)
    r = whitening.triangles(rows, sums)[6]
    n, s = sums[6]
    whole = np.floor(x.astype(float) * 1024).astype(np.int64) + 100000
    assert n == 400 and s.tolist() == whole.sum(axis=0).tolist()
    c = (n * whole - whole.sum(axis=0)) / n
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12)
