"""Operator 12 — whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Every entry c becomes the whole number floor(1024 c) + 100000, so that sums are exact. The centred rows are reduced by QR
a block at a time, and the triangles of the tasks again, ``FAN`` at a time, to one triangle R with
RᵀR = the sum of outer products. Householder reflections make R bidiagonal, dqds finds its singular
values, twisted factorisations the vectors (``bidiagonal.py``); with n rows a singular value s gives the eigenvalue
s²/n of the covariance. The covariance itself is never formed, so small eigenvalues keep their digits.

Rows whose vector is null or holds null or non-finite entries are left out. Vectors of each dimension are a fit of their
own. Null ids and repeated rows count like any row. Components without variance (a rank that is too low, a single
row, equal rows) cannot be whitened and are left out, and so are empty vectors; ties among eigenvalues leave the choice of
directions within their space open. A component's largest entry is positive, the first one of several. Empty
tables give no rows. Extra columns are not read. An entry beyond ±2**52 / 1024 is an error, as floor(1024 c) has no digits there.
Only sums, triangles and components come to the driver: their size is that of the dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import EPS, right_singular

SCALE, OFFSET = 1024, 100_000
#: Triangles that one task merges.
FAN = 32
_SPLIT = 1 << 62


@dataclass
class Fit:
    """What one dimension's vectors give."""

    n: int
    sums: np.ndarray            # exact, Python integers
    components: np.ndarray      # unit vectors in columns
    eigenvalues: np.ndarray     # of the columns
    trace: float
    error: float | None = None  # largest entry of the whitened covariance minus the identity

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums).astype(float) / self.n) @ self.components / np.sqrt(self.eigenvalues)


def whole(vectors) -> np.ndarray:
    """Vectors of one dimension as whole numbers."""
    x = np.floor(np.stack(vectors).astype(float) * SCALE)
    if np.abs(x).max(initial=0.0) >= 2.0 ** 52:
        raise ValueError("an entry is too large for whole numbers of 1/1024")
    return x.astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds it, else in Python integers."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums.tolist()), default=0)
    if most < _SPLIT:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(t: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact row sums of squares, as (high, low) digits of base 2**62."""
    if t.dtype != object and len(t):
        most = int(np.abs(t).max(initial=0))
        if most * most * t.shape[1] >= _SPLIT:
            t = t.astype(object)
    squares = [int(s) for s in (t * t).sum(axis=1)]
    return [s // _SPLIT for s in squares], [s % _SPLIT for s in squares]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``v``, ``dim`` of the rows that take part."""
    v = F.col(vector_col)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.size(v).alias("dim")) \
        .where("dim > 0")


def by_dimension(pdf: pd.DataFrame):
    for dim, g in pdf.groupby("dim", sort=True):
        yield int(dim), g, whole(g["v"].to_numpy())


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For every dimension: the number of rows and the sum of every entry."""
    def run(batches):
        for pdf in batches:
            for dim, _, x in by_dimension(pdf):
                total = x.sum(axis=0, dtype=object)
                yield pd.DataFrame({"dim": dim, "pos": range(dim), "n": len(x), "high": [int(s) >> 32 for s in total],
                                    "low": [int(s) & 0xFFFFFFFF for s in total]})

    out: dict = {}
    for r in (rows.mapInPandas(run, "dim int, pos int, n long, high long, low long").groupBy("dim", "pos")
              .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()):
        n, sums = out.setdefault(r.dim, (r.n, np.zeros(r.dim, dtype=object)))
        sums[r.pos] = (r.high << 32) + r.low
    return out


def triangle(rows: list[np.ndarray]) -> np.ndarray:
    """R of the rows, square."""
    m = np.concatenate(rows)
    if len(m) < m.shape[1]:
        m = np.concatenate([m, np.zeros((m.shape[1] - len(m), m.shape[1]))])
    return np.linalg.qr(m, mode="r")


def triangles(rows: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """R of the centred rows of every dimension: one triangle a task, then ``FAN`` of them at a time."""
    schema = "task int, dim int, r array<double>"

    def emit(held, task):
        if held:
            yield pd.DataFrame({"task": task, "dim": list(held), "r": [r.ravel() for r in held.values()]})

    def reduce_rows(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, _, x in by_dimension(pdf):
                n, s = sums[dim]
                block = centred(x, n, s).astype(float) / n
                held[dim] = triangle([held[dim], block] if dim in held else [block])
        yield from emit(held, TaskContext.get().partitionId())

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        task = None
        for pdf in batches:
            for t, dim, r in zip(pdf["task"].tolist(), pdf["dim"].tolist(), pdf["r"]):
                task = t
                r = np.asarray(r).reshape(dim, dim)
                held[dim] = triangle([held[dim], r]) if dim in held else r
        yield from emit(held, task)

    parts = rows.rdd.getNumPartitions()
    now = rows.mapInPandas(reduce_rows, schema)
    while True:
        parts = -(-parts // FAN)
        now = (now.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).repartition(parts, "task")
               .sortWithinPartitions("task", "dim").mapInPandas(_by_task(merge), schema))
        if parts == 1:
            break
    return {r.dim: np.array(r.r).reshape(r.dim, r.dim) for r in now.collect()}


def _by_task(merge):
    """``merge`` of every task number that a partition holds."""
    def run(batches):
        held, at = [], None
        for pdf in batches:
            for task, g in pdf.groupby("task", sort=True):
                if at is not None and task != at:
                    yield from merge(held)
                    held = []
                held.append(g)
                at = task
        if held:
            yield from merge(held)
    return run


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For every dimension: the largest entry of the whitened rows' covariance minus the identity."""
    def run(batches):
        for pdf in batches:
            for dim, _, x in by_dimension(pdf):
                fit = fits[dim]
                if len(fit.eigenvalues):
                    w = fit.whiten(x)
                    values = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                    yield pd.DataFrame({"dim": dim, "pos": range(len(values)), "value": values})

    out = {}
    got = rows.mapInPandas(run, "dim int, pos int, value double").groupBy("dim", "pos").agg(F.sum("value").alias("value")).collect()
    for dim, fit in fits.items():
        values = np.array([r.value for r in sorted((r for r in got if r.dim == dim), key=lambda r: r.pos)])
        k = len(fit.eigenvalues)
        if k:
            mean = values[:k] / fit.n
            out[dim] = float(np.abs(values[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())
    return out


def fit(rows: DataFrame, components: int) -> dict[int, Fit]:
    """Components of the rows of ``usable``, for every dimension."""
    sums = exact_sums(rows)
    fits = {}
    for dim, r in (triangles(rows, sums) if sums else {}).items():
        n, s = sums[dim]
        squares, v = right_singular(r, min(components, dim))
        # a singular value at the level of rounding has no direction
        k = int((squares[:v.shape[1]] > (8 * dim * EPS) ** 2 * squares[0]).sum()) if squares[0] > 0 else 0
        v = v[:, :k]
        sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
        fits[dim] = Fit(n, s, v * sign, squares[:k] / n, float(squares.sum() / n))
    for dim, error in identity_errors(rows, fits).items():
        fits[dim].error = error
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``
    (decimal(38, 0), exact), ``whitened``, ``explained``, ``identity_error``."""
    rows = usable(vectors, id_col, vector_col)
    fits = fit(rows, components)

    def run(batches):
        for pdf in batches:
            for dim, g, x in by_dimension(pdf):
                f = fits[dim]
                k = len(f.eigenvalues)
                if not k:
                    continue
                high, low = deviations(centred(x, f.n, f.sums))
                yield pd.DataFrame({
                    "vec_id": np.repeat(g["vec_id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1), len(x)),
                    "n": f.n, "high": np.repeat(high, k), "low": np.repeat(low, k), "whitened": f.whiten(x).ravel(),
                    "explained": np.tile(f.eigenvalues / f.trace, len(x)), "identity_error": f.error})

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"vec_id {kind}, component int, n long, high long, low long, whitened double, "
                                "explained double, identity_error double")
    base = F.lit(_SPLIT).cast("decimal(19,0)")
    deviation = (F.col("high").cast("decimal(18,0)") * base + F.col("low").cast("decimal(19,0)")).cast("decimal(38,0)")
    return out.select("vec_id", "component", "n", deviation.alias("deviation"), "whitened", "explained", "identity_error")
