"""Singular values and right singular vectors of a small triangular matrix: Householder bidiagonalisation, the
differential quotient-difference algorithm with shifts (dqds), and twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this, relative to their size, share a subspace and are told apart within it.
CLUSTER = 1e-4


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a`` (diagonal), ``b`` (above it) and V with R = U B Vᵀ for a square R."""
    m = np.array(r, dtype=float)
    d = len(m)
    v = np.eye(d)
    for k in range(d):
        _reflect(m[k:, k:])
        if k < d - 2:
            w = _reflect(m[k:, k + 1:].T)
            if w is not None:
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflect(m: np.ndarray) -> np.ndarray | None:
    """Apply to ``m`` the reflection that clears its first column below the top; its unit vector."""
    w = m[:, 0].copy()
    scale = np.abs(w).max(initial=0.0)
    if len(w) < 2 or not np.any(w[1:]):
        return None
    w /= scale
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    w /= np.linalg.norm(w)
    m -= 2 * np.outer(w, w @ m)
    m[1:, 0] = 0.0
    return w


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal matrix (``a``, ``b``), falling.

    Each transform takes a shift off all squares; it is refused where a pivot turns negative, so no shift exceeds
    the smallest square and the values keep high relative accuracy.
    """
    found: list[float] = []
    work = [((np.asarray(a, dtype=float) ** 2).tolist(), (np.asarray(b, dtype=float) ** 2).tolist(), 0.0)]
    while work:
        q, e, taken = work.pop()
        refused = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(taken + q[0])
                break
            small = EPS * EPS
            if e[-1] <= small * (taken + q[-1]):  # the last value has settled
                found.append(taken + q.pop())
                e.pop()
                refused = 0
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= small * (taken + q[i])), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], taken))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            shift = 0.0 if refused > 2 else _last_square(q, e) * (1.0 - EPS * 4) * 0.25 ** refused
            new = _transform(q, e, shift)
            if new is None:
                refused += 1
                continue
            q, e = new
            taken += shift
            refused = 0
    return np.sort(np.array(found))[::-1]


def _last_square(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows and columns of BᵀB, never more than the last pivot."""
    p, s, r = q[-2], q[-1], e[-1]
    # BᵀB ends in [[p + e', sqrt(p r)], [sqrt(p r), s + r]]; e' is left out, which lowers the value
    half, det = (p + r + s) / 2, p * s
    root = max(half * half - det, 0.0) ** 0.5
    return det / (half + root) if half + root > 0 else 0.0


def _transform(q: list[float], e: list[float], shift: float):
    """One step of dqds; None where the shift is too large."""
    d = q[0] - shift
    if d < 0:
        return None
    qq, ee = [], []
    for k in range(len(q) - 1):
        top = d + e[k]
        if top <= 0.0:
            if e[k] == 0.0 and shift == 0.0:  # a zero square that stands apart
                qq.append(0.0)
                ee.append(0.0)
                d = q[k + 1]
                continue
            return None
        t = q[k + 1] / top
        qq.append(top)
        ee.append(e[k] * t)
        d = d * t - shift
        if d < 0:
            return None
    return qq + [d], ee


class Twisted:
    """N D Nᵀ = BᵀB - λ, from both ends to the row where the pivot is smallest."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        off, low = (a[:-1] * b).tolist(), (b * b).tolist()
        top = (a * a).tolist()
        tiny = EPS * EPS * max(value, max(top, default=0.0), 1e-300)
        self.down, self.up = [0.0] * (n - 1), [0.0] * (n - 1)
        s, p = [0.0] * n, [0.0] * n
        pivot_down, pivot_up = [0.0] * n, [0.0] * n
        s[0] = -value
        for i in range(n - 1):
            x = s[i] + top[i]
            x = x if abs(x) > tiny else (tiny if x >= 0 else -tiny)
            pivot_down[i] = x
            self.down[i] = off[i] / x
            s[i + 1] = s[i] * (low[i] / x) - value
        p[n - 1] = top[n - 1] - value
        for i in range(n - 2, -1, -1):
            x = low[i] + p[i + 1]
            x = x if abs(x) > tiny else (tiny if x >= 0 else -tiny)
            pivot_up[i + 1] = x
            self.up[i] = off[i] / x
            p[i] = p[i + 1] * (top[i] / x) - value
        gamma = [s[i] + p[i] + value for i in range(n)]
        self.at = min(range(n), key=lambda i: abs(gamma[i]))
        g = gamma[self.at]
        self.pivots = pivot_down[:self.at] + [g if abs(g) > tiny else tiny] + pivot_up[self.at + 1:]

    def vector(self) -> np.ndarray:
        """The eigenvector of the eigenvalue nearest to λ."""
        start = np.zeros(len(self.pivots))
        start[self.at] = 1.0
        return self._back(start)

    def solve(self, z: np.ndarray) -> np.ndarray:
        """x of (BᵀB - λ) x = z, up to what a nearly singular matrix allows."""
        y, r = z.astype(float).copy(), self.at
        for i in range(1, r):
            y[i] -= self.down[i - 1] * y[i - 1]
        for i in range(len(y) - 2, r, -1):
            y[i] -= self.up[i] * y[i + 1]
        if r > 0:
            y[r] -= self.down[r - 1] * y[r - 1]
        if r < len(y) - 1:
            y[r] -= self.up[r] * y[r + 1]
        x = y / np.array(self.pivots)
        return self._back(x)

    def _back(self, x: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            x[i] -= self.down[i] * x[i + 1]
        for i in range(self.at, len(x) - 1):
            x[i + 1] -= self.up[i] * x[i]
        return x / np.abs(x).max()


def eigenvectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray, count: int) -> np.ndarray:
    """Unit eigenvectors of BᵀB for its ``count`` largest eigenvalues, in columns.

    A well separated one is the vector of its twisted factorisation. Eigenvalues of a cluster span a subspace
    that inverse iteration with one twisted factorisation finds; the small problem within it parts them.
    """
    t = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t[1:, 1:] += np.diag(b * b)
    out = np.zeros((len(a), count))
    at = 0
    while at < count:
        end = at + 1
        while end < len(squares) and squares[end - 1] - squares[end] <= CLUSTER * squares[end - 1]:
            end += 1
        if end == at + 1:
            v = Twisted(a, b, float(squares[at])).vector()
            out[:, at] = v / np.linalg.norm(v)
        else:
            factor = Twisted(a, b, float(squares[at] * (1 + 4 * EPS)))
            z = np.random.default_rng(at).standard_normal((len(a), end - at))
            for _ in range(6):
                z = np.linalg.qr(np.stack([factor.solve(c) for c in z.T], axis=1))[0]
            _, inner = np.linalg.eigh(z.T @ t @ z)
            z = z @ inner[:, ::-1]
            out[:, at:end] = z[:, :max(0, count - at)] if end > count else z
        at = end
    # what separation of a few last digits leaves between neighbours is taken out
    q, r = np.linalg.qr(out)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of the square matrix R, falling, and the unit right singular vectors of
    the ``count`` largest of them, in columns."""
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(r)), np.eye(len(r))[:, :count]
    a, b, v = bidiagonalise(r / scale)
    squares = dqds(a, b)
    return squares * scale * scale, v @ eigenvectors(a, b, squares, min(count, len(a)))
