"""Singular values and right singular vectors of a small matrix by a bidiagonal qd solver.

Householder reflections make the matrix bidiagonal; dqds iterations on the squared entries find the singular values to high
relative accuracy, small ones too; the vectors come from twisted factorisations of L D L' representations of B'B, shifted close
to a cluster wherever values lie so near each other that their vectors would not come out orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
GAP = 1e-3  # values closer than this, relative to their size, are a cluster
TINY = np.finfo(np.float64).tiny


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r`` (rows x d), falling, and the right singular vectors as columns."""
    d = r.shape[1]
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(r).max() if r.size else 0.0
    if not scale:
        return np.zeros(d), np.eye(d)
    square = np.zeros((d, d))
    top = np.linalg.qr(r / scale, mode="r") if len(r) > d else r / scale
    square[: len(top)] = top
    diagonal, upper, v = bidiagonal(square)
    values, vectors = _of_bidiagonal(diagonal, upper)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, v @ vectors[:, order]


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and V, where a = U B V'; all entries of B made not negative."""
    a, d = a.copy(), a.shape[1]
    v = np.eye(d)
    for k in range(d):
        _reflect(a[k:, k:])
        if k + 2 <= d - 1:
            w = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    diagonal, upper = np.diagonal(a).copy(), np.diagonal(a, 1).copy()
    for k in range(d - 1):  # signs move into U and V
        if upper[k] * np.sign(diagonal[k] or 1) < 0:
            v[:, k + 1] *= -1
            diagonal[k + 1] *= -1
    return np.abs(diagonal), np.abs(upper), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection moves ``x`` onto its first axis."""
    size = np.sqrt(x @ x)
    if not size:
        return np.zeros_like(x)
    w = x.copy()
    w[0] += size if x[0] >= 0 else -size
    return w / np.sqrt(w @ w)


def _reflect(a: np.ndarray) -> None:
    w = _reflector(a[:, 0])
    a -= 2 * np.outer(w, w @ a)


def _of_bidiagonal(diagonal: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of a bidiagonal matrix, block by block where it falls apart."""
    d = len(diagonal)
    size = max(diagonal.max(), upper.max() if d > 1 else 0.0)
    values, vectors = np.zeros(d), np.zeros((d, d))
    cuts = np.flatnonzero(upper <= EPS * size * 1e-2) + 1 if d > 1 else np.zeros(0, int)
    for first, last in zip(np.r_[0, cuts], np.r_[cuts, d]):
        a, b = np.maximum(diagonal[first:last], EPS * size * 1e-6), upper[first : last - 1]
        q, e = a * a, b * b
        lam = np.sort(dqds(q, e))
        at = slice(first, last)
        values[at] = np.sqrt(lam)
        vectors[at, at] = _vectors(q, b / a[:-1], lam)
    return values, vectors


def dqds(q: np.ndarray, e: np.ndarray, turns: int = 60) -> np.ndarray:
    """Eigenvalues of B'B, where B has squared diagonal ``q`` and squared upper diagonal ``e``: differential qd with shifts.

    A shift that would make a pivot negative is tried again smaller, at last as zero, which never fails.
    """
    q, e, moved, out = q.astype(float).tolist(), e.astype(float).tolist(), 0.0, []
    left = turns * len(q) + 100
    while q:
        n = len(q)
        if n == 1:
            out.append(max(q[0] + moved, 0.0))
            break
        if e[-1] <= EPS * EPS * (moved + q[-1]) or (e[-1] <= EPS * EPS * q[-1]):
            out.append(max(q.pop() + moved, 0.0))
            e.pop()
            continue
        split = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1]))), None)
        if split is not None and split < n - 2:
            head = dqds(np.array(q[: split + 1]), np.array(e[:split]), turns)
            out.extend((head + moved).tolist())
            q, e = q[split + 1 :], e[split + 1 :]
            continue
        left -= 1
        if left < 0:  # no convergence: count signs instead
            pivots, lower = np.array(q), np.sqrt(np.array(e) / np.array(q))
            out.extend(max(_bisect(pivots, lower, k, max(q), max(q)) + moved, 0.0) for k in range(n))
            break
        shift = _shift(q, e)
        while True:
            after = _dqds_step(q, e, shift)
            if after is not None:
                break
            shift = shift / 4 if shift > EPS * (moved + q[-1]) else 0.0
        q, e = after
        moved += shift
    return np.array(out)


def _shift(q: list[float], e: list[float]) -> float:
    """A little less than the smaller eigenvalue of the last two rows."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half, middle = (a - c) / 2, (a + c) / 2
    low = middle - np.hypot(half, np.sqrt(b))
    return max(0.0, min(low, q[-1]) * (1 - 1e-2 * min(1.0, e[-1] / (q[-1] + TINY)) - 4 * EPS))


def _dqds_step(q: list[float], e: list[float], shift: float):
    """One transform; None where a pivot turns negative under a shift above zero."""
    out_q, out_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        x = d + e[k]
        if x <= 0:
            if shift > 0:
                return None
            x = TINY
        ratio = q[k + 1] / x
        out_q.append(x)
        out_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e


def _vectors(pivots: np.ndarray, lower: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) of L D L' for its eigenvalues ``lam``, rising; L is unit with ``lower`` below the diagonal."""
    out = np.zeros((len(pivots), len(lam)))
    for k in _groups(lam):
        _cluster(pivots, lower, lam[k], out, k, 0)
    return out


def _groups(lam: np.ndarray) -> list[np.ndarray]:
    """Indices of values next to each other by less than GAP of their size."""
    size = np.maximum(np.abs(lam[1:]), np.abs(lam[:-1]))
    return np.split(np.arange(len(lam)), np.flatnonzero(np.diff(lam) > GAP * size) + 1)


def _cluster(pivots, lower, lam, out, where, depth) -> None:
    """Vectors of one group of values: directly if alone, else after a shift next to the group."""
    if len(lam) == 1:
        out[:, where[0]] = _twisted(pivots, lower, lam[0])
        return
    spread = lam[-1] - lam[0]
    shift = lam[0] - max(spread, 4 * EPS * abs(lam[0]), TINY)
    moved, factors = _shifted(pivots, lower, shift)
    near = np.array([_bisect(moved, factors, k, lam[j] - shift, 8 * EPS * abs(lam[j]) + spread * 1e-6) for j, k in enumerate(
        _rank(moved, factors, lam - shift))])
    parts = _groups(near)
    if len(parts) > 1 and depth < 12:
        for part in parts:
            _cluster(moved, factors, near[part], out, where[part], depth + 1)
        return
    z = np.column_stack([_twisted(moved, factors, x) for x in near])
    out[:, where] = _told_apart(z, moved, factors)


def _rank(pivots, lower, lam) -> range:
    """Places of a group's values among all values of the representation."""
    first = _below(pivots, lower, lam[0] - 0.5 * max(abs(lam[0]), TINY))
    return range(first, first + len(lam))


def _shifted(pivots, lower, shift) -> tuple[np.ndarray, np.ndarray]:
    """L D L' - shift I as another L D L': the stationary qd transform."""
    d, f, s = pivots.copy(), lower.copy(), -shift
    for k in range(len(lower)):
        x = pivots[k] + s
        d[k] = x if x else -TINY
        f[k] = pivots[k] * lower[k] / d[k]
        s = f[k] * lower[k] * s - shift if np.isfinite(f[k]) else -shift
    d[-1] = pivots[-1] + s
    return d, f


def _below(pivots, lower, x) -> int:
    """How many eigenvalues of L D L' lie below ``x``."""
    n, s = 0, -x
    for k in range(len(pivots)):
        p = pivots[k] + s
        if p < 0:
            n += 1
        if k < len(lower):
            p = p if p else -TINY
            s = s * (pivots[k] * lower[k] * lower[k] / p) - x
            if not np.isfinite(s):
                s = -x
    return n


def _bisect(pivots, lower, k, near, step) -> float:
    """The eigenvalue with ``k`` others below it, to full relative accuracy."""
    step = max(step, TINY)
    lo, hi = near - step, near + step
    while _below(pivots, lower, lo) > k:
        step *= 2
        lo -= step
    while _below(pivots, lower, hi) <= k:
        step *= 2
        hi += step
    for _ in range(200):
        middle = (lo + hi) / 2
        if hi - lo <= 2 * EPS * max(abs(lo), abs(hi)) or middle in (lo, hi):
            break
        if _below(pivots, lower, middle) <= k:
            lo = middle
        else:
            hi = middle
    return (lo + hi) / 2


def _twisted(pivots, lower, x) -> np.ndarray:
    """The unit vector of eigenvalue ``x``: factors from the top and from the bottom, joined where they fit best."""
    n = len(pivots)
    if n == 1:
        return np.ones(1)
    plus, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -x
    for k in range(n - 1):
        p = pivots[k] + s[k]
        p = p if p else TINY
        plus[k] = pivots[k] * lower[k] / p
        s[k + 1] = plus[k] * lower[k] * s[k] - x
    minus, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = pivots[-1] - x
    for k in range(n - 2, -1, -1):
        t = pivots[k] * lower[k] * lower[k] + p[k + 1]
        t = t if t else TINY
        minus[k] = pivots[k] * lower[k] / t
        p[k] = p[k + 1] * pivots[k] / t - x
    gamma = np.abs(s + p + x)
    r = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -minus[k] * z[k]
    return z / np.sqrt(z @ z)


def _told_apart(z, pivots, lower) -> np.ndarray:
    """An orthonormal basis of a group whose values agree to the last digits, turned to the matrix's own axes within it."""
    rng = np.random.default_rng(3)
    basis, _ = np.linalg.qr(z)
    if np.linalg.cond(z) > 1e6:
        basis, _ = np.linalg.qr(z + 1e-9 * rng.standard_normal(z.shape))
    moved = np.zeros_like(basis)
    step = basis.copy()
    step[:-1] += lower[:, None] * basis[1:]
    step *= pivots[:, None]
    moved[:] = step
    moved[1:] += lower[:, None] * step[:-1]
    _, turn = np.linalg.eigh(basis.T @ moved)
    return basis @ turn
