"""Eigenpairs of a symmetric matrix: Householder tridiagonalisation, then divide and conquer.

A tridiagonal matrix is torn in two by a rank-one change; the halves are solved
alike, and the roots of the secular equation join them. A root is found by its
distance from the nearer pole, bisected down to the last bit. Eigenvectors come
from a rank-one vector recomputed from the roots, so that they are orthogonal
whatever the gaps. Pairs that the change doesn't move, or that are equal, are
deflated first.

Defined results: an empty matrix has no pairs; equal eigenvalues get any
orthonormal basis of their space; a matrix with a non-finite entry is an error.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q @ T @ q.T."""
    a = np.array(a, dtype=float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = float(np.abs(x).max())
        if size == 0 or not np.any(x[1:]):
            continue
        x /= size
        x[0] += np.copysign(np.sqrt(x @ x), x[0])
        x /= np.sqrt(x @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = 2 * (p - (x @ p) * x)
        rest -= np.outer(x, w) + np.outer(w, x)
        column = a[k + 1 :, k]
        column -= 2 * (x @ column) * x
        a[k, k + 1 :] = column
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(origin, shift): the roots d[origin] + shift of 1 + rho * sum(z^2 / (d - x)) for rising d and rho > 0."""
    k, square = len(d), rho * z**2
    gap = np.append(np.diff(d), square.sum())
    at = np.arange(k)
    f = lambda origin, shift: 1 + (square / ((d[None, :] - d[origin][:, None]) - shift[:, None])).sum(axis=1)
    origin = np.where((at == k - 1) | (f(at, gap / 2) > 0), at, np.minimum(at + 1, k - 1))
    left = origin == at
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(at == k - 1, gap, gap / 2), 0.0)
    for _ in range(1200):  # shifts near a pole may be tiny: halve in place first, then the exponent
        both = np.where(left, high, -low)
        near = np.where(left, low, -high)
        wide = both > 4 * near
        step = np.where(near > 0, np.sqrt(near) * np.sqrt(both), both * 2.0**-40)
        middle = np.where(wide, step, (near + both) / 2)
        shift = np.where(left, middle, -middle)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            above = f(origin, shift) > 0
        moved_high, moved_low = above & (shift != high) & (shift != low), ~above & (shift != low) & (shift != high)
        high, low = np.where(moved_high, shift, high), np.where(moved_low, shift, low)
        if not (moved_high | moved_low).any():
            break
    # The end nearer to the pole may be the pole itself.
    return origin, np.where(left, high, low)


def merged(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of q @ (diag(d) + rho * z z^T) @ q.T for rho > 0."""
    order = np.argsort(d, kind="stable")
    d, q, z = d[order], q[:, order].copy(), z[order].copy()
    size = float(np.sqrt(z @ z))
    if size == 0:
        return d, q
    z /= size
    rho *= size**2
    small = 8 * _EPS * max(float(np.abs(d).max()), rho)
    live, last = [], -1
    for i in range(len(d)):
        if rho * abs(z[i]) <= small:
            continue
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= small:  # as good as equal: turn the pair so that one stands still
                z[i], z[last] = r, 0.0
                q[:, last], q[:, i] = c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]
                d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
                live.pop()
        live.append(i)
        last = i
    live = np.array(live, dtype=np.int64)
    if not len(live):
        return d, q
    dl, zl = d[live], z[live]
    origin, shift = secular_roots(dl, zl, rho)
    apart = (dl[:, None] - dl[origin][None, :]) - shift[None, :]  # d_i - root_j
    k = len(live)
    poles = dl[:, None] - dl[None, :]
    # z_i^2 = prod_j (root_j - d_i) / prod_{j != i} (d_j - d_i) / rho, each pole against the root beside it.
    pairs = np.empty((k, k))
    for i in range(k):
        others = np.concatenate([poles[i, :i], poles[i, i + 1 :]])
        pairs[i, : k - 1] = apart[i, : k - 1] / others
        pairs[i, k - 1] = -apart[i, k - 1] / rho
    exact = np.sqrt(np.abs(pairs.prod(axis=1))) * np.where(zl < 0, -1.0, 1.0)
    vectors = exact[:, None] / apart
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    values, out = d.copy(), q.copy()
    values[live] = dl[origin] + shift
    out[:, live] = q[:, live] @ vectors
    return values, out


def of_tridiagonal(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    if n <= 1:
        return d.copy(), np.eye(n)
    m = n // 2
    tear = e[m - 1]
    if tear == 0:
        parts = of_tridiagonal(d[:m], e[: m - 1]), of_tridiagonal(d[m:], e[m:])
    else:
        top, low = d[:m].copy(), d[m:].copy()
        top[-1] -= abs(tear)
        low[0] -= abs(tear)
        parts = of_tridiagonal(top, e[: m - 1]), of_tridiagonal(low, e[m:])
    (w1, q1), (w2, q2) = parts
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    w = np.concatenate([w1, w2])
    if tear == 0:
        return w, q
    z = np.concatenate([q1[-1], np.sign(tear) * q2[0]])
    return merged(w, q, z, abs(tear))


def symmetric(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) by falling value; vectors are columns."""
    a = np.asarray(a, dtype=float)
    if not np.isfinite(a).all():
        raise ValueError("a matrix with non-finite entries has no eigenpairs")
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(a).max()) or 1.0
    d, e, q = tridiagonal(a / scale)
    w, v = of_tridiagonal(d, e)
    order = np.argsort(-w, kind="stable")
    return w[order] * scale, (q @ v)[:, order]
