"""Spectral divide and conquer of a small symmetric matrix by polar decompositions.

The polar factor of a shifted matrix has eigenvalue 1 above the shift and -1 below, so half of
(factor + identity) projects on what lies above. Its range and the rest split the matrix in
two, and so on. The factor comes from the dynamically weighted Halley iteration in its QR form,
which needs no more than some six steps however ill-conditioned the shifted matrix is.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MOST_STEPS = 30


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix that is not singular to working
    precision; otherwise what the iteration comes to, which `split` rejects."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # A lower bound of the least singular value; too small a bound costs a step or two.
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0) if np.isfinite(low) else EPS
    eye = np.eye(n)
    for _ in range(MOST_STEPS):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / l2 ** 2)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        step = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        moved = np.linalg.norm(step - x)
        x = step
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        if moved <= np.cbrt(EPS) * 1e-2 and abs(1 - low) <= 10 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of what lies above and below the shift; None if one is empty or the
    shift is too near an eigenvalue."""
    n = len(a)
    factor = polar_factor(a - shift * np.eye(n))
    factor = (factor + factor.T) / 2
    above = (factor + np.eye(n)) / 2
    rank = int(round(np.trace(above)))
    if not 0 < rank < n or np.linalg.norm(factor @ factor - np.eye(n)) > 1e-8 * n:
        return None
    # The columns of largest norm, then one more step of subspace iteration.
    picked = np.argsort(-np.linalg.norm(above, axis=0), kind="stable")
    q, _ = np.linalg.qr(above[:, picked])
    q, _ = np.linalg.qr(np.hstack([above @ q[:, :rank], q[:, rank:]]), mode="complete")
    low, high = q[:, rank:], q[:, :rank]
    if np.linalg.norm(low.T @ a @ high) > 1e-10 * np.linalg.norm(a):
        return None
    return high, low


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns. Rows that no shift divides are
    one eigenvalue to working precision; any basis of theirs will do."""
    scale = np.linalg.norm(a)
    vectors = _divide((a + a.T) / 2, scale)
    vectors = _polish(a, vectors, scale)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divide(a: np.ndarray, scale: float) -> np.ndarray:
    n = len(a)
    mean = np.trace(a) / n if n else 0.0
    if n <= 1 or np.linalg.norm(a - mean * np.eye(n)) <= 4 * EPS * max(scale, np.finfo(float).tiny):
        return np.eye(n)
    diagonal = np.sort(np.diag(a))
    bounds = mean + np.array([-1, 1]) * np.linalg.norm(a - mean * np.eye(n))
    tries = [np.median(diagonal), mean, *(diagonal[1:] + diagonal[:-1]) / 2,
             *np.linspace(*bounds, 34)[1:-1]]
    for shift in tries:
        parts = split(a, float(shift))
        if parts is not None:
            return np.hstack([p @ _divide(_symmetric(p.T @ a @ p), scale) for p in parts])
    return np.eye(n)


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _polish(a: np.ndarray, v: np.ndarray, scale: float) -> np.ndarray:
    """Two rounds of first-order correction where eigenvalues are apart."""
    for _ in range(2):
        r = np.eye(len(a)) - v.T @ v
        s = v.T @ a @ v
        d = np.diag(s) / (1 - np.diag(r))
        gap = d[None, :] - d[:, None]
        apart = np.abs(gap) > 1e-6 * max(scale, np.finfo(float).tiny)
        fix = np.where(apart, (s + r * d[None, :]) / np.where(apart, gap, 1.0), r / 2)
        np.fill_diagonal(fix, np.diag(r) / 2)
        v = v + v @ fix
    return v
