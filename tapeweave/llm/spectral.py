"""Eigenvectors of symmetric matrices by spectral divide and conquer.

The polar factor of A - shift is the sign of its eigenvalues, so (U + 1) / 2 projects on the
eigenvectors above the shift. Both invariant subspaces get orthonormal bases, A is written in
them, and each half is divided again until single directions are left. Polar factors come
from dynamically weighted Halley steps on QR factors (QDWH), which converge in about six steps
for any condition.

N. Higham and Y. Nakatsukasa, "Stable and efficient spectral divide and conquer algorithms for
the symmetric eigenvalue decomposition and the SVD", SIAM J. Sci. Comput. 35 (2013).
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
MOST_STEPS = 30
TRIES = 12


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvalues become their signs."""
    n = len(a)
    # Frobenius bounds the 2-norm from above; below, no singular value under rounding is told from zero.
    x = a / np.linalg.norm(a)
    low = EPS
    for _ in range(MOST_STEPS):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        # x (alpha + beta x'x) / (1 + gamma x'x), without forming x'x.
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(n)]))
        after = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (alpha + beta * low**2) / (1 + gamma * low**2))
        moved = np.linalg.norm(after - x)
        x = after
        if low > 1 - 1e-8 and moved < np.cbrt(EPS):
            break
    return x


def _subspaces(projector: np.ndarray, rank: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of what a projector keeps and of the rest."""
    n = len(projector)
    kept = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
    kept = np.linalg.qr(projector @ kept)[0]
    rest = rng.standard_normal((n, n - rank))
    for _ in range(2):
        rest -= projector @ rest
        rest -= kept @ (kept.T @ rest)
        rest = np.linalg.qr(rest)[0]
    return kept, rest


def _shifts(a: np.ndarray) -> list[float]:
    """Where to divide: the median of the diagonal, its mean (which always lies between eigenvalues), and places between."""
    diagonal = np.diag(a)
    middle, mean, spread = float(np.median(diagonal)), float(diagonal.mean()), float(np.linalg.norm(a - diagonal.mean() * np.eye(len(a))))
    near = [mean + spread * (k + 1) / (2 * TRIES) * (-1) ** k for k in range(TRIES)]
    return [middle, mean, *near]


def divide(a: np.ndarray, floor: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of a, upper eigenvalues first; None if a is a multiple of 1 but for rounding."""
    n = len(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= floor:
        return None
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= floor:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        upper, lower = _subspaces(projector, rank, rng)
        left = float(np.linalg.norm(lower.T @ a @ upper))
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= floor:
            break
    if best is None:
        return None
    return best[1], best[2]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    The sign of a vector makes its entry of largest size positive (the first such entry).
    Equal eigenvalues have any orthonormal basis of their space. The same matrix gives the
    same result.
    """
    a = np.asarray(matrix, dtype=np.float64)
    a = (a + a.T) / 2
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    floor = 8 * EPS * n * max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(n)
    parts, waiting = [], [(a, np.eye(n))]
    while waiting:
        block, basis = waiting.pop()
        halves = divide(block, floor, rng) if len(block) > 1 else None
        if halves is None:
            parts.append(basis)
            continue
        for half in halves:
            inner = half.T @ block @ half
            waiting.append(((inner + inner.T) / 2, basis @ half))
    vectors = np.linalg.qr(np.hstack(parts))[0]
    vectors = refined(a, vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    heads = vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]
    return values, vectors * np.where(heads < 0, -1.0, 1.0)


def refined(a: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One step of first-order correction: what rounding of the divisions has left between two vectors goes."""
    inner = vectors.T @ a @ vectors
    values = np.diag(inner)
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > np.sqrt(EPS) * max(float(np.abs(values).max()), np.finfo(np.float64).tiny)
    turn = np.divide(inner, gaps, out=np.zeros_like(inner), where=apart)
    np.fill_diagonal(turn, 0.0)
    return np.linalg.qr(vectors @ (np.eye(len(a)) + turn))[0]
