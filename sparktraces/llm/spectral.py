"""Eigenvectors of a symmetric matrix by spectral divide and conquer on polar decompositions (QDWH).

The orthogonal polar factor of A - sI has an eigenvalue +1 for every eigenvalue of A above the shift s and -1 for every one below.
So (U + I) / 2 projects on the upper invariant subspace. A basis of it and of its complement turns A into two diagonal
blocks, which are split in the same way until they are single components. The polar factor comes from the dynamically weighted
Halley iteration: by QR while the matrix is badly conditioned, by Cholesky afterwards.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
ROUNDS = 14


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    size = min(np.linalg.norm(a), np.abs(a).sum(axis=1).max())
    x, eye = a / size, np.eye(n)
    low = EPS
    for _ in range(ROUNDS):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / (square * square))
        root = np.sqrt(1.0 + d)
        wa = root + np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root)) / 2.0
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100.0:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            step = (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            inner = np.linalg.cholesky(eye + wc * (x.T @ x))
            step = (wa - wb / wc) * np.linalg.solve(inner.T, np.linalg.solve(inner, x.T)).T
        new = wb / wc * x + step
        new = (new + new.T) / 2.0
        low = min(1.0, low * (wa + wb * square) / (1.0 + wc * square))
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1.0 - low) < 10 * EPS and moved <= np.cbrt(5 * EPS):
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, int, float] | None:
    """(basis, size of the upper subspace, what is left between the blocks), or None where the shift does not split."""
    n = len(a)
    shifted = a - shift * np.eye(n)
    if not np.abs(shifted).max() > 0:
        return None
    u = polar(shifted)
    upper = int(round((np.trace(u) + n) / 2.0))
    if not 0 < upper < n:
        return None
    rng = np.random.default_rng(n)
    project = (u + np.eye(n)) / 2.0
    above, _ = np.linalg.qr(project @ rng.standard_normal((n, upper)))
    below, _ = np.linalg.qr(rng.standard_normal((n, n - upper)) - project @ rng.standard_normal((n, n - upper)))
    above, _ = np.linalg.qr(project @ above)
    below, _ = np.linalg.qr(below - project @ below)
    basis, _ = np.linalg.qr(np.hstack((above, below - above @ (above.T @ below))))
    return basis, upper, float(np.linalg.norm(basis[:, :upper].T @ a @ basis[:, upper:]))


def _basis(a: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis in which ``a`` is diagonal up to rounding."""
    n = len(a)
    if n == 1:
        return np.eye(1)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= EPS * scale:
        return np.eye(n)
    allowed = 8 * EPS * np.sqrt(n) * scale
    best: tuple[np.ndarray, int, float] | None = None
    # a shift on an eigenvalue splits nothing cleanly; the others then lie in other gaps
    for shift in (float(np.median(np.diag(a))), middle, *(middle + f * spread for f in (0.37, -0.37, 0.11, -0.11, 0.77, -0.77))):
        found = _halves(a, shift)
        if found is not None and (best is None or found[2] < best[2]):
            best = found
        if best is not None and best[2] <= allowed:
            break
    if best is None:
        return np.eye(n)
    basis, upper, _ = best
    turned = basis.T @ a @ basis
    turned = (turned + turned.T) / 2.0
    blocks = np.zeros((n, n))
    blocks[:upper, :upper] = _basis(turned[:upper, :upper], scale)
    blocks[upper:, upper:] = _basis(turned[upper:, upper:], scale)
    return basis @ blocks


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    a = (a + a.T) / 2.0
    scale = float(np.linalg.norm(a))
    vectors = _basis(a, scale) if scale > 0 else np.eye(len(a))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)
