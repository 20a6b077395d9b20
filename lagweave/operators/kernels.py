"""NumPy kernels for the parts of the work that relational plans do slowly. All keep the order (d2, j) among ties."""

from __future__ import annotations

import numpy as np

FLT_MAX = 3.4028234663852886e38
MIN_WEIGHT = 1e-6
#: Elements of a distance block; bounds a kernel's memory at about 8 bytes times a few such blocks.
BLOCK_CELLS = 2_000_000


def delay_matrix(x: np.ndarray, E: int, tau: int) -> np.ndarray:
    n = len(x) - (E - 1) * tau
    return np.stack([x[e * tau : e * tau + n] for e in range(E)], axis=1) if n > 0 else np.empty((0, E))


def squared_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differences are squared one by one, not by the dot-product identity, so equal vectors give exactly 0."""
    d2 = np.zeros((len(p), len(q)))
    for e in range(p.shape[1]):
        d = p[:, e, None] - q[None, :, e]
        d2 += d * d
    d2[d2 == 0] = FLT_MAX
    return d2


def smallest(d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, in the order (value, column)."""
    n = d2.shape[1]
    if k >= n:
        return np.argsort(d2, axis=1, kind="stable")
    kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d2), k), dtype=np.int64)
    at_most = d2 <= kth
    plain = at_most.sum(axis=1) == k
    if plain.any():
        cols = np.nonzero(at_most[plain])[1].reshape(-1, k)
        order = np.argsort(np.take_along_axis(d2[plain], cols, 1), axis=1, kind="stable")
        out[plain] = np.take_along_axis(cols, order, 1)
    for r in np.nonzero(~plain)[0]:
        cols = np.nonzero(at_most[r])[0]
        out[r] = cols[np.argsort(d2[r, cols], kind="stable")[:k]]
    return out


def neighbours(p: np.ndarray, q: np.ndarray, k: int):
    """(distances, library rows) of the k nearest, in blocks of bounded size."""
    step = max(1, BLOCK_CELLS // max(1, len(q)))
    dist, rows = [], []
    for a in range(0, len(p), step):
        d2 = squared_distances(p[a : a + step], q)
        j = smallest(d2, k)
        dist.append(np.sqrt(np.take_along_axis(d2, j, 1)))
        rows.append(j)
    return (np.concatenate(dist), np.concatenate(rows)) if dist else (np.empty((0, k)), np.empty((0, k), dtype=np.int64))


def weights(dist: np.ndarray) -> np.ndarray:
    least = dist.min(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(least > 0, np.exp(-dist / least), np.where(dist > 0, 0.0, 1.0))
    w = np.maximum(w, MIN_WEIGHT)
    return w / w.sum(axis=1, keepdims=True)


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """NaN where either has no variance."""
    n = min(len(x), len(y))
    x, y = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
    scale = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / scale) if scale > 0 else float("nan")


def standardised(x: np.ndarray) -> np.ndarray:
    """x less its mean, of length 1; NaN where it has no variance. The dot product of two such is their correlation."""
    x = x - x.mean()
    scale = np.sqrt((x * x).sum())
    return x / scale if scale > 0 else np.full(len(x), np.nan)


def forecast(w: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted sums of y at the neighbours' places, added up one neighbour after the other, so no n x k table is made."""
    out = np.zeros(len(w))
    for k in range(w.shape[1]):
        out += w[:, k] * y[at[:, k]]
    return out


def solve_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares for a stack of systems by QR; those of deficient rank get the solution of least norm."""
    q, r = np.linalg.qr(a)
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    good = size.min(axis=1) > size.max(axis=1) * a.shape[1] * np.finfo(float).eps
    out = np.empty((len(a), a.shape[2]))
    if good.any():
        rhs = np.einsum("bij,bi->bj", q[good], b[good])
        out[good] = np.linalg.solve(r[good], rhs[:, :, None])[:, :, 0]
    for k in np.flatnonzero(~good):
        out[k] = np.linalg.lstsq(a[k], b[k], rcond=None)[0]
    return out


def local_linear(lib: np.ndarray, target: np.ndarray, vectors: np.ndarray, E: int, tau: int, Tp: int, theta: float) -> np.ndarray:
    """One weighted least-squares fit for each vector, in batches of bounded size. NaN where all library rows are
    duplicates of it."""
    span = (E - 1) * tau
    n_lib = len(lib) - span - Tp
    rows = delay_matrix(lib, E, tau)[:n_lib]
    y = target[span + Tp : span + Tp + n_lib]
    design = np.concatenate([np.ones((n_lib, 1)), rows], axis=1)
    out = np.full(len(vectors), np.nan)
    step = max(1, BLOCK_CELLS // max(1, n_lib * (E + 1)))
    for lo in range(0, len(vectors), step):
        x = vectors[lo : lo + step]
        d2 = np.zeros((len(x), n_lib))
        for e in range(E):
            d2 += (x[:, e, None] - rows[None, :, e]) ** 2
        real = d2 > 0
        d = np.sqrt(d2)
        mean = d.sum(axis=1) / n_lib
        fits = mean > 0
        w = np.exp(-theta * d[fits] / mean[fits, None])
        if theta > 0:
            w[~real[fits]] = 0.0
        b = solve_rows(design[None] * w[:, :, None], y[None] * w)
        out[lo : lo + step][fits] = b[:, 0] + (b[:, 1:] * x[fits]).sum(axis=1)
    return out
