"""Dense kernels on numpy arrays: batched non-negative least squares and masked Gram matrices."""

from __future__ import annotations

import numpy as np

SWEEPS, TINY = 100, 1e-15


def gram(w: np.ndarray) -> np.ndarray:
    """w'w for w [n][k], with 1e-15 on the diagonal."""
    return w.T @ w + TINY * np.eye(w.shape[1])


def nnls(a: np.ndarray, b: np.ndarray, l1: float | np.ndarray = 0.0, l2: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent for each row of b [n][k]; a [k][k], or [n][k][k] with a matrix per row.

    A step is b_i / a_ii, less l1 (a number, or per row and factor), plus l2 * x_i. A row stops by itself when the
    relative change of a sweep is at most 1e-8 per factor; a coordinate that is clamped to 0 counts as a change of 1 so far.
    """
    n, k = b.shape
    b, x = b.copy(), np.zeros((n, k)) if start is None else start.copy()
    each = a.ndim == 3
    l1 = np.broadcast_to(np.asarray(l1, float), (n, k))
    live = np.arange(n)
    for _ in range(SWEEPS):
        if not len(live):
            break
        xs, bs, change = x[live], b[live], np.zeros(len(live))
        mats = a[live] if each else a
        for i in range(k):
            row = mats[:, i, :] if each else mats[i]
            step = bs[:, i] / (row[:, i] if each else row[i]) - l1[live, i] + l2 * xs[:, i]
            clamp = -step > xs[:, i]
            move = np.where(clamp, -xs[:, i], step)
            bs -= row * move[:, None]
            xs[:, i] = np.where(clamp, 0.0, xs[:, i] + move)
            hit = clamp & (move != 0)
            change = np.where(hit, 1.0, change + np.where(clamp, 0.0, np.abs(move / (xs[:, i] + TINY))))
        x[live], b[live] = xs, bs
        live = live[change / k > 1e-8]
    return x


def cross(values: np.ndarray, index: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per segment the sum of value * w[index]; segments of the given sizes follow each other."""
    out = np.zeros((len(sizes), w.shape[1]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(values), 1 << 18):
        part = slice(at, at + (1 << 18))
        product = values[part, None] * w[index[part]]
        lo, hi = owner[part][0], owner[part][-1] + 1
        begin = np.searchsorted(owner[part], np.arange(lo, hi))
        out[lo:hi] += np.add.reduceat(product, begin, axis=0) * (np.diff(np.append(begin, len(product))) > 0)[:, None]
    return out


def pairs(w: np.ndarray) -> np.ndarray:
    """The products of each two entries of a row, [n][k * k]."""
    return (w[:, :, None] * w[:, None, :]).reshape(len(w), -1)


def masked_gram(w: np.ndarray, whole: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The Gram matrix less that of the masked rows, for each column of mask [n][columns]; both carry 1e-15, which cancels."""
    k = w.shape[1]
    return whole - TINY * np.eye(k) - (mask.T.astype(float) @ pairs(w)).reshape(-1, k, k) + TINY * np.eye(k)
