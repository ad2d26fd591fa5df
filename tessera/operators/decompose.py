"""Decompositions and solves. What the driver works on is the square of a narrow matrix's columns, never its rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators import rowvec

MOST = rowvec.MOST_COLUMNS


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns with their entry of largest magnitude positive, so that reruns agree."""
    flip = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.where(flip == 0, 1, flip)


def gram(x: DataFrame) -> np.ndarray:
    return rowvec.sums(x, lambda b: {"g": (r := rowvec.rows(b)).T @ r})["g"]


def eigen(a: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest k eigenvalues of a symmetric matrix, falling, and their vectors as columns of length 1."""
    if a.ndim != 2 or a.shape[0] != a.shape[1] or len(a) > MOST or not np.allclose(a, a.T):
        raise ValueError(f"no symmetric matrix of shape {a.shape}")
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(values)[::-1][:k]
    return values[order], _signed(vectors[:, order])


def svd(x: DataFrame, rank: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U as rows (i, vec), the singular values, and V, of rows (i, vec); at most ``rank`` of them, and none of zero value.

    From the eigenvalues of XᵀX, so values under about 1e-8 of the largest are noise and left out.
    """
    values, vectors = eigen(gram(x), rank)
    real = values > 1e-14 * max(values.max(), 1e-300)
    s, v = np.sqrt(values[real]), vectors[:, real]
    return rowvec.times_matrix(x, v / s), s, v


def inv(a: np.ndarray) -> np.ndarray:
    if a.ndim != 2 or a.shape[0] != a.shape[1] or len(a) > MOST:
        raise ValueError(f"no inverse of shape {a.shape}")
    return np.linalg.inv(a)


def pca(x: DataFrame, k: int, centred: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Projected rows (i, vec), the largest k eigenvalues of the covariance, and their vectors as columns.

    ``centred`` False projects the rows as they are.
    """
    got = rowvec.sums(x, lambda b: {"n": np.array([b.num_rows]), "s": (r := rowvec.rows(b)).sum(0), "g": r.T @ r})
    n, mean = got["n"][0], got["s"] / got["n"][0]
    values, v = eigen((got["g"] - n * np.outer(mean, mean)) / (n - 1), k)
    projected = rowvec.times_matrix(x, v)
    if centred:
        from pyspark.sql import functions as F

        shift = [float(t) for t in mean @ v]
        projected = projected.select("i", F.zip_with("vec", F.array(*map(F.lit, shift)), lambda a, b: a - b).alias("vec"))
    return projected, values, v
