"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero everywhere."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have the same length, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def group_means(x: np.ndarray, group: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Mean row of ``x`` per group number; groups without rows keep their row of ``present``."""
    order = np.argsort(group, kind="stable")
    names, starts, counts = np.unique(group[order], return_index=True, return_counts=True)
    out = present.copy()
    out[names] = np.add.reduceat(x[order], starts, axis=0) / counts[:, None].astype(x.dtype)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of ``x`` by Lloyd's rounds from rows drawn without replacement."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        centres = group_means(x, np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1), centres)
    return centres
