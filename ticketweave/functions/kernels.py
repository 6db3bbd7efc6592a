"""The one Arrow kernel both scorers share: term vectors times a small dense table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

def csr_parts(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, buckets and counts of a ``terms`` column, without copying rows."""
    offsets = terms.offsets.to_numpy()
    first, last = int(offsets[0]), int(offsets[-1])
    pairs = terms.values.slice(first, last - first)
    buckets, counts = pairs.flatten()
    return (
        offsets - first,
        buckets.to_numpy(zero_copy_only=False),
        counts.to_numpy(zero_copy_only=False).astype(np.float64),
    )


def row_sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum the values of each row; rows without terms give 0."""
    out = np.zeros(len(offsets) - 1)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(values, offsets[filled])
    return out


def dot_rows(offsets, buckets, weights, dense: np.ndarray) -> np.ndarray:
    """``dense`` (column x bucket) times each row's sparse vector: column x row.

    Column by column: one column stays in the processor's cache, and the
    products take no more memory than the batch itself.
    """
    out = np.empty((len(dense), len(offsets) - 1))
    for i, column in enumerate(dense):
        out[i] = row_sums(offsets, column[buckets] * weights)
    return out


def round6(values: np.ndarray) -> np.ndarray:
    """Round half up to six places, as SQL does for positive numbers."""
    return np.floor(values * 1e6 + 0.5) / 1e6
