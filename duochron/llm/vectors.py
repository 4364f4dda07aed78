"""Vectors in Arrow batches: which rows take part, and their entries as integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LARGEST = (1 << 63) - 1


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, entries as double) of the usable rows of a list column, one pair for each length.

    A row is usable if it is not null and holds neither null nor non-finite entries."""
    flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (bad[ends] == bad[ends - lengths])
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def floors(x: np.ndarray, scale: float = 1024.0, plus: int = 0) -> np.ndarray:
    """floor(scale * x) + plus as long; values beyond the range of long end at its ends."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    whole = np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return whole if not plus else np.where(whole > LARGEST - plus, LARGEST, whole + plus)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the least of 2, 4 and 8 bytes that holds them all."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
