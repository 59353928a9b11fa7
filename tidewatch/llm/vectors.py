"""Vectors as Arrow columns: reading lists of floats into numpy blocks, with a mark for the usable ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def block(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of float64, usable): null vectors, null or non-finite components, and other lengths than d aren't.

    d: the length of the vectors; None: that of the longest here. Unusable rows are 0.
    """
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    n = np.where(valid, np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)), -1).astype(np.int64)
    d = int(n.max(initial=0)) if d is None else d
    usable = valid & (n == d) & (d > 0)
    out = np.zeros((len(column), d))
    if usable.any():
        flat = pc.list_flatten(column.filter(pa.array(usable)))
        out[usable] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    usable &= np.isfinite(out).all(1)
    out[~usable] = 0
    return out, usable


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(column: pa.Array, dtype: type, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype).reshape(-1, d)
