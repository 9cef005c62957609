"""Rows of vectors as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None for a null row and one with null or non-finite components."""
    if column.null_count == 0 and column.flatten().null_count == 0:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        counts = np.diff(column.offsets.to_numpy())
        if len(counts) and (counts == counts[0]).all() and counts[0]:
            rows = flat.reshape(len(counts), counts[0])
            finite = np.isfinite(rows).all(1)
            return [r if ok else None for r, ok in zip(rows, finite, strict=True)]
    out: list[np.ndarray | None] = []
    for row in column:
        values = row.as_py()
        if values is None or any(v is None for v in values):
            out.append(None)
            continue
        vector = np.array(values, np.float64)
        out.append(vector if np.isfinite(vector).all() else None)
    return out
