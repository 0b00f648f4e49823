"""Helpers on the buffers of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
