"""Columns of texts as one array of bytes, so that a batch is cut and hashed without a Python
object per word."""

from __future__ import annotations

import numpy as np


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts without nulls, and the bounds of each text."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if places is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray, text: bool = True):
    """An Arrow column of the ranges between neighbouring bounds, over the same bytes."""
    import pyarrow as pa

    kind = pa.large_string() if text else pa.large_binary()
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(bounds) - 1, buffers)


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of some ranges of ``values``, and their contents one after the other."""
    starts = bounds[which]
    lengths = bounds[which + 1] - starts
    ends = np.cumsum(lengths)
    where = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    return lengths, values[where]


def pieces_of(column) -> list[bytes]:
    """The values of an Arrow column of UTF-8 bytes, none of which holds the byte FF."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(column):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column.cast(pa.large_binary()))
    return pc.binary_join(whole, pa.scalar(b"\xff", pa.large_binary()))[0].as_buffer().to_pybytes().split(b"\xff")
