"""Maximal runs of bytes of a class in UTF-8 texts, found over a whole Arrow column at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of A-Z as a-z; all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_runs(texts: pa.Array, member) -> tuple[pa.Array, np.ndarray]:
    """(the runs of all texts with A-Z in lower case, the number of runs of each text); null has none.

    ``member`` maps an array of bytes to whether each belongs to a run; runs do not cross texts.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    inside = member(raw)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(first)
    starts = np.cumsum(inside)[at] - 1
    kept = LOWER[raw[inside]]
    ends = np.append(starts, len(kept)).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
    counts = np.bincount(np.searchsorted(bounds, at, side="right") - 1, minlength=len(texts)).astype(np.int64)
    return runs, counts
