"""Words of a chunk as one Arrow array: their bytes packed without gaps, so that equality is exact and needs no fingerprint."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def packed(data: np.ndarray, inside: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of bytes that are `inside`, none over a bound between two texts; and the text each belongs to."""
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(inside)]
    opens[inner] = inside[inner]
    start = np.flatnonzero(opens)
    kept = data[inside]
    ends = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(kept))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return words, np.searchsorted(bounds, start, side="right") - 1


def encoded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and the number of each value among them."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)
