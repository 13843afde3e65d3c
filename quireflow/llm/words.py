"""Words and word fingerprints of whole Arrow batches, as numpy arrays.

A batch is cut into chunks of a few megabytes of text (never inside a text), so
a task needs memory in proportion to one chunk or to its longest text, not to
its partition. Every fingerprint is a polynomial over random byte values
modulo 2**64, mixed at the end; it depends on the text alone, so all tasks agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Bytes from which a word's fingerprint is a digest. Sums over shorter words cannot cancel modulo 2**64.
LONG_WORD = 64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_U = np.uint64
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _BASE_INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., at least n of them."""
    have = _powers[base]
    if len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2)), base, np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Spans:
    """Fingerprints of any spans of a sequence of 64-bit values, by differences of running sums."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self._running = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_BASE, n), out=self._running[1:])
        self._undo = _power(_BASE_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._running[end] - self._running[start]) * self._undo[start] + (end - start).astype(np.uint64))


def bytes_of(data: np.ndarray) -> Spans:
    """Fingerprints of spans of a text's bytes."""
    return Spans(_VALUES[data])


@dataclass
class Words:
    """The words of a chunk: bounds in bytes, fingerprints, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of all runs of n words inside one text."""
        starts, counts = self.gram_starts(n)
        return starts, Spans(self.value).of(starts, starts + n)

    def gram_starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.maximum(self.count - (n - 1), 0)
        return ranges(self.first[:-1], counts), counts


@dataclass
class Chunk:
    """Texts of consecutive rows as one byte array."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, fold: np.ndarray = AS_IS) -> Words:
        black = ~WHITE[self.data]
        opens, closes = black.copy(), black.copy()
        opens[1:] &= ~black[:-1]
        closes[:-1] &= ~black[1:]
        inner = self.bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(black))]
        opens[inner] = black[inner]
        closes[inner - 1] = black[inner - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        folded = fold[self.data]
        value = Spans(_VALUES[folded]).of(start, end)
        # a polynomial modulo a power of two can be fooled, but only by long words
        for i in np.flatnonzero(end - start > LONG_WORD):
            value[i] = int.from_bytes(hashlib.blake2b(folded[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return Words(start, end, value, np.searchsorted(start, self.bounds))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then the same for each next pair."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return np.arange(total) + shift


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a text column, of `size` bytes or one text; a null is an empty text."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    if not len(texts):
        return
    _, bounds_buffer, data_buffer = texts.buffers()
    bounds = np.frombuffer(bounds_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(bounds, bounds[low] + size, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield Chunk(slice(low, high), data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        low = high


def ids(batch: pa.RecordBatch, chunk: Chunk, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).slice(chunk.rows.start, len(chunk))


def equal_runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: whether each row equals the row before it."""
    same = np.zeros(len(keys[0]), bool)
    if len(same) > 1:
        same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return same
