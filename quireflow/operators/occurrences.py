"""Where many strings stand in long texts, one block of text at a time.

A string is looked for by a window of its bytes, whose hash is its key. The windows of a
block are hashed from running sums, so one costs the same whatever its width. What a key
finds is compared byte by byte: a hash never decides.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: More places than this, and a search through the block costs less than a comparison at each.
MANY = 1 << 10
#: Windows whose keys differ in these bits from all wanted ones are not sorted.
SIFT_BITS = 18
#: Windows hashed at a time on the side of the strings.
ROWS = 1 << 12
#: A key stands in a bitmap by the low bits that are left at each of these shifts.
SHIFTS = (0, 18, 37)
#: (windows begin behind a space, bytes of a window)
Kind = tuple[bool, int]
# Sent by value, so that executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _mixed(sums: np.ndarray, width: int) -> np.ndarray:
    keys = sums + np.uint64(width)
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(MIX)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def keys_of(windows: pa.Array) -> np.ndarray:
    """The key of each string of bytes; of a null, any."""
    ends = np.frombuffer(windows.buffers()[1], dtype=np.int32)[windows.offset : windows.offset + len(windows) + 1]
    data = np.frombuffer(windows.buffers()[2] or b"", dtype=np.uint8)
    widths, keys = np.diff(ends), np.zeros(len(windows), dtype=np.int64)
    for width in np.unique(widths):
        powers, rows = _powers(BASE, width), np.flatnonzero(widths == width)
        for some in (rows[at : at + ROWS] for at in range(0, len(rows), ROWS)):
            letters = data[ends[some][:, None] + np.arange(width)].astype(np.uint64) + np.uint64(1)
            keys[some] = _mixed((letters * powers).sum(axis=1, dtype=np.uint64), int(width))
    return keys


@F.arrow_udf(T.LongType())
def window_key(windows: pa.Array) -> pa.Array:
    return pa.array(keys_of(windows), pa.int64())


class Block:
    """A block of text whose windows have keys."""

    def __init__(self, text: bytes):
        self.text = text
        self.data = np.frombuffer(text, dtype=np.uint8)
        letters = (self.data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(text))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters, dtype=np.uint64)])
        self.inverse = _powers(pow(BASE, -1, 1 << 64), len(text))
        self.starts: np.ndarray | None = None

    def windows(self, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places) of all windows of a kind."""
        behind_space, width = kind
        if behind_space:
            places = np.flatnonzero(self.data == ord(" ")) + 1
            places = places[places + width <= len(self.data)]
            sums = (self.sums[places + width] - self.sums[places]) * self.inverse[places]
        else:
            places = np.arange(max(len(self.data) - width + 1, 0))
            sums = (self.sums[width:] - self.sums[: len(places)]) * self.inverse[: len(places)]
        return _mixed(sums, width), places

    def find(self, kind: Kind, keys: np.ndarray) -> Iterator[np.ndarray]:
        """The places of the windows that have each of the keys."""
        own, places = self.windows(kind)
        wanted = np.zeros(1 << SIFT_BITS, dtype=bool)
        wanted[keys & (len(wanted) - 1)] = True
        some = np.flatnonzero(wanted[own & (len(wanted) - 1)])
        some = some[np.argsort(own[some], kind="stable")]
        own, places = own[some], places[some]
        ends = np.searchsorted(own, keys, "right")
        return (places[start:end] for start, end in zip(np.searchsorted(own, keys), ends))

    def characters(self, at: int) -> int:
        """Characters before a byte."""
        if self.starts is None:
            self.starts = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return int(self.starts[at])

    def holds(self, string: bytes, before: int, places: np.ndarray) -> bool:
        if len(places) > MANY:
            return self.text.find(string) >= 0
        return any(True for _ in self.standing(string, before, places))

    def standing(self, string: bytes, before: int, places: np.ndarray) -> Iterator[int]:
        """Bytes where the string begins, of those ``before`` bytes ahead of the places."""
        return (at for at in (places - before).tolist() if at >= 0 and self.text.startswith(string, at))


def text_keys(kinds: list[Kind], bitmap) -> Callable:
    """A column function: the distinct keys of a text's windows of the given kinds that a broadcast bitmap may hold."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(texts: pa.Array) -> pa.Array:
        longs = bitmap.value
        found = []
        for text in texts:
            block = Block(text.as_buffer().to_pybytes())
            held = [np.zeros(0, dtype=np.int64)]
            for kind in kinds:
                own, _ = block.windows(kind)
                for shift in SHIFTS:
                    bit = (own >> shift) & (len(longs) * 64 - 1)
                    own = own[(longs[bit >> 6] >> (bit & 63)) & 1 == 1]
                held.append(own)
            found.append(np.unique(np.concatenate(held)))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))

    return keys


#: (site, block, id, n, pieces, text, before, behind_space, width, key); the text of a block has no id and comes ahead of what is looked for in it.
SOUGHT = ("site", "block", "id", "n", "pieces", "text", "before", "behind_space", "width", "key")
STANDING = "site string, id long, pieces int, n int, start long, line string"
_STANDING = pa.schema([("site", pa.string()), ("id", pa.int64()), ("pieces", pa.int32()), ("n", pa.int32()), ("start", pa.int64()), ("line", pa.string())])


def standing_pieces(block: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over sorted rows of ``SOUGHT``: the pieces that stand in their block.

    A line of one piece gives itself once a block. Any other piece gives, for each place,
    where its line would start, counted in characters of the site.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        for batch in batches:
            found: list[tuple] = []
            ids, texts = batch.column("id"), batch.column("text")
            heads = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            for start, end in zip([-1, *heads], [*heads, batch.num_rows]):
                if start >= 0:
                    held = Block(texts[start].as_buffer().to_pybytes())
                if end > start + 1:
                    found += _standing(held, batch.slice(start + 1, end - start - 1), block, piece)
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found) if found else [[]] * 6, _STANDING.types)], schema=_STANDING)

    return rows


def _standing(held: Block, sought: pa.RecordBatch, block: int, piece: int) -> Iterator[tuple]:
    names = ("behind_space", "width", "key", "before", "n", "pieces", "id", "block")
    behind, width, keys, before, n, pieces, ids, blocks = (sought.column(name).to_numpy(zero_copy_only=False) for name in names)
    texts, site = sought.column("text"), sought.column("site")[0].as_py()
    for kind in sorted(set(zip(behind.tolist(), width.tolist()))):
        rows = np.flatnonzero((behind == kind[0]) & (width == kind[1]))
        for row, places in zip(rows.tolist(), held.find(kind, keys[rows])):
            if not len(places):
                continue
            string = texts[row].as_buffer().to_pybytes()
            if pieces[row] == 1:
                if held.holds(string, before[row], places):
                    yield site, ids[row], 1, 0, 0, string.decode()
                continue
            for at in held.standing(string, before[row], places):
                # what begins in the overlap is the next block's
                if (within := held.characters(at)) < block:
                    yield site, ids[row], pieces[row], n[row], blocks[row] * block + within - n[row] * piece, None
