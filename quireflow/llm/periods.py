"""Periodic runs of words, by a sparse diagonal dynamic program.

A run is a stretch of words that repeats with its smallest period q, holds the period
at least twice, has `least` words or more, and cannot be extended by a word
on either side. Seen from each word, an earlier occurrence q words before adds
one to the match length of the lag q; where the next word does not match, the
diagonal ends, and if it has max(q, least - q) matches it is emitted, as
the stretch of its matches and the q words before them.

Two exact shortcuts keep this linear, but for a logarithm, in any text:

* Lags below `SHORT` are few, so their diagonals are followed for all words.
* A lag of [c, 2c) needs c matches in a row, so it is active only over whole
  blocks of c / 2 words: each block of the text, as a single symbol, looks for its
  earlier occurrences at those lags and adds c / 2 to their match lengths. A
  block has at most c of them, and there are 2n / c blocks. Words that complete a
  diagonal at its two ends are compared one by one. Symbols of blocks come from pairs
  of symbols half as long; what occurs once in a text is dropped at each doubling.

A diagonal of lag kq in a run of period q covers the same stretch as that of q, so
of equal stretches the one of least lag is the run, and a diagonal inside a run
whose period divides its lag is not followed further.

Blocks are taken in slices of bounded size, from which the active diagonals are
carried on; so a task needs memory in proportion to a chunk or its longest text.

Defined results: null and blank texts have no words and no runs; repeated rows and
rows with null ids are judged each for itself; an empty table gives an empty
table; columns other than the text are only carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .packed import encoded, packed

LEAST = 12
SHORT = 16
#: Entries of (block, lag) that are held at once.
SLICE = 1 << 20
_STEP = 32


def _short_lags(ids: np.ndarray, place: np.ndarray, least: int) -> list[np.ndarray]:
    """[start, length, lag] of the diagonals of each lag below SHORT that are long enough."""
    found = []
    for lag in range(1, min(SHORT, len(ids))):
        match = np.zeros(len(ids) + 1, np.int8)
        match[lag:-1] = (ids[lag:] == ids[:-lag]) & (place[lag:] >= lag)
        change = np.flatnonzero(np.diff(match, prepend=np.int8(0)))
        first, end = change[::2], change[1::2]
        long = end - first >= max(lag, least - lag)
        first, end = first[long], end[long]
        found.append(np.stack([first - lag, end - first + lag, np.full(len(first), lag)]))
    return found


def _doubled(symbol: np.ndarray, alive: np.ndarray, width: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of stretches twice as long that occur more than once in their text, and where they begin."""
    alive = alive[alive + width < len(symbol)]
    after = alive + width
    # a stretch of another text has a smaller place; one that occurs once has no symbol
    alive = alive[(symbol[after] >= 0) & (place[after] == place[alive] + width)]
    pair = symbol[alive] * (len(symbol) + 1) + symbol[alive + width]
    _, code, often = np.unique(pair, return_inverse=True, return_counts=True)
    again = often[code] > 1
    grown = np.full(len(symbol), -1, np.int64)
    grown[alive[again]] = code[again]
    return grown, alive[again]


def _chained(lag: np.ndarray, first: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of matches that follow one another."""
    order = np.lexsort((first, lag))
    lag, first, end = lag[order], first[order], end[order]
    new = np.ones(len(lag), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (first[1:] != end[:-1]) | (text[first[1:]] != text[first[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(lag)) - 1
    return lag[heads], first[heads], end[tails]


def _matching(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many words from `at` on, in direction `way`, equal those `lag` before them; at most `room`."""
    length = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(room > 0)
    while len(open_):
        steps = np.arange(_STEP)
        inside = length[open_, None] + steps < room[open_, None]
        here = np.where(inside, at[open_, None] + way * (length[open_, None] + steps), at[open_, None])
        same = inside & (ids[here] == ids[here - lag[open_, None]])
        ahead = np.where(same.all(axis=1), _STEP, same.argmin(axis=1))
        length[open_] += ahead
        open_ = open_[ahead == _STEP]
    return length


def _implied(found: list[np.ndarray], lag: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a diagonal lies in a run already found whose period divides the lag; of the runs begun by then, the one that ends last is looked at."""
    start, length, period = np.concatenate(found, axis=1)
    if not len(start):
        return np.zeros(len(lag), bool)
    order = np.lexsort((-period, start))
    start, stop, period = start[order], (start + length)[order], period[order]
    latest = np.maximum.accumulate(stop)
    best = np.maximum.accumulate(np.where(stop == latest, np.arange(len(stop)), 0))
    at = np.searchsorted(start, first - lag, side="right") - 1
    run = best[np.maximum(at, 0)]
    return (at >= 0) & (stop[run] >= end) & (lag % period[run] == 0)


def _long_lags(found: list[np.ndarray], ids: np.ndarray, place: np.ndarray, text: np.ndarray, last: np.ndarray, slice_rows: int) -> None:
    """Adds [start, length, lag] of the diagonals of lags from SHORT on that are long enough, octave by octave.

    `found` has those of the lags before; diagonals that they imply are not followed.
    """
    n = len(ids)
    _, symbol = np.unique(text * (int(ids.max()) + 1) + ids, return_inverse=True)
    symbol, alive, width, octave = symbol.astype(np.int64), np.arange(n), 1, SHORT
    longest = int(place.max()) + 1
    while 2 * octave <= longest:
        while width < octave // 2:
            symbol, alive = _doubled(symbol, alive, width, place)
            width *= 2
        if not len(alive):
            return
        key = np.sort(symbol[alive] * n + alive)
        block = alive[place[alive] % width == 0]
        base = symbol[block] * n
        low = np.searchsorted(key, base + np.maximum(block - 2 * octave + 1, 0))
        count = np.maximum(np.searchsorted(key, base + block - octave, side="right") - low, 0)
        count[block < octave] = 0
        cuts = np.searchsorted(np.cumsum(count), np.arange(slice_rows, int(count.sum()) + slice_rows, slice_rows)) + 1
        ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = (np.zeros(0, np.int64),) * 3
        done = 0
        for cut in cuts:
            if cut <= done:
                continue
            now = np.repeat(block[done:cut], count[done:cut])
            lag = now - key[W.ranges(low[done:cut], count[done:cut])] % n
            chains = _chained(*(np.concatenate(x) for x in zip(held, (lag, now, now + width), strict=True)), text)
            frontier = int(block[min(cut, len(block)) - 1]) + 1
            goes_on = chains[2] >= frontier
            ends.append(tuple(x[~goes_on] for x in chains))
            held = tuple(x[goes_on] for x in chains)
            done = int(cut)
        ends.append(held)
        lag, first, end = (np.concatenate(x) for x in zip(*ends, strict=True))
        able = (end - first + 2 * (width - 1) >= lag) & ~_implied(found, lag, first, end)
        lag, first, end = lag[able], first[able], end[able]
        first = first - _matching(ids, first - 1, lag, np.maximum(np.minimum(place[first] - lag, width - 1), 0), -1)
        end = end + _matching(ids, end, lag, np.minimum(last[text[first]] - end, width - 1), 1)
        long = end - first >= lag
        found.append(np.stack([(first - lag)[long], (end - first + lag)[long], lag[long]]))
        octave *= 2


def runs_of(ids: np.ndarray, counts: np.ndarray, least: int = LEAST, slice_rows: int = SLICE) -> np.ndarray:
    """Rows (start, length, period) of all runs of texts that follow one another; `ids` names the words, start counts over all texts."""
    bounds = np.append(0, np.cumsum(counts))
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - bounds[text]
    found = _short_lags(ids, place, least)
    found.append(np.zeros((3, 0), np.int64))
    if len(ids):
        _long_lags(found, ids, place, text, bounds[1:], slice_rows)
    rows = np.concatenate(found, axis=1).T
    # of equal stretches the one of least lag; then by start and period
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[~W.equal_runs(rows[:, 0], rows[:, 1])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _judged(chunk: W.Chunk, least: int, slice_rows: int):
    """Columns of a chunk: words, runs, collapsed texts where words go, digests."""
    words, text = packed(chunk.data, ~W.WHITE[chunk.data], chunk.bounds)
    counts = np.bincount(text, minlength=len(chunk)).astype(np.int64)
    bounds = np.append(0, np.cumsum(counts))
    rows = runs_of(encoded(words)[1], counts, least, slice_rows)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    stay = np.cumsum(change[:-1]) == 0
    owner = text[rows[:, 0]]
    of = np.searchsorted(owner, np.arange(len(chunk) + 1))
    collapsed, digests = [], []
    for i in range(len(chunk)):
        kept = chunk.text(i).split()
        if of[i] < of[i + 1]:
            kept = compress(kept, stay[bounds[i] : bounds[i + 1]].tolist())
        joined = b" ".join(kept)
        digests.append(hashlib.sha256(joined).hexdigest())
        collapsed.append(joined.decode() if of[i] < of[i + 1] else None)
    fields = [pa.array(x) for x in (rows[:, 0] - bounds[owner], np.ascontiguousarray(rows[:, 1]), np.ascontiguousarray(rows[:, 2]))]
    runs = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.array(counts), runs, pa.array(collapsed, pa.string()), pa.array(digests, pa.string())


def periodic_runs(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), least: int = LEAST, slice_rows: int = SLICE) -> DataFrame:
    """(row, n_words, runs, collapsed, collapsed_sha256) for each row of documents.

    `row` is a struct of the columns in `carry`; `runs` are (start, length, period) by
    start, then period. `collapsed` is the text without the words that repeat
    the first period of a run, joined by one space; null where there is no run.
    """
    table = docs.select(F.struct(*carry).alias("row"), "text")
    row = table.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [W.ids(batch, chunk, "row"), *_judged(chunk, least, slice_rows)], ["row", "n_words", "runs", "collapsed", "collapsed_sha256"]
                )

    return table.mapInArrow(
        run, f"row {row}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string, collapsed_sha256 string"
    )


def longest(runs: str = "runs"):
    """(length, -start, -period) of the longest run, the first of equals; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
