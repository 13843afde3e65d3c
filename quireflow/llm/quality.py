"""Quality rules: base counts, and repetition found by suffix arrays.

The method: a suffix array over the words of one text puts equal beginnings next
to each other; the longest common prefixes of neighbours bound the intervals
whose members share a maximal repeated substring. Each suffix takes the longer
of its two common prefixes; those of `least_repeat` words or more are spans of
repeated text. The union of the spans, as a share of all words, and the longest
repeat are limited.

Suffix arrays are built by prefix doubling for all texts of a chunk at once. A
text without a repeated run of `least_repeat` words has no such span, so its
array is not built; that test reads all of its words, and changes no result.

Defined results: null and blank texts have no words and fail the base rule
(fewer than 50 words); nothing is read but the id and the text; repeated rows are
judged alone, each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Production limits. A repeat counts from `least_repeat` words on."""

    least_words: int = 50
    most_repeat_words: int = 50
    least_repeat: int = 8
    most_covered: float = 0.3
    most_longest: float = 0.2


def _gram_order(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (text, value), and whether each row of it equals the row before."""
    key = W.mix(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    return order, W.equal_runs(key[order])


def _repeated(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    order, same = _gram_order(text, value)
    hit = np.zeros(len(value), bool)
    hit[order] = same | np.append(same[1:], False)
    return hit


def _covered(n_words: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Words inside any of the spans."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[bounds[1:]] - total[bounds[:-1]]


def suffix_arrays(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order inside each text, and the ranks at the lengths 1, 2, 4, ...

    Suffixes of different texts never compare equal.
    """
    n = len(value)
    order = np.lexsort((value, text))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(~W.equal_runs(text[order], value[order])) - 1
    levels = [rank]
    step = 1
    while n and rank.max() < n - 1:
        nxt = np.full(n, -1, np.int64)
        inside = np.arange(n - step) if step < n else np.zeros(0, np.int64)
        inside = inside[text[inside] == text[inside + step]]
        nxt[inside] = rank[inside + step]
        order = np.lexsort((nxt, rank))
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(~W.equal_runs(rank[order], nxt[order])) - 1
        rank = fresh
        levels.append(rank)
        step *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Words shared by each suffix of the order and the one before it, in the same text."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return shared
    left, right = order[:-1].copy(), order[1:].copy()
    live = text[left] == text[right]
    for k in range(len(levels) - 1, -1, -1):
        ok = live & (left < n) & (right < n)
        at = np.flatnonzero(ok)
        # equal ranks at length 2**k: equal words, or both texts end; the end cannot be shared inside one text
        at = at[levels[k][left[at]] == levels[k][right[at]]]
        at = at[text[left[at]] == text[right[at]]]
        left[at] += 1 << k
        right[at] += 1 << k
        shared[at + 1] += 1 << k
    return shared


def _repetition(words: W.Words, text: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by repeats, and the longest repeat, of each text."""
    texts = len(words.first) - 1
    covered, longest = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    starts, values = words.grams(limits.least_repeat)
    if not len(starts):
        return covered, longest
    doubtful = np.unique(text[starts[_repeated(text[starts], values)]])
    if not len(doubtful):
        return covered, longest
    chosen = W.ranges(words.first[doubtful], words.count[doubtful])
    value, owner = words.value[chosen], text[chosen]
    order, levels = suffix_arrays(value, owner)
    shared = common_prefixes(order, levels, owner)
    length = np.zeros(len(value), np.int64)
    length[order] = np.maximum(shared, np.append(shared[1:], 0))
    long = np.flatnonzero(length >= limits.least_repeat)
    inside = _covered(len(value), long, length[long])
    np.add.at(covered, owner[inside], 1)
    np.maximum.at(longest, owner[long], length[long])
    return covered, longest


def _lines(chunk: W.Chunk, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    data, bounds = chunk.data, chunk.bounds
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, bounds[1:]]))
    word = np.append(0, np.cumsum(np.bincount(word_start, minlength=len(data))))
    full = word[end] > word[start]
    start, end = start[full], end[full]
    text = np.searchsorted(bounds, start, side="right") - 1
    order, same = _gram_order(text, W.bytes_of(data).of(start, end))
    return np.bincount(text[order[same]], minlength=len(chunk))


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """(row, counts, repetition, base_failed, kept) for each row; `row` holds the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                words, n = chunk.words(), len(chunk)
                text, count = words.text, words.count
                black = ~W.WHITE[chunk.data]
                chars = _sums(black & ((chunk.data & 0xC0) != 0x80), chunk.bounds)
                symbols = _sums(SYMBOLS[chunk.data], chunk.bounds)
                starts, values = words.grams(3)
                twice = starts[_repeated(text[starts], values)]
                repeat = np.bincount(text[_covered(len(text), twice, 3)], minlength=n) if len(text) else np.zeros(n, np.int64)
                covered, longest = _repetition(words, text, limits)
                failed = (count < limits.least_words) | (100 * repeat > limits.most_repeat_words * count)
                kept = ~failed & (covered <= limits.most_covered * count) & (longest <= limits.most_longest * count)
                columns = {
                    "row": W.ids(batch, chunk, "row"), "n_words": count, "word_chars": chars, "n_symbols": symbols,
                    "n_dup_lines": _lines(chunk, words.start), "n_repeat_words": repeat, "covered_words": covered,
                    "longest_repeat": longest, "base_failed": failed, "kept": kept,
                }
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v.astype(bool if v.dtype == bool else np.int64)) for v in columns.values()],
                    list(columns),
                )

    given = docs.select(F.struct(*carry).alias("row"), "text")
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(
        run,
        f"row {row}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "covered_words long, longest_repeat long, base_failed boolean, kept boolean",
    )
