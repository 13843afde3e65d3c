"""Substring dedup: repeated word windows by prefix-partitioned sparse suffix trees.

A window is `length` consecutive words of one text. A word goes if a window that
covers it also starts anywhere else in the corpus.

How it runs:

1. Of each window one suffix is sampled: the one whose prefix of `prefix` words
   has the least fingerprint among the prefixes inside the window. Equal windows
   sample equal suffixes, so nothing is lost, and about two suffixes in
   `length - prefix + 1` are kept. A sampled suffix carries its windows, as
   fingerprints of their whole word sequences (the depth-`length` nodes they
   reach in the tree).
2. Suffixes are shuffled by prefix, so that a subtree meets in one place. The
   prefix is of variable length: one shared by more than `group_rows` suffixes
   is lengthened to the whole window, and those windows are counted by key, with
   partial sums, instead of being gathered. A subtree in memory is thus bounded.
3. A partition is sorted by prefix; its subtrees are cut from it in turn. Inside
   a subtree, windows are ordered by the node they reach; a node at the wanted
   depth with two leaves or more is a repeat, and its leaves are reported.

Two windows count as equal if 64 bits of their common prefix and 48 bits of the
whole window agree.

Defined results: null or blank texts have no words; a text with fewer words than
a window keeps all; repeated rows repeat each other's windows, so all of their
words in windows go, and only one of them enters the tree; an empty table gives an empty table; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W
from .asciiwords import bounded
from .rows import keyed, single

LENGTH = 35
PREFIX = 8
#: Most suffixes that a subtree in memory may hold.
GROUP_ROWS = 50_000
_WINDOW_BYTES = 6


def _least_in_window(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each `width` consecutive values, the first of equals."""
    best = np.arange(len(value))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(value[right] < value[left], right, left)
        span += step
    return best


def sampled_suffixes(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(key, tag, prefix, at, windows): one row per sampled suffix of keyed texts.

    `at` is the first word of its first window; `windows` holds six bytes for
    each of the consecutive windows that sample the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                found = chunk.words()
                starts, _ = found.gram_starts(length)
                if not len(starts):
                    continue
                spans = W.Spans(found.value)
                heads = spans.of(np.arange(len(found.value) - prefix + 1), np.arange(prefix, len(found.value) + 1))
                chosen = _least_in_window(heads, length - prefix + 1)[starts]
                text = found.text
                new = np.ones(len(starts), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
                at = np.flatnonzero(new)
                windows = spans.of(starts, starts + length) >> np.uint64(16)
                packed = windows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WINDOW_BYTES]
                bounds = np.append(at, len(starts)).astype(np.int32) * _WINDOW_BYTES
                rows = text[starts[at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        W.ids(batch, chunk, "key").take(pa.array(rows)),
                        W.ids(batch, chunk, "tag").take(pa.array(rows)),
                        pa.array(heads[chosen[at]].view(np.int64)),
                        pa.array((starts[at] - found.first[rows]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))]),
                    ],
                    ["key", "tag", "prefix", "at", "windows"],
                )

    return docs.select("key", "tag", "text").mapInArrow(run, "key long, tag int, prefix long, at int, windows binary")


def _unpacked(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All window fingerprints of a binary column, and how many each row has."""
    windows = windows.cast(pa.large_binary())
    _, bounds, data = windows.buffers()
    bounds = np.frombuffer(bounds, np.int64)[windows.offset : windows.offset + len(windows) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].reshape(-1, _WINDOW_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :_WINDOW_BYTES] = raw
    return full.view("<u8").ravel(), np.diff(bounds) // _WINDOW_BYTES


def _runs(table: pa.Table, count: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """(key, tag, first, last) of each run of hit windows; a run stays inside one suffix."""
    owner = np.repeat(np.arange(len(count)), count)
    start = W.ranges(table["at"].to_numpy().astype(np.int64), count)
    edge = np.ones(len(owner), bool)
    edge[1:] = owner[1:] != owner[:-1]
    opens = hit & (edge | np.append(True, ~hit[:-1]))
    closes = hit & np.append(edge[1:] | ~hit[1:], True)
    rows = table.select(["key", "tag"]).take(pa.array(owner[opens])).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [*(_whole(rows[c]) for c in ("key", "tag")), pa.array(start[opens].astype(np.int32)), pa.array(start[closes].astype(np.int32))],
        ["key", "tag", "first", "last"],
    )


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each prefix group of a partition that is sorted by prefix."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        prefix = table["prefix"].to_numpy()
        alone = ~W.equal_runs(prefix)
        alone &= np.append(alone[1:], True)
        if alone.all():
            return
        table = table.filter(pa.array(~alone))
        windows, count = _unpacked(_whole(table["windows"]))
        group = np.repeat(np.cumsum(~W.equal_runs(table["prefix"].to_numpy())), count)
        order = np.lexsort((windows, group))
        same = W.equal_runs(windows[order], group[order])
        hit = np.zeros(len(windows), bool)
        hit[order] = same | np.append(same[1:], False)
        yield _runs(table, count, hit)

    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        last = batch.column(2)[-1].as_py()
        if held < 100_000 or (last == kept[0].column(2)[0].as_py()):
            continue
        table = pa.Table.from_batches(kept)
        cut = int(np.searchsorted(table["prefix"].to_numpy(), last))
        yield from solve(table.slice(0, cut))
        kept = table.slice(cut).to_batches()
        held = table.num_rows - cut
    if kept:
        yield from solve(pa.Table.from_batches(kept))


def repeated_windows(keyed_docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, tag, first, last): runs of windows that start more than once in the corpus.

    Prefixes shared by more than `group_rows` suffixes are at most one in
    `group_rows` of the sampled suffixes; they are counted before they are broadcast.
    """
    suffixes = sampled_suffixes(keyed_docs, length, prefix)
    heavy = cut_lineage(suffixes.groupBy("prefix").count().filter(F.col("count") > group_rows).select("prefix"))
    spans = "key long, tag int, first int, last int"
    n_heavy = heavy.count()
    light = suffixes.join(bounded(heavy, n_heavy), "prefix", "left_anti") if n_heavy else suffixes
    light = (
        light.select("key", "tag", "prefix", "at", "windows")
        .repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(_subtrees, spans)
    )
    if not n_heavy:
        return light
    each = (
        suffixes.join(bounded(heavy, n_heavy), "prefix", "left_semi")
        .select("key", "tag", "prefix", "at", "windows", F.posexplode(F.expr(f"sequence(1, length(windows), {_WINDOW_BYTES})")))
        .select("key", "tag", "prefix", (F.col("at") + F.col("pos")).alias("first"), F.expr(f"substring(windows, col, {_WINDOW_BYTES})").alias("node"))
    )
    nodes = each.groupBy("prefix", "node").count().filter("count > 1").select("prefix", "node")
    long = each.join(nodes, ["prefix", "node"]).select("key", "tag", "first", F.col("first").alias("last"))
    return light.unionByName(long)


def _cut(length: int):
    """Row function: words, removed words, and the text of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, digests = [], [], [], []
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for text, spans, copied in zip(column["text"], column["runs"], column["copied"], strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                spans = spans.as_py()
                if copied.as_py():
                    spans = [{"first": 0, "last": len(words) - length}] if len(words) >= length else None
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["first"] for s in spans], 1)
                    np.add.at(change, [s["last"] + length for s in spans], -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(counts[-1] - len(words))
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if spans else None)
            yield pa.RecordBatch.from_arrays(
                [column["row"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                ["row", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    length: int = LENGTH,
    prefix: int = PREFIX,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(row, n_words, n_removed, kept_text, kept_sha256) for each row of documents.

    `row` is a struct of the columns in `carry`. `kept_text`, the kept words
    joined by one space, is null where nothing was removed.
    """
    if not 1 <= prefix <= length:
        raise ValueError("the prefix must fit into the window")
    texts, repeated = single(keyed(docs))
    runs = (
        repeated_windows(texts, length, prefix, group_rows)
        .groupBy("key", "tag")
        .agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    )
    # of texts that have copies all windows repeat, whatever else is in the tree
    judged = runs.join(repeated.withColumn("copied", F.lit(True)), ["key", "tag"], "full").select(
        "key", "tag", F.when(F.col("copied").isNull(), F.col("runs")).alias("runs"), F.col("copied").isNotNull().alias("copied")
    )
    joined = keyed(docs, *carry).join(judged, ["key", "tag"], "left").select("row", "text", "runs", "copied")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _cut(length), f"row {row}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )
