"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Each distinct piece of a text is merged
once and kept in the worker process for later texts: its bytes start as single
tokens, and the adjacent pair whose joined bytes have the least rank is merged,
the leftmost of equals, until no pair has a rank. Long pieces keep their pairs in
a heap, so their cost grows with n log n. Decoding concatenates the tokens' bytes.

`encode_words` folds the same merges with Spark's higher-order functions over
arrays of bytes, with the ranks as a literal map (in buckets, since a map is
searched from its start). It is the plain form of the method; the query uses the
worker form, because the plain one must shuffle every occurrence of every word to
join the encoded words back to the texts (README has the figures).

Defined results: null text is an empty text of no tokens; other columns are not
read; repeated rows are encoded alike; a lone surrogate cannot reach Spark.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import kept

#: Pieces a worker keeps the tokens of; then it starts anew. It bounds memory, not results.
KEPT_PIECES = 300_000
#: Pieces of more bytes are merged with a heap and not kept.
LONG = 200


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece by ranked merges."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        least, at = None, -1
        for i, rank in enumerate(pair):
            if rank is not None and (least is None or rank < least):
                least, at = rank, i
        if least is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or after[i] < 0 or end[after[i]] != last:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = last, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Encoder:
    def __init__(self, pieces: list[bytes], pattern: str) -> None:
        import regex

        self.cut = regex.compile(pattern).findall
        self.pieces = pieces
        self.ranks = {p: i for i, p in enumerate(pieces)}
        self.known: dict[str, list[int]] = {}

    def tokens(self, text: str) -> list[int]:
        words = self.cut(text)
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        own: dict[str, list[int]] = {}
        for word in set(words).difference(known):
            data = word.encode()
            (own if len(data) > LONG else known)[word] = merge(data, self.ranks)
        if own:
            return [i for w in words for i in (known.get(w) or own[w])]
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, tokens))


def encode(
    docs: DataFrame, pieces: list[bytes], pattern: str, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False
) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row; `row` holds the carried columns."""
    name = f"bpe-{hashlib.sha256(b' '.join(pieces) + pattern.encode()).hexdigest()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(name, lambda: _Encoder(pieces, pattern))
        for batch in batches:
            count, ids_hash, text_hash, ids = [], [], [], []
            for text in batch.column(1):
                tokens = encoder.tokens(text.as_py() or "")
                count.append(len(tokens))
                ids_hash.append(hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(encoder.decode(tokens)).hexdigest())
                if with_ids:
                    ids.append(tokens)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    given = docs.select(F.struct(*carry).alias("row"), "text")
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(
        run, f"row {row}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    )


def decode(tokenized: DataFrame, pieces: list[bytes]) -> DataFrame:
    """Adds `decoded`, the bytes of the tokens in `ids`; a null list gives a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            told = [None if ids is None else b"".join(map(pieces.__getitem__, ids)) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokenized.schema.fields)
    return tokenized.mapInArrow(run, f"{fields}, decoded binary")


def rank_map(pieces: list[bytes], buckets: int = 8_192) -> Column:
    """Ranks as a literal: an array of small maps, from hexadecimal bytes to rank, by their CRC-32."""
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for rank, piece in enumerate(pieces):
        key = piece.hex().upper()
        table[zlib.crc32(key.encode()) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: Column, buckets: int = 8_192) -> DataFrame:
    """(word, ids) of distinct words, by a fold with higher-order functions only."""

    def rank(key: Column) -> Column:
        return F.try_element_at(F.get(ranks, F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")), key)

    def step(parts: Column, _: Column) -> Column:
        last = F.size(parts) - 2
        pairs = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        ranked = F.filter(F.transform(pairs, lambda i: F.struct(rank(F.concat(F.get(parts, i), F.get(parts, i + 1))).alias("r"), i.alias("i"))), lambda x: x["r"].isNotNull())
        at = F.array_min(ranked)["i"]
        joined = F.concat(F.slice(parts, F.lit(1), at), F.array(F.concat(F.get(parts, at), F.get(parts, at + 1))), F.slice(parts, at + 3, F.size(parts)))
        return F.when(at.isNull(), parts).otherwise(joined)

    size = F.octet_length("word")
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.hex(F.substring(F.col("word").cast("binary"), i, F.lit(1))))
    folded = F.aggregate(F.sequence(F.lit(1), size), single, step)
    known = words.filter(size > 0).select("word", F.when(rank(F.hex("word")).isNotNull(), F.array(F.hex("word"))).otherwise(folded).alias("parts"))
    return known.select("word", F.transform("parts", rank).alias("ids"))
