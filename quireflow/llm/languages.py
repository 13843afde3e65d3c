"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed n-grams of bytes tells languages whose bit is 1 from those whose bit is 0:
naive Bayes, its weights being log ratios of smoothed n-gram shares. The shares
are counted over all training documents, in one distributed pass whose partial
sums are combined per language and n-gram before the shuffle; what reaches the
driver is one number for each language and n-gram bucket, whatever the input.

A text's margins, one for each bit, are compared with all codewords: the loss of
a codeword is the sum of exp(-margin * bit), bits being +1 or -1, each weighted by
how well its classifier did on the training counts. The least loss wins; the
score is its share of the soft vote, and a text whose best two are close is
flagged as ambiguous.

Few languages take the exhaustive code (every split of the languages); many take
codewords drawn from a fixed seed, the draw with the largest least distance.

Defined results: null text and text without letters are `und` with score 0; with
no training rows every text is `und`; one learned language is always predicted
(score 1); repeated rows count as often as they occur; rows without a language
are never learned from.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

UNDETERMINED = "und"
GRAMS = (2, 3, 4)
BITS = 15
AMBIGUOUS = 0.75
#: Margins are per n-gram; this many n-grams at most speak in full confidence.
_SHARPNESS = 24.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _buckets(chunk: W.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the bytes of each text, with a space around it, and their bounds."""
    data = W.LOWER[chunk.data]
    data = np.where(W.WHITE[data] | ((data < 128) & ~_LETTER[data]), 32, data)
    key = np.zeros(max(len(data) - n + 1, 0), np.uint32)
    for j in range(n):
        key = key * np.uint32(0x01000193) ^ data[j : len(key) + j].astype(np.uint32)
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    counts = np.maximum(np.diff(chunk.bounds) - n + 1, 0)
    return key[W.ranges(chunk.bounds[:-1], counts)] if len(chunk) > 1 else key, counts


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for chunk in W.chunks(batch):
                langs = np.array(W.ids(batch, chunk, "lang").to_pylist(), object)
                names, kind = np.unique(langs.astype(str), return_inverse=True)
                for g, n in enumerate(GRAMS):
                    grams, counts = _buckets(chunk, n)
                    joint = np.repeat(kind, counts) * (1 << BITS) + grams
                    found = np.bincount(joint, minlength=len(names) << BITS).reshape(len(names), -1)
                    for name, row in zip(names, found, strict=True):
                        whole = totals.setdefault(str(name), np.zeros(len(GRAMS) << BITS, np.int64))
                        whole[g << BITS : (g + 1) << BITS] += row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "gram", "n"]
            )

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, gram int, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codewords(classes: int) -> np.ndarray:
    """Rows of +1 and -1, one for each class."""
    if not classes:
        return np.zeros((0, 0), np.int8)
    if classes <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).reshape(-1, classes).T
    width = max(15, int(np.ceil(10 * np.log2(classes))))
    draw = np.random.Generator(np.random.PCG64(5))
    best, best_distance = None, -1
    for _ in range(200):
        code = draw.choice(np.array([1, -1], np.int8), (classes, width))
        product = code.astype(int) @ code.T
        distance = (width - (product - 2 * width * np.eye(classes, dtype=int)).max()) // 2
        if distance > best_distance and (np.abs(code.sum(axis=0)) < classes).all():
            best, best_distance = code, distance
    return best


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, weights of each n-gram for each bit, and trust in each bit."""
    rows = gram_counts(labelled).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), len(GRAMS) << BITS))
    counts[rows["lang"].map({n: i for i, n in enumerate(langs)}).to_numpy(int), rows["gram"].to_numpy(int)] = rows["n"]
    code = codewords(len(langs))
    weights = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    trust = np.zeros(code.shape[1])
    for g in range(len(GRAMS)):
        part = slice(g << BITS, (g + 1) << BITS)
        # a language's share, not its size, speaks: each counts the same inside its side of a bit
        share = (counts[:, part] + 0.5) / (counts[:, part].sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
        for b in range(code.shape[1]):
            ratio = np.log(share[code[:, b] == 1].mean(axis=0)) - np.log(share[code[:, b] == -1].mean(axis=0))
            weights[part, b] = ratio
            trust[b] += (share @ ratio * code[:, b]).min() if len(langs) else 0
    trust = np.clip(trust, 1e-3, None)
    return langs, code, weights, trust / trust.sum() if len(trust) else trust


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row; only the text is looked at."""
    langs, code, weights, trust = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                texts = batch.column(batch.schema.get_field_index("text")).slice(chunk.rows.start, len(chunk))
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                n = len(chunk)
                sums, grams_in = np.zeros((n, code.shape[1])), np.zeros(n)
                for g, size in enumerate(GRAMS):
                    grams, counts = _buckets(chunk, size)
                    full = np.flatnonzero(counts)
                    starts = (np.cumsum(counts) - counts)[full]
                    for b in range(code.shape[1]):
                        if len(full):
                            sums[full, b] += np.add.reduceat(weights[(g << BITS) : (g + 1) << BITS, b][grams], starts)
                    grams_in += counts
                margin = sums / np.maximum(grams_in, 1)[:, None] * np.minimum(grams_in, _SHARPNESS * len(GRAMS))[:, None] / len(GRAMS)
                loss = np.exp(-np.clip(margin, -30, 30)[:, None, :] * code[None]) @ trust if len(langs) else np.zeros((n, 0))
                if len(langs) > 1:
                    vote = 1 / np.maximum(loss, 1e-12)
                    vote /= vote.sum(axis=1, keepdims=True)
                    order = np.sort(loss, axis=1)
                    best, score = loss.argmin(axis=1), vote.max(axis=1)
                    close = order[:, 0] > AMBIGUOUS * order[:, 1]
                else:
                    best, score, close = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
                sure = letters & bool(langs)
                yield pa.RecordBatch.from_arrays(
                    [
                        W.ids(batch, chunk), pa.array([langs[i] if s else UNDETERMINED for i, s in zip(best, sure, strict=True)], pa.string()),
                        pa.array(np.where(sure, score, 0.0), pa.float64()), pa.array(close | ~sure),
                    ],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
