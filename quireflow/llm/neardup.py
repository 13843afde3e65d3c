"""Near-duplicates: universal hash minima, banding, verification, and components.

1. One pass over the texts makes, for each document, its set of distinct word
   shingles (as 64-bit fingerprints, in memory only), a 128-bit fingerprint of
   the set, and the minima of `BANDS * ROWS` multiply-shift hashes over the set.
2. Documents with equal sets form a class; only its least document goes on, so a
   group of thousands of exact copies is one row from here.
3. The minima are cut into bands; classes that agree on a band share a bucket.
   In a bucket each member is paired with the least member and with the one whose
   signature agrees best, never with all. Signatures are compared inside blocks of
   bounded size; pairs whose agreement is 4.5 standard deviations below the
   threshold are dropped there, and pairs that cannot be links: by their sizes, or
   by the parity sketches of their sets. A sketch holds, for each of its bits,
   whether an odd number of shingles falls on it, so two sketches differ in at
   most as many bits as the sets differ in shingles: that test loses nothing.
4. The pairs are confirmed on full sets, and links are joined to components by
   large-star and small-star.
5. A bucket whose members are now in one component has nothing to add. In the
   others each member is tried with its best partner outside its component; then,
   where components still differ, with every partner outside it whose signature
   passes (each pair in the first band it shares). So a link between two classes
   that share a bucket is not lost to the star.

Two sets of similarity s share no bucket with probability (1 - s**ROWS)**BANDS:
5e-6 at 0.75.

Defined results: null and blank texts have an empty set, linked with nothing; a
text with fewer words than a shingle has its whole sequence as its one shingle,
which never equals a longer one; rows that share a doc_id are one node; rows
without a doc_id join the component of the rows with an equal set, or have none;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W
from .asciiwords import bounded
from .components import components

WORDS = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Members of a bucket compared with each other in one task, at most, and members compared at once.
BLOCK = 2_048
_SLAB = 32
#: Bits of a parity sketch.
PARITY = 1_024

_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(chunk: W.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints, sorted inside each text, and the bounds of each text's part."""
    found = chunk.words(W.LOWER)
    counts = found.count
    grams, per_text = found.gram_starts(n)
    spans = W.Spans(found.value)
    values = spans.of(grams, grams + n)
    bounds = np.append(0, np.cumsum(per_text))
    parts, sizes = [], np.zeros(len(chunk), np.int64)
    for i in range(len(chunk)):
        if per_text[i]:
            part = np.unique(values[bounds[i] : bounds[i + 1]])
        elif counts[i]:
            part = spans.of(found.first[i : i + 1], found.first[i + 1 : i + 2])
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def _minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least product with each multiplier, a row for each non-empty text."""
    sizes = np.diff(bounds)
    starts = bounds[:-1][sizes > 0]
    out = np.empty((len(starts), len(_MULTIPLIERS)), np.uint16)
    # Runs of texts whose values stay in the processor's cache.
    cuts = [0]
    for i, at in enumerate(starts):
        if at - starts[cuts[-1]] > 1 << 15:
            cuts.append(i)
    cuts.append(len(starts))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if low == high:
            continue
        end = starts[high] if high < len(starts) else len(values)
        part, at = values[starts[low] : end], starts[low:high] - starts[low]
        for k, a in enumerate(_MULTIPLIERS):
            out[low:high, k] = W.mix(np.minimum.reduceat(part * a, at)) >> np.uint64(48)
    return out


def _parities(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The parity sketch of each set, as 64-bit words."""
    texts = len(bounds) - 1
    out = np.zeros((texts, PARITY // 64), np.uint64)
    bit = (W.mix(values) % np.uint64(PARITY)).astype(np.int64)
    for low in range(0, texts, 512):
        high = min(low + 512, texts)
        own = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1])) * PARITY + bit[bounds[low] : bounds[high]]
        odd = (np.bincount(own, minlength=(high - low) * PARITY) & 1).astype(np.uint8)
        out[low:high] = np.packbits(odd.reshape(high - low, PARITY), axis=1, bitorder="little").view(np.uint64)
    return out


def signatures(docs: DataFrame, n: int = WORDS, signed: bool = True) -> DataFrame:
    """(doc_id, n_shingles, set_hash, signature) of each row of documents; unsigned, the last is null.

    A signature is the minima, then the parity sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                values, bounds = shingle_sets(chunk, n)
                sizes = np.diff(bounds)
                full = sizes > 0
                minima = _minima(values, bounds) if signed else None
                parity = _parities(values, bounds) if signed else None
                sums = [np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)]
                if len(values):
                    for total, salt in zip(sums, (0x51ED270B, 0xA3C59AC3), strict=True):
                        total[full] = np.add.reduceat(W.mix(values + np.uint64(salt)), bounds[:-1][full])
                rows = np.cumsum(full) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        W.ids(batch, chunk).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array([a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)], pa.binary()),
                        pa.array([minima[r].tobytes() + parity[i].tobytes() if signed and f else None for i, (r, f) in enumerate(zip(rows, full, strict=True))], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_hash", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def least_agreement(percent: int) -> float:
    s = percent / 100
    return s - 4.5 * (s * (1 - s) / len(_MULTIPLIERS)) ** 0.5


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, shingles): the sorted set fingerprints of the wanted documents, for exact tests.

    While the wanted ids are few enough to be broadcast, the texts are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch):
                values, bounds = shingle_sets(chunk, n)
                offsets = pa.array(bounds.astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([W.ids(batch, chunk).cast(pa.int64()), sets], ["cid", "shingles"])

    names = wanted.select(F.col("cid").alias("doc_id"))
    chosen = docs.select("doc_id", "text").join(bounded(names, wanted.count()), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "cid long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return (
        pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        .filter(100 * shared >= percent * union).select("u", "v")
    )


def buckets(classes: DataFrame, *keep: str) -> DataFrame:
    """(cid, kept columns, band, bucket): each class once for each band."""
    width = 2 * ROWS
    bands = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(signature, b * {width} + 1, {width})))"))
    return classes.select("cid", *keep, bands.alias("band", "bucket"))


def _partners(members: DataFrame, percent: int, mode: str) -> DataFrame:
    """Pairs (u, v) of a bucket whose signatures pass, found in blocks.

    members: (bucket, band, cid, component, n_shingles, signature, members), the
    last being the number of rows of the bucket. Modes:
    `first` pairs each member with the least of the block and with its best;
    `best` with its best outside its component; `all` with all outside it.
    """
    least = least_agreement(percent)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        cid, component, size, half = (table[c].to_numpy() for c in ("cid", "component", "n_shingles", "half"))
        band = table["band"][0].as_py()
        raw = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(cid), -1)
        minima = np.ascontiguousarray(raw[:, : 2 * BANDS * ROWS]).view(np.uint16)
        parity = np.ascontiguousarray(raw[:, 2 * BANDS * ROWS :]).view(np.uint64)
        two_sided = bool(half.max())
        seek = np.arange(len(cid))
        if mode != "first":
            kinds, counts = np.unique(component, return_counts=True)
            largest = kinds[counts.argmax()]
            seek = np.flatnonzero(component != largest)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(seek), _SLAB):
            i = seek[at : at + _SLAB, None]
            fits = 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            fits &= cid != cid[i] if mode == "first" else component != component[i]
            if mode == "all":
                fits &= (component == largest) | (cid > cid[i])
            if two_sided:
                fits &= half != half[i]
            differ = np.bitwise_count(parity[i] ^ parity).sum(axis=2, dtype=np.int64)
            both = size + size[i]
            fits &= 100 * (both - differ) >= percent * (both + differ)
            equal = minima[i] == minima
            share = equal.mean(axis=2)
            fits &= share >= least
            if mode == "all":
                fits &= equal.reshape(len(i), len(cid), BANDS, ROWS).all(axis=3).argmax(axis=2) == band
                left, right = np.nonzero(fits)
                found.append((i[left, 0], right, share[left, right]))
                continue
            some = np.flatnonzero(fits.any(axis=1))
            share = np.where(fits, share, -1)
            found.append((i[some, 0], share[some].argmax(axis=1), share[some].max(axis=1)))
            if mode == "first":
                least_one = fits[some].argmax(axis=1)
                found.append((i[some, 0], least_one, share[some, least_one]))
        left, right, share = (np.concatenate([f[k] for f in found] or [np.zeros(0)]) for k in range(3))
        return pa.table({"u": pa.array(cid[left.astype(int)]), "v": pa.array(cid[right.astype(int)]), "share": pa.array(share, pa.float64())})

    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("half"),
            "band", "cid", "component", "n_shingles", "signature",
        )
    )
    pairs = dealt.groupBy("bucket", "low", "high").applyInArrow(run, "u long, v long, share double")
    if mode != "all":
        # of all its buckets' pairs, a member keeps the best and, at first, the least
        own = pairs.groupBy("u").agg(F.max_by("v", F.struct("share", -F.col("v"))).alias("best"), F.min("v").alias("least"))
        pairs = own.select("u", F.explode(F.array("best", "least") if mode == "first" else F.array("best")).alias("v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    some = signatures(docs, n).filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(
        some.groupBy("set_hash", "n_shingles").agg(F.min(F.struct("doc_id", "signature")).alias("least"))
        .select("set_hash", "n_shingles", F.col("least.doc_id").alias("cid"), "least.signature")
    )
    own = classes.select("cid", "n_shingles", "signature")
    members = buckets(own).repartition("bucket")
    shared = members.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    crowd = members.join(shared, "bucket").withColumn("component", F.col("cid")).join(own, "cid")
    pairs = cut_lineage(_partners(crowd, percent, "first"))
    active = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct())
    sets = cut_lineage(full_sets(docs, active, n))
    joined = components(_confirmed(pairs, sets, percent))
    # Whoever has a partner that passes is in a pair by now; the others take no further part.
    near = cut_lineage(own.join(active, "cid", "left_semi"))
    for mode in ("best", "all"):
        named = near.join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        placed = buckets(named, "component")
        counted = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members"))
        several = counted.filter("a < b").select("bucket", "members")
        mixed = placed.join(several, "bucket").join(near, "cid")
        more = cut_lineage(_confirmed(_partners(mixed, percent, mode), sets, percent))
        if not more.isEmpty():
            # the components found so far are stars; new links join their hubs
            stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
            joined = components(stars.unionByName(more))
    placed = joined.select(F.col("node").alias("cid"), "component")
    rows = (
        signatures(docs, n, signed=False).join(classes.select("set_hash", "n_shingles", "cid"), ["set_hash", "n_shingles"], "left")
        .withColumn("cid", F.when(F.col("n_shingles") > 0, F.col("cid")).otherwise(F.col("doc_id")))
        .join(placed, "cid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "cid").alias("component_id"))
    )
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
