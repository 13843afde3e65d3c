"""Source divergence audit: how far the sources of a language differ in their use of its common terms.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A
language keeps the terms that at least `threshold` of its documents hold. They are
found by iceberg prefix refinement: level by level, byte prefixes twice as long
are counted by the documents that hold them, and only those of `threshold`
documents or more are extended. A prefix is in no fewer documents than any term
that begins with it, so no kept term is lost, and rare terms, the bulk of a
vocabulary, are given up after their first bytes. A term no longer than a
level's width is complete there: it is counted by language and source, in documents
and in occurrences, and leaves the refinement. The last level is the one
after which no unfinished prefix is left.

Each level is one pass over the texts that yields partial counts for each few
megabytes, summed before the shuffle. The prefixes left over from the level
before travel to the tasks while they are few (`SHIP_BYTES`); beyond that the
counts are semi-joined with them, with the same result.

From the counts of kept terms each group (language and source) and each
language gets shares in integers: p = 1 + floor(10**9 (n + 2) / (N + 2 V)). The divergence
at a term is floor((p - q)**2 / (p + q)). A pair of sources sums it over all V
terms; terms that neither or only one of the two has need no join: they are V and
a histogram of the group's shares.

Defined results: null texts have no terms, a null language or source is the empty
string; each row is a document, so repeated rows count as often as they occur; a
group without terms is compared like any other; a language without kept terms
has pairs of value 0 and no term rows; a language with one source has neither; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W
from .asciiwords import bounded
from .packed import encoded, packed

THRESHOLD = 10
WIDTH = 6
TOP = 10
UNIT = 1_000_000_000
#: Bytes of prefixes up to which a level's survivors travel with the tasks.
SHIP_BYTES = 16 << 20

#: Bytes of text whose partial counts are summed before they leave a task.
_CHUNK_BYTES = 12 << 20
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _surviving(parents: pa.Array, lang: np.ndarray, names: list[str], left: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each parent prefix is among those left of its language."""
    distinct, code = encoded(parents)
    texts = np.array(distinct.to_pylist(), dtype=bytes)
    keep = np.zeros(len(code), bool)
    for i, name in enumerate(names):
        known = left.get(name)
        if known is not None and len(texts):
            at = np.minimum(np.searchsorted(known, texts), len(known) - 1)
            keep |= (known[at] == texts)[code] & (lang == i)
    return keep


def _counted(group: np.ndarray, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and codes that occur together, the rows that hold them, and how often they occur."""
    if not len(code):
        return (np.zeros(0, np.int64),) * 4
    width = int(code.max()) + 1
    seen, often = np.unique(row * width + code, return_counts=True)
    both = group[seen // width] * width + seen % width
    order = np.argsort(both, kind="stable")
    both, often = both[order], often[order]
    first = np.flatnonzero(~W.equal_runs(both))
    return both[first] // width, both[first] % width, np.diff(np.append(first, len(both))), np.add.reduceat(often, first)


def _level(width: int, before: int, left: dict[str, np.ndarray] | None):
    """Row function: partial counts of the terms longer than `before` by their first `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch, size=_CHUNK_BYTES):
                names, lang = encoded(W.ids(batch, chunk, "lang"))
                sources, source = encoded(W.ids(batch, chunk, "source"))
                data = W.LOWER[chunk.data]
                terms, row = packed(data, _LETTER[data], chunk.bounds)
                if before:
                    longer = pc.binary_length(terms).to_numpy() > before
                    terms, row = terms.filter(pa.array(longer)), row[longer]
                if left is not None and len(row):
                    keep = _surviving(pc.binary_slice(terms, 0, before), lang[row], names.to_pylist(), left)
                    terms, row = terms.filter(pa.array(keep)), row[keep]
                whole = pc.binary_length(terms).to_numpy() <= width
                # complete terms are counted by language and source, prefixes by language alone
                for part, group in ((whole, lang * len(sources) + source), (~whole, lang)):
                    if not part.any():
                        continue
                    values, code = encoded(pc.binary_slice(terms.filter(pa.array(part)), 0, width))
                    of, which, docs, often = _counted(group, row[part], code)
                    complete = part is whole
                    yield pa.RecordBatch.from_arrays(
                        [
                            names.take(pa.array(of // len(sources) if complete else of)),
                            sources.take(pa.array(of % len(sources))) if complete else pa.nulls(len(of), pa.string()),
                            values.take(pa.array(which)).cast(pa.binary()),
                            pa.array(np.full(len(of), complete)),
                            pa.array(docs.astype(np.int64)),
                            pa.array(often.astype(np.int64)),
                        ],
                        ["lang", "source", "prefix", "whole", "docs", "often"],
                    )

    return run


def _shipped(left: DataFrame, width: int, ship_bytes: int) -> dict[str, np.ndarray] | None:
    """The prefixes left, sorted, by language; None if they are too many to travel."""
    if left.count() * width > ship_bytes:
        return None
    table: dict[str, list[bytes]] = {}
    for lang, prefix in left.select("lang", "prefix").collect():
        table.setdefault(lang, []).append(bytes(prefix))
    return {lang: np.sort(np.array(prefixes, dtype=f"S{width}")) for lang, prefixes in table.items()}


def kept_terms(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences of each language's kept terms in each of its sources that has any.

    `lang_n` is the term's sum over the sources; one row of each term is its first.
    """
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms: DataFrame | None = None
    before, left, shipped = 0, None, None
    while left is None or not left.isEmpty():
        level = texts.mapInArrow(_level(width, before, shipped), "lang string, source string, prefix binary, whole boolean, docs long, often long")
        level = level.groupBy("lang", "source", "prefix", "whole").agg(F.sum("docs").alias("docs"), F.sum("often").alias("n"))
        if left is not None and shipped is None:
            parents = left.select("lang", F.col("prefix").alias("parent"))
            level = level.withColumn("parent", F.substring("prefix", 1, before)).join(parents, ["lang", "parent"], "left_semi").drop("parent")
        # a group is one row for each source, summed already
        same = Window.partitionBy("lang", "prefix", "whole")
        level = level.select(
            "*", F.sum("docs").over(same).alias("held"), F.sum("n").over(same).alias("lang_n"),
            (F.col("source") == F.min("source").over(same)).alias("first"),
        )
        level = cut_lineage(level.filter(F.col("held") >= threshold).drop("docs", "held"))
        complete = level.filter("whole").select("lang", "source", F.col("prefix").cast("string").alias("term"), "n", "lang_n", "first")
        terms = complete if terms is None else terms.unionByName(complete)
        left = level.filter("not whole").select("lang", "prefix")
        shipped = _shipped(left, width, ship_bytes)
        before, width = width, 2 * width
    return terms


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT (n + 2) / (total + 2 size)), exact for any count; 1 where nothing is kept."""
    parts = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(size == 0, F.lit(1).cast("long")).otherwise(1 + _div(parts, (total + 2 * size).cast("decimal(20,0)")))


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most UNIT + 1, so the square fits into 64 bits."""
    return _div((p - q) * (p - q), p + q)


def _pairs(counts: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): the summed divergence of each two sources of a language, both ways round.

    Every one of the V terms adds the distance of the two shares of nothing. What a term
    of one group changes in that depends on its share alone, so it is summed over a
    histogram of shares; only terms of both groups are joined by term.
    """
    of = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("kept").alias("size"))
    other = bounded(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb")), n_groups)
    bins = counts.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("za")).agg(F.count("*").alias("terms"))
    alone = (
        bins.join(other, "lang").filter("a != b").groupBy("lang", "a", "b")
        .agg(F.sum(F.col("terms") * (_distance(F.col("p"), F.col("zb")) - _distance(F.col("za"), F.col("zb")))).alias("alone"))
    )
    left = counts.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    right = counts.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    change = (
        _distance(F.col("pa"), F.col("pb")) - _distance(F.col("pa"), F.col("zb"))
        - _distance(F.col("za"), F.col("pb")) + _distance(F.col("za"), F.col("zb"))
    )
    shared = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("shared"))
    one = of.join(other, "lang").filter("a < b").join(alone, ["lang", "a", "b"], "left")
    one = one.join(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back")), ["lang", "a", "b"], "left")
    one = one.join(shared, ["lang", "a", "b"], "left")
    nothing = F.lit(0)
    value = (
        F.col("size") * _distance(F.col("za"), F.col("zb"))
        + F.coalesce("alone", nothing) + F.coalesce("back", nothing) + F.coalesce("shared", nothing)
    )
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    both = one.select("lang", F.explode(F.array(*ways)).alias("way"), value.alias("value"))
    return both.select("lang", "way.source", "way.item", "value")


def divergence(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, width: int = WIDTH, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms that a source overuses most."""
    counts = kept_terms(docs, threshold, width, ship_bytes)
    sizes = counts.filter("first").groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    occurring = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = cut_lineage(groups.withColumn("zero", _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    n_groups = groups.count()
    p, q = (_share(F.col(n), F.col(total), F.col("kept")) for n, total in (("n", "total"), ("lang_n", "lang_total")))
    shares = counts.join(bounded(groups, n_groups), ["lang", "source"]).select("lang", "source", "term", "zero", p.alias("p"), q.alias("q"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(shares, groups, n_groups)
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
