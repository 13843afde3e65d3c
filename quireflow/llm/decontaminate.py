"""Benchmark decontamination by a distributed positional inverted index. Built-in functions only.

1. The terms of the test items are counted in the corpus. Each window of test
   words (`window` consecutive ones, or a whole shorter item) names its two
   rarest terms; a window with a term that the corpus lacks cannot occur.
2. The index stores the postings of those terms: (term, document, position), with
   the few words around.
3. The posting list of a window's rarest term, moved by the term's offset, is
   intersected with the moved list of its second rarest: an equi-join on
   document, term and position.
4. What is left is verified: an exact match has all the window's words in order.

A proximity match at a start has at least `share` of the window's distinct words
within `slop` words of their places. It may lack any of the others, so the window is
looked up by its rarest words, one more than may be lacking, absent ones among them:
each match has one of those, and its words around tell whether there is a match.

Defined results: null and blank texts have no words; items without a word are no
items; a one-word item is a window whose two rarest terms are the same; equal
windows of several items count for each item; repeated documents are indexed once and hit alike;
empty tables give no hits. Columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asciiwords import ascii_lower, bounded, phrase, raw_words, word_count
from .rows import keyed, single

WINDOW = 10
SLOP = 2
SHARE = 0.8


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(phrase, terms, size, item): the windows of each item."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), raw_words(F.col("text")).alias("w"))
    words = words.select("item", "w", word_count(F.col("w")).cast("int").alias("n")).filter("n > 0")
    words = words.select("item", "n", F.transform(F.slice("w", F.lit(1), F.col("n")), ascii_lower).alias("w"))
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))).alias("s"))
    terms = F.slice("w", F.col("s") + 1, F.lit(window))
    return starts.select("item", terms.alias("terms")).select(
        F.array_join("terms", " ").alias("phrase"), "terms", F.size("terms").alias("size"), "item"
    )


def _exploded(docs: DataFrame) -> DataFrame:
    words = docs.select("key", "tag", raw_words(F.col("text")).alias("words"))
    return words.select("key", "tag", "words", F.posexplode("words").alias("pos", "raw")).withColumn("term", ascii_lower(F.col("raw"))).drop("raw")


def _term_counts(keyed_docs: DataFrame, windows: DataFrame) -> DataFrame:
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    terms = cut_lineage(terms)
    return _exploded(keyed_docs).select("term").join(bounded(terms, terms.count()), "term").groupBy("term").count()


def rarest_terms(keyed_docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(phrase, terms, size, t1, o1, t2, o2) of windows all of whose terms the corpus has."""
    found = _term_counts(keyed_docs, windows)
    each = windows.select("phrase", "terms", "size", F.posexplode("terms").alias("offset", "term"))
    ranked = (
        each.join(found, "term", "left")
        .groupBy("phrase", "terms", "size")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "term"))).alias("r"))
    )
    second = F.when(F.size("r") > 1, F.get("r", F.lit(1))).otherwise(F.get("r", F.lit(0)))
    return (
        ranked.select("phrase", "terms", "size", F.get("r", F.lit(0)).alias("a"), second.alias("b"))
        .filter("a.count > 0")
        .select("phrase", "terms", "size", F.col("a.term").alias("t1"), F.col("a.offset").alias("o1"), F.col("b.term").alias("t2"), F.col("b.offset").alias("o2"))
    )


def postings(keyed_docs: DataFrame, terms: DataFrame, rows: int, around: int) -> DataFrame:
    """(term, key, tag, pos, context, at) of the wanted terms; `context[at]` is the term."""
    return _exploded(keyed_docs).join(bounded(terms, rows), "term").select(
        "term", "key", "tag", "pos",
        F.slice("words", F.greatest(F.col("pos") - around, F.lit(0)) + 1, F.lit(2 * around + 1)).alias("context"),
        F.least("pos", F.lit(around)).alias("at"),
    )


def matches(keyed_docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, share: float = SHARE) -> DataFrame:
    """(key, tag, start, size, phrase, exact): where windows of the items occur.

    Rows that are not exact appear only with a slop above 0.
    """
    windows = cut_lineage(_windows(items, window).select("phrase", "terms", "size").distinct())
    if slop:
        return _near_matches(keyed_docs, windows, window, slop, share)
    chosen = cut_lineage(rarest_terms(keyed_docs, windows))
    terms = cut_lineage(chosen.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())
    index = cut_lineage(postings(keyed_docs, terms, terms.count(), window - 1))
    first = (
        index.withColumnRenamed("term", "t1")
        .join(bounded(chosen, chosen.count()), "t1")
        .withColumn("start", F.col("pos") - F.col("o1"))
        .filter("start >= 0")
    )
    second = index.select(F.col("term").alias("t2"), "key", "tag", F.col("pos").alias("p2"))
    met = first.withColumn("p2", F.col("start") + F.col("o2")).join(second, ["key", "tag", "t2", "p2"])
    inside = F.col("at") - F.col("o1")
    exact = F.coalesce(phrase(F.col("context"), inside, F.col("size")) == F.col("phrase"), F.lit(False))
    met = met.withColumn("exact", exact).filter("exact")
    return met.groupBy("key", "tag", "start", "size", "phrase").agg(F.max("exact").alias("exact"))


def _near_matches(keyed_docs: DataFrame, windows: DataFrame, window: int, slop: int, share: float) -> DataFrame:
    """`matches` with a slop; each place of a rare word gives the start nearest to it that matches."""
    each = windows.select("phrase", "terms", "size", F.posexplode("terms").alias("offset", "term"))
    each = each.groupBy("phrase", "terms", "size", "term").agg(F.collect_list("offset").alias("offsets"))
    ranked = (
        each.join(_term_counts(keyed_docs, windows), "term", "left")
        .groupBy("phrase", "terms", "size")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term", "offsets"))).alias("r"))
        .withColumn("need", F.ceil(share * F.size("r")).cast("int"))
    )
    rare = ranked.select("phrase", "terms", "size", "need", F.explode(F.slice("r", F.lit(1), F.size("r") - F.col("need") + 1)).alias("a"))
    anchors = cut_lineage(
        rare.filter("a.count > 0").select("phrase", "terms", "size", "need", F.col("a.term").alias("term"), F.explode("a.offsets").alias("offset"))
    )
    terms = cut_lineage(anchors.select("term").distinct())
    index = postings(keyed_docs, terms, terms.count(), window - 1 + 2 * slop)
    index = index.withColumn("context", F.transform("context", ascii_lower))
    met = index.join(bounded(anchors, anchors.count()), "term").filter(F.size(F.array_intersect("context", "terms")) >= F.col("need"))
    base = F.col("at") - F.col("offset")

    def stands(term, place):
        first = F.greatest(place - slop, F.lit(0))
        return F.array_contains(F.slice("context", first + 1, F.greatest(place + slop - first + 1, F.lit(0))), term)

    def enough(moved):
        return F.size(F.array_distinct(F.filter("terms", lambda term, i: stands(term, base + moved + i)))) >= F.col("need")

    moves = F.array(*[F.lit(m) for m in sorted(range(-slop, slop + 1), key=abs)])
    met = met.withColumn("moved", F.get(F.filter(moves, enough), F.lit(0))).filter("moved is not null")
    exact = F.coalesce(F.array_join(F.slice("context", F.greatest(base, F.lit(0)) + 1, F.col("size")), " ") == F.col("phrase"), F.lit(False))
    met = met.withColumn("exact", (F.col("moved") == 0) & (base >= 0) & exact).withColumn("start", F.col("pos") - F.col("offset") + F.col("moved"))
    return met.groupBy("key", "tag", "start", "size", "phrase").agg(F.max("exact").alias("exact"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, tag, n_hit, items) of the documents in which a window occurs exactly; items are sorted texts."""
    found = cut_lineage(matches(single(keyed(docs))[0], items, window))
    covered = (
        found.select("key", "tag", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p"))
        .distinct().groupBy("key", "tag").agg(F.count("*").alias("n_hit"))
    )
    owners = _windows(items, window).select("phrase", "item").distinct()
    named = (
        found.select("key", "tag", "phrase").distinct().join(owners, "phrase")
        .groupBy("key", "tag").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return covered.join(named, ["key", "tag"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of documents."""
    counted = keyed(docs, "doc_id").select("key", "tag", "row.doc_id", word_count(raw_words(F.col("text"))).alias("n_words"))
    return counted.join(hits(docs, items, window), ["key", "tag"], "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """(doc_id, n_near_windows, n_near_items) for each row: windows that occur by proximity but not exactly, and their items."""
    found = matches(single(keyed(docs))[0], items, window, slop, share).groupBy("key", "tag", "phrase").agg(F.max("exact").alias("exact"))
    near = cut_lineage(found.filter("not exact").select("key", "tag", "phrase"))
    owners = _windows(items, window).select("phrase", "item").distinct()
    counts = near.join(owners, "phrase").groupBy("key", "tag").agg(
        F.countDistinct("phrase").alias("n_near_windows"), F.countDistinct("item").alias("n_near_items")
    )
    return keyed(docs, "doc_id").join(counts, ["key", "tag"], "left").select(
        "row.doc_id", F.coalesce("n_near_windows", F.lit(0)).alias("n_near_windows"), F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents in which no window of an item occurs, with all their columns."""
    found = hits(docs, items, window).select("key", "tag")
    return keyed(docs, *docs.columns).join(found, ["key", "tag"], "left_anti").select("row.*")
