"""Document fingerprints by I-Match with randomised lexicons. Built-in functions only.

The lexicon is the terms whose inverse document frequency lies in a band: in at
least one of `RAREST` documents and at most one of `COMMONEST`. As a document has
some hundreds of distinct terms on average, the lexicon has at most `RAREST` times
as many terms, however large the corpus; it is counted before it is broadcast.

A term's SHA-256 draws which of `LEXICONS` random lexicons it belongs to, and in that
lexicon the nested subsets that hold it: subset k holds the terms whose draw of 16
bits has at most k binary digits, so each is about half of the next. In each lexicon
a text is hashed by the smallest subset that has any of its terms: the sorted distinct
terms inside are joined and digested. A fingerprint is the digest of all its
lexicon terms, which is the classic one, and one part for each random lexicon, empty if
that has none of its terms. So equal sets of terms have equal fingerprints, and of
texts that share only some terms about as many parts are equal as the share of
terms in common. Likeness is the share of equal parts among those that either text
has, and 1 for equal fingerprints.

The edit that `edited` makes needs each document's successor. Keys alone are range-partitioned
and numbered by partition; a partition's last key takes the first key of the next
from a table of one row per partition. The successor then sends the code points
that are wanted of it; whole texts are shuffled once.

Defined results: null texts are empty; a text without lexicon terms is hashed
by its words in order, all parts empty, so it is like equal texts alone; rows of equal id
and text are one document (64 bits of the text's hash name it) and each
gets its result, but counts as often as it occurs in document frequencies; of equal ids the least
hash comes first; rows without an id follow all others; a single document
follows itself; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asciiwords import ascii_lower, bounded, raw_words

LEXICONS = 16
RAREST = 1000
COMMONEST = 2
KEY = ["unknown", "place", "tag"]
_PART_DIGITS = 6
_WHOLE_DIGITS = 16


def terms(text: Column) -> Column:
    """Distinct terms of a text; one of them may be empty."""
    return F.array_distinct(raw_words(ascii_lower(text)))


def lexicon(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(term, part, level): terms in the band, the random lexicon of each, and the binary digits of its draw there."""
    documents = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).filter("term != ''").groupBy("term").count()
    band = counts.filter((F.col("count") * rarest >= documents) & (F.col("count") * commonest <= documents))
    digest = F.sha2(F.col("term").cast("binary"), 256)
    part, draw = (F.conv(F.substring("digest", at, digits), 16, 10).cast("int") for at, digits in ((1, 1), (2, 4)))
    return band.select("term", digest.alias("digest")).select(
        "term", part.alias("part"), F.when(draw == 0, 0).otherwise(F.length(F.bin(draw))).alias("level")
    )


def _digest(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def _listed(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: x["term"]), " ")


def fingerprint(parts: Column, wordless_digest: Column) -> Column:
    """The fingerprint of a text from its (part, whole, smallest) entries, sorted; another one where there are none."""
    whole = _digest(F.array_join(F.transform(parts, lambda x: x["whole"]), ""), _WHOLE_DIGITS)
    every = F.transform(
        F.sequence(F.lit(0), F.lit(LEXICONS - 1)),
        lambda n: F.coalesce(F.get(F.filter(parts, lambda x: x["part"] == n), F.lit(0))["smallest"], F.lit("")),
    )
    return F.when(F.size(parts) > 0, F.concat_ws("-", whole, every)).otherwise(wordless_digest)


def wordless(text: Column) -> Column:
    """The fingerprint of a text without lexicon terms."""
    return _digest(F.array_join(F.filter(raw_words(ascii_lower(text)), lambda word: word != ""), " "), _WHOLE_DIGITS)


def likeness(one: Column, other: Column) -> Column:
    """Share of equal parts of two fingerprints among the parts that are not empty in both; 1 if they are equal."""
    pairs = F.slice(F.arrays_zip(F.split(one, "-").alias("a"), F.split(other, "-").alias("b")), 2, LEXICONS)
    some = F.filter(pairs, lambda x: (x["a"] != "") | (x["b"] != ""))
    equal = F.size(F.filter(some, lambda x: F.coalesce(x["a"] == x["b"], F.lit(False))))
    return F.when(one == other, F.lit(1.0)).otherwise(equal / F.greatest(F.size(some), F.lit(1)).cast("double"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key whose ascending order is that of descending ids, rows without an id last."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").isNull().alias("unknown"),
        F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).alias("place"),
        F.xxhash64(text).alias("tag"),
        text.alias("text"),
    )


def neighbours(keyed_docs: DataFrame) -> DataFrame:
    """(key, copies, chars, after, before): each key, how often it occurs, its text's length, and the keys on both sides; round the ends."""
    keys = keyed_docs.groupBy(*KEY).agg(F.max(F.length("text")).alias("chars"), F.count("*").alias("copies"))
    placed = keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id())
    placed = cut_lineage(placed.select("part", F.struct(*KEY, "chars", "copies").alias("key")))
    ends = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    over_parts = Window.orderBy("part")
    whole = over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(over_parts), F.first("first").over(whole)).alias("first_after"),
        F.coalesce(F.lag("last").over(over_parts), F.last("last").over(whole)).alias("last_before"),
    )
    inside = Window.partitionBy("part").orderBy("key")
    linked = placed.select("part", "key", F.lead("key").over(inside).alias("after"), F.lag("key").over(inside).alias("before"))
    linked = linked.join(F.broadcast(ends), "part")
    after, before = F.coalesce("after", "first_after"), F.coalesce("before", "last_before")
    return linked.select("key.*", after.alias("after"), before.alias("before"))


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`neighbours`, and (key, text, edited): each text, and the same with its second half replaced by the beginning of the next one.

    The grouped texts are read in two places but are one exchange.
    """
    rows = _keyed(docs)
    links = cut_lineage(neighbours(rows))
    single = rows.groupBy(*KEY).agg(F.min("text").alias("text"))
    sent = single.join(links.select(*KEY, "before"), KEY).select(
        *[F.col(f"before.{c}").alias(c) for c in KEY], F.expr("substring(text, 1, int(before.chars div 2))").alias("piece")
    )
    own = F.expr("substring(text, 1, int(length(text) - length(text) div 2))")
    return links, single.join(sent, KEY).select(*KEY, "text", F.concat(own, F.col("piece")).alias("edited"))


def fingerprints(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of documents."""
    links, texts = edited(docs)
    words = cut_lineage(lexicon(docs, rarest, commonest))
    count = words.count()
    # an entry of its own, with what each text brings besides its terms; a text may have it twice
    mark = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).alias("part"), F.lit(0).alias("level"))
    sides = [
        F.struct(F.lit(side).alias("side"), F.col(name).alias("text")) for side, name in ((0, "text"), (1, "edited"))
    ]
    each = texts.select(*KEY, F.explode(F.array(*sides)).alias("of")).select(
        *KEY, "of.side", "of.text", F.explode(F.concat(F.array(F.lit("")), terms(F.col("of.text")))).alias("term")
    )
    note = F.when(F.col("part") < 0, F.concat(F.sha2(F.col("text").cast("binary"), 256), wordless(F.col("text"))))
    entry = F.when(F.col("part") >= 0, F.struct("level", "term"))
    found = each.join(bounded(words.unionByName(mark), count), "term").select(*KEY, "side", "part", note.alias("note"), entry.alias("entry"))
    found = found.groupBy(*KEY, "side", "part").agg(F.sort_array(F.collect_list("entry")).alias("found"), F.max("note").alias("note"))
    smallest = F.filter("found", lambda x: x["level"] == F.get("found", F.lit(0))["level"])
    part = F.struct("part", _digest(_listed(F.col("found")), _WHOLE_DIGITS).alias("whole"), _digest(_listed(smallest), _PART_DIGITS).alias("smallest"))
    found = found.select(*KEY, "side", "note", F.when(F.col("part") >= 0, part).alias("entry"))
    found = found.groupBy(*KEY).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("entry")))).alias(f"parts_{side}") for side in (0, 1)],
        *[F.max(F.when(F.col("side") == side, F.col("note"))).alias(f"note_{side}") for side in (0, 1)],
    )
    prints = [fingerprint(F.col(f"parts_{side}"), F.substr(f"note_{side}", F.lit(65))) for side in (0, 1)]
    hashed = cut_lineage(
        found.select(*KEY, F.left("note_1", F.lit(64)).alias("edited_sha256"), prints[0].alias("fingerprint"), prints[1].alias("edited_fingerprint"))
    )
    others = hashed.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("fingerprint").alias("next_fingerprint"))
    linked = links.select(*KEY, "copies", "chars", *[F.col(f"after.{c}").alias(f"next_{c}") for c in KEY])
    met = hashed.join(linked.join(others, [f"next_{c}" for c in KEY]).select(*KEY, "copies", "chars", "next_fingerprint"), KEY)
    doc_id = F.when(~F.col("unknown"), F.bitwise_not(F.col("place")))
    return met.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        doc_id.alias("doc_id"), F.col("chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
