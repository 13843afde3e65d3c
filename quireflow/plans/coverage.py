"""Text coverage: which source lines occur in a site's chapters.

A line is covered when it is a substring of the site's chapter texts joined by
single spaces in file order, so it may begin or end inside a word and may run
over a chapter boundary. Nothing here collects
a site or compares every line with every text:

1. The joined text is cut into overlapping blocks of fixed size, each block
   reaching a fixed piece past its end, however long the lines are.
2. Each distinct line is one piece, or several if it is longer than a piece. A piece names
   one window: up to 256 of its bytes behind its first space, whose hash is its key.
3. Each block gives the keys of its windows that a fixed-size bitmap of the lines' keys may hold.
   A bitmap of what the blocks gave in turn keeps the lines that stand nowhere in their task.
4. Lines meet the blocks that have their window. There they are compared byte by byte,
   at the places of the window only, and a block gives a line once: what lines that begin
   alike cost follows the blocks that have their beginning, not the places.
5. The pieces of a longer line give each place where the line would start, and a
   start that all of them give is an occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_words, starts_with_any, strip_bullet, strip_markdown, strip_ws
from ..operators.occurrences import SHIFTS, SOUGHT, STANDING, standing_pieces, text_keys, window_key
from ..operators.windows import fence_state, prefix_sums
from ..session import cut_lineage
from .checks import finding

# Which source lines count, and the share of them that must be found.
MIN_LINE_BYTES = 40
SKIPPED_STARTS = ("#", "|", "![", "<")
COVERAGE_THRESHOLD = 0.9

BLOCK_CHARS = 1 << 21
LINE_PIECE_CHARS = 1 << 17
WINDOW_BYTES = 256
TASK_BLOCKS = 2
# The bitmap of keys: 2**27 bits in rows of 512 longs, 16 MB whatever the number of keys.
KEY_BITS = 1 << 27
ROW_BITS = 1 << 15


def split_lines(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, line) of every text."""
    exploded = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return exploded.withColumn("line_no", F.col("line_no").cast("long"))


def eligible_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines outside code fences, long enough, and not headings, tables, images or markup."""
    stated = fence_state(lines, list(keys)).filter("NOT is_fence AND NOT in_code").drop("is_fence", "in_code")
    stripped = _once(stated, "_stripped", strip_ws("line"))
    line = F.col("_stripped")
    return stripped.filter((F.octet_length(line) >= MIN_LINE_BYTES) & ~starts_with_any(line, SKIPPED_STARTS)).drop("_stripped")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose value later filters and columns read, where the planner would write its expression into each of them."""
    rest = [column for column in df.columns if column != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name)).select(*(df.columns if name in df.columns else [*rest, name]))


def source_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Eligible lines in comparable form, as ``line``; empty ones are left out."""
    plain = _once(eligible_lines(lines, *keys), "line", strip_bullet(strip_ws("line")))
    plain = _once(plain, "line", strip_markdown("line"))
    return _once(plain, "line", normalize_words("line")).filter("line <> ''")


def text_blocks(chapters: DataFrame, block: int, overlap: int) -> DataFrame:
    """(site, block, text) of ``chapters(site, file, text)`` joined by spaces in file order; of one name, in any order."""
    chapters = cut_lineage(chapters.withColumn("chapter", F.monotonically_increasing_id()))
    sized = chapters.select("site", "file", "chapter", (F.length("text") + 1).cast("long").alias("size"))
    offsets = prefix_sums(sized, ["site"], ["file", "chapter"], F.col("size"), "offset").drop("file")
    placed = chapters.join(offsets, ["site", "chapter"])
    first = F.greatest(F.floor((F.col("offset") - overlap) / block), F.lit(0))
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    spread = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("offset"), F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * block + (block + overlap))
    piece = F.substr(
        F.concat("text", F.lit(" ")), (start - F.col("offset") + 1).cast("int"), (end - start).cast("int")
    )
    pieces = spread.filter(end > start).select("site", "block", F.struct(start.alias("start"), piece.alias("text")).alias("piece"))
    return pieces.groupBy("site", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), "").alias("text")
    )


def line_windows(lines: DataFrame, piece: int = LINE_PIECE_CHARS) -> DataFrame:
    """(site, id, n, pieces, text, before, behind_space, width, key): the pieces of each line, each with its window.

    A window begins behind the first space of a piece, as words are fewer than characters, or
    where most of the piece is one word, at its start. It is as wide as the largest power of
    two that the piece holds, up to ``WINDOW_BYTES``; ``before`` counts the bytes ahead of it.
    """
    pieces = F.ceil(F.length("line") / piece).cast("int")
    numbered = lines.withColumn("id", F.monotonically_increasing_id()).withColumn("pieces", pieces).filter("pieces > 0")
    parted = numbered.select("site", "id", "pieces", "line", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("n"))
    text = F.when(F.col("pieces") == 1, F.col("line")).otherwise(F.substr("line", F.col("n") * piece + 1, F.lit(piece)))
    size, first_word = F.octet_length("text"), F.octet_length(F.substring_index("text", " ", 1)) + 1
    behind_space = 2 * first_word <= size
    held = F.length(F.bin((F.least(size - F.col("before"), F.lit(WINDOW_BYTES))).cast("long"))) - 1
    return (
        parted.select("site", "id", "n", "pieces", text.alias("text"))
        .withColumn("behind_space", behind_space)
        .withColumn("before", F.when(F.col("behind_space"), first_word).otherwise(0))
        .withColumn("width", F.call_function("shiftleft", F.lit(1), held))
        .withColumn("key", window_key(F.substring(F.col("text").cast("binary"), F.col("before") + 1, F.col("width"))))
    )


def key_bitmap(keys: DataFrame) -> DataFrame:
    """(row, bits): a bitmap of the hashes in ``keys(key)``, 4,096 rows of 4 KB."""
    bit = F.pmod("key", F.lit(KEY_BITS))
    within = bit % ROW_BITS
    longs = keys.select(
        F.floor(bit / ROW_BITS).alias("row"), F.floor(within / 64).cast("int").alias("at"), (within % 64).cast("int").alias("bit")
    )
    filled = longs.distinct().select("row", "at", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("long"))
    # every long has a row, so that the sorted list of a row's longs is dense
    empty = keys.sparkSession.range(KEY_BITS // 64).select(
        F.floor(F.col("id") * 64 / ROW_BITS).alias("row"), (F.col("id") % (ROW_BITS // 64)).cast("int").alias("at"), F.lit(0).cast("long").alias("long")
    )
    whole = filled.unionByName(empty).groupBy("row", "at").agg(F.bit_or("long").alias("long"))
    dense = F.transform(F.array_sort(F.collect_list(F.struct("at", "long"))), lambda held: held["long"])
    return whole.groupBy("row").agg(dense.alias("bits"))


def in_bitmap(places: DataFrame, bitmap: DataFrame) -> DataFrame:
    """Rows of ``places(key, …)`` whose key may be one of the bitmap's; none that is one is lost."""
    bit = F.pmod("key", F.lit(KEY_BITS))
    within = bit % ROW_BITS
    held = F.getbit(F.get("bits", F.floor(within / 64).cast("int")), (within % 64).cast("int")) == 1
    met = places.withColumn("row", F.floor(bit / ROW_BITS)).join(F.broadcast(bitmap), "row")
    return met.filter(held).select(*places.columns)


def _collected(bitmap: DataFrame) -> np.ndarray:
    """The longs of a bitmap, 16 MB whatever the number of keys."""
    longs = np.zeros((KEY_BITS // ROW_BITS, ROW_BITS // 64), dtype=np.int64)
    for row, bits in bitmap.toLocalIterator():
        longs[row] = bits
    return longs.ravel()


def covered_lines(lines: DataFrame, chapters: DataFrame, block: int = BLOCK_CHARS, piece: int = LINE_PIECE_CHARS) -> DataFrame:
    """Distinct (site, line) of ``lines(site, line)`` that occur in ``chapters(site, file, text)``."""
    spark = lines.sparkSession
    # Both sides are used more than once below; storing them keeps the parse and
    # the normalising out of every use, and the ids as they are.
    wanted = cut_lineage(line_windows(lines.select("site", "line").distinct(), piece))
    blocks = cut_lineage(text_blocks(chapters, block, piece))
    # At most 18 kinds of windows.
    kinds = sorted(tuple(kind) for kind in wanted.select("behind_space", "width").distinct().collect())
    # several bits of each key, or what passes by chance grows with the lines times the text
    marks = wanted.select(F.explode(F.array(*(F.shiftrightunsigned("key", shift) for shift in SHIFTS))).alias("key"))
    bitmap = spark.sparkContext.broadcast(_collected(key_bitmap(marks)))
    present = cut_lineage(blocks.select("site", "block", F.explode(text_keys(kinds, bitmap)("text")).alias("key")))
    # only lines whose window stands somewhere leave their task, and only for the blocks that have it
    sought = in_bitmap(wanted, key_bitmap(present.select("key"))).join(present, ["site", "key"]).select(*SOUGHT)
    rows = blocks.unionByName(sought, allowMissingColumns=True).select(*SOUGHT)
    tasks = max(spark.sparkContext.defaultParallelism, blocks.count() // TASK_BLOCKS)
    dealt = rows.repartition(tasks, "site", "block").sortWithinPartitions("site", "block", F.col("id").asc_nulls_first())
    found = cut_lineage(dealt.mapInArrow(standing_pieces(block, piece), STANDING).distinct())
    covered = found.filter("pieces = 1").select("site", "line")
    # of a longer line, all pieces stand one behind the other
    started = found.filter("pieces > 1").groupBy("id", "start", "pieces").agg(F.count("*").alias("standing"))
    whole = started.filter("standing = pieces").select("id").distinct()
    parts = wanted.filter("pieces > 1").join(whole, "id", "left_semi").groupBy("site", "id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("parts"))
    return covered.unionByName(parts.select("site", F.array_join("parts.text", "").alias("line")))


def missing_lines(lines: DataFrame, chapters: DataFrame, block: int = BLOCK_CHARS, piece: int = LINE_PIECE_CHARS) -> DataFrame:
    """Rows of ``lines`` whose line occurs nowhere in the site's chapters; repeats are kept."""
    return lines.join(covered_lines(lines, chapters, block, piece), ["site", "line"], "left_anti")


def coverage_ratio(lines: DataFrame, missing: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site, checked, missing, coverage); repeated lines count each time.

    Of ``sites(site)``, those without a line are covered in full.
    """
    checked = lines.groupBy("site").agg(F.count("*").alias("checked"))
    absent = missing.groupBy("site").agg(F.count("*").alias("missing"))
    if sites is not None:
        checked = sites.select("site").distinct().join(checked, "site", "left").fillna(0, ["checked"])
    joined = checked.join(absent, "site", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return joined.withColumn(
        "coverage", F.when(F.col("checked") > 0, 1.0 - F.col("missing") / F.col("checked")).otherwise(1.0)
    )


def check_text_coverage(coverage: DataFrame) -> DataFrame:
    """Findings for sites whose coverage is below the threshold."""
    message = F.concat(
        F.lit("Text coverage is "),
        F.format_string("%.1f", F.col("coverage") * 100),
        F.lit("%; expected at least 90%."),
    )
    return coverage.filter(F.col("coverage") < COVERAGE_THRESHOLD).select(
        "site", *finding("COVERAGE_TEXT_BELOW_THRESHOLD", message)
    )
