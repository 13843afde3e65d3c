"""Capture summary per host: what was captured, and where its links lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import canonical_url, host, url_join
from ..operators.windows import first_wins

HREF = 'href="([^"]*)"'
LANGUAGE = '<html lang="([^"]*)'


def capture_summary(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to one row per host.

    The page text is read once and reduced to link lists before any shuffle.
    Links are counted per (host, target) first, so a link repeated on every page
    of a large host is one row per task when it meets the page table.
    """
    reduced = pages.select(
        "page_id",
        "url",
        canonical_url("url").alias("canonical"),
        host("url").alias("host"),
        F.regexp_extract("html", LANGUAGE, 1).alias("lang"),
        F.regexp_extract_all("html", F.lit(HREF), F.lit(1)).alias("refs"),
    )
    kept = first_wins(reduced.drop("lang"), ["host", "canonical"], "page_id")
    links = kept.select("host", "url", F.explode("refs").alias("ref")).select(
        "host", url_join("url", "ref").alias("href")
    )
    targets = links.groupBy("host", "href").agg(F.count("*").alias("n"))
    aimed = targets.select(
        "host", "n", (host("href") == F.col("host")).alias("is_internal"), canonical_url("href").alias("canonical")
    )
    known = kept.select("host", "canonical", F.lit(True).alias("known"))
    link_counts = (
        aimed.join(known, ["host", "canonical"], "left")
        .groupBy("host")
        .agg(
            F.sum("n").alias("links"),
            F.sum(F.when(F.col("is_internal"), F.col("n")).otherwise(0)).alias("internal_links"),
            F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("resolved"),
        )
    )
    page_counts = reduced.groupBy("host").agg(
        F.count("*").alias("captures"),
        F.count_distinct("canonical").alias("pages"),
        F.count_distinct("lang").alias("languages"),
    )
    zero = lambda column: F.coalesce(column, F.lit(0)).cast("long")
    return page_counts.join(link_counts, "host", "left").select(
        "host",
        "captures",
        "pages",
        "languages",
        zero(F.col("links")).alias("links"),
        zero(F.col("internal_links")).alias("internal_links"),
        zero(F.col("internal_links") - F.col("resolved")).alias("broken_links"),
    )
