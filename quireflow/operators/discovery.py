"""Finding pages: scope, discovery order, aliases, provenance and increments.

Tables: ``sitemap(site, pos, url)``, ``nav(site, pos, title, url)``,
``bases(site, url)``, ``landed(site, url, landed)``, ``pages(site, url, ...)``.
All keys are (site, url), never the site alone, so one large site is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..functions.url import canonical_url, in_scope
from ..schema import DEFAULT_MAX_PAGES
from .windows import first_wins


def filter_in_scope(df: DataFrame, url: Column | str, base: Column | str) -> DataFrame:
    return df.filter(in_scope(url, base))


def filter_nav_links(links: DataFrame, base: str = "base") -> DataFrame:
    """Navigation links with a title, in scope, by canonical URL; first title wins."""
    kept = links.withColumn("title", strip_ws("title")).filter((F.col("title") != "") & in_scope("href", base))
    canonical = kept.withColumn("url", canonical_url("href")).drop("href")
    return first_wins(canonical, ["site", "url"], "pos")


def sitemap_pages(locations: DataFrame, bases: DataFrame) -> DataFrame:
    """In-scope sitemap locations as canonical URLs, first position kept."""
    scoped = locations.join(bases.withColumnRenamed("url", "base"), "site")
    kept = scoped.filter((F.col("loc") != "") & in_scope("loc", "base"))
    return first_wins(kept.select("site", canonical_url("loc").alias("url"), "pos"), ["site", "url"], "pos")


def discover(bases: DataFrame, nav: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(site, url, rank, pos): base first, then navigation, then sitemap; first occurrence wins."""
    parts = (
        bases.select("site", "url", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("pos")),
        nav.select("site", "url", F.lit(1).alias("rank"), F.col("pos").cast("long").alias("pos")),
        sitemap.select("site", "url", F.lit(2).alias("rank"), F.col("pos").cast("long").alias("pos")),
    )
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return first_wins(found, ["site", "url"], "rank", "pos")


def enforce_page_cap(urls: DataFrame, max_pages: int = DEFAULT_MAX_PAGES) -> DataFrame:
    """Sites over the cap, with the message the capture stops with."""
    counts = urls.groupBy("site").agg(F.count_distinct("url").alias("discovered"))
    message = F.format_string("Discovered %d pages, above --max-pages %d.", F.col("discovered"), F.lit(max_pages))
    return counts.filter(F.col("discovered") > max_pages).withColumn("message", message)


def within_page_cap(pages: DataFrame, over: DataFrame) -> DataFrame:
    """Rows of the sites that the cap does not stop; ``over`` is one row per stopped site."""
    return pages.join(over.select("site"), "site", "left_anti")


def resolve_alias(urls: DataFrame, landed: DataFrame) -> DataFrame:
    """Replace each URL by the one it landed on; others stay. Keeps the alias as ``alias``."""
    targets = landed.select("site", "url", "landed")
    return (
        urls.join(targets, ["site", "url"], "left")
        .withColumn("alias", F.col("url"))
        .withColumn("url", F.coalesce("landed", "url"))
        .drop("landed")
    )


def captured_nav(nav: DataFrame, discovered: DataFrame, landed: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, url, title, rank, pos): the site's reading list of captured pages.

    Navigation links come first with their own titles, then everything else
    that was discovered with its page title.
    """
    links = resolve_alias(nav, landed).select(
        "site", "url", "title", F.lit(0).alias("rank"), F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos")
    )
    rest = resolve_alias(discovered, landed).select(
        "site",
        "url",
        F.lit(None).cast("string").alias("title"),
        F.lit(1).alias("rank"),
        F.col("rank").alias("part"),
        F.col("pos").cast("long").alias("pos"),
    )
    first = first_wins(links.unionByName(rest), ["site", "url"], "rank", "part", "pos")
    titles = pages.select("site", "url", F.col("title").alias("page_title"))
    return first.join(titles, ["site", "url"]).withColumn("title", F.coalesce("title", "page_title")).drop("page_title")


def not_captured(urls: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    return urls if force else urls.join(pages.select("site", "url"), ["site", "url"], "left_anti")


def provenance(pages: DataFrame, sitemap: DataFrame, nav: DataFrame, bases: DataFrame) -> DataFrame:
    """Add ``discovered_from``: sitemap and navigation membership, else entrypoint."""
    in_sitemap = sitemap.select("site", "url").distinct().withColumn("_sitemap", F.lit("sitemap"))
    in_nav = nav.select("site", "url").union(bases.select("site", "url")).distinct().withColumn(
        "_nav", F.lit("navigation")
    )
    tagged = pages.join(in_sitemap, ["site", "url"], "left").join(in_nav, ["site", "url"], "left")
    found = F.array_compact(F.array("_sitemap", "_nav"))
    return tagged.withColumn(
        "discovered_from", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("entrypoint")))
    ).drop("_sitemap", "_nav")


def provenance_histogram(pages: DataFrame) -> DataFrame:
    """(site, source, pages) with totals per site and overall (nulls)."""
    return (
        pages.select("site", F.explode("discovered_from").alias("source"))
        .rollup("site", "source")
        .agg(F.count("*").alias("pages"))
    )


def site_urls(pages: DataFrame) -> DataFrame:
    """Distinct captured URLs, sorted within the whole table rather than per task."""
    return pages.select("site", "url").distinct().orderBy("site", "url")


def expected_urls(sitemap: DataFrame, nav: DataFrame) -> DataFrame:
    return sitemap.select("site", "url").union(nav.select("site", "url")).filter("url IS NOT NULL").distinct()


def missing_pages(expected: DataFrame, pages: DataFrame) -> DataFrame:
    return expected.join(pages.select("site", "url"), ["site", "url"], "left_anti")


def expected_minus_captured(expected: DataFrame, pages: DataFrame) -> DataFrame:
    return expected.select("site", "url").subtract(pages.select("site", "url"))


def incremental_capture(new: DataFrame, existing: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """Pages to store from a new crawl ``(site, url, pos, ...)``, under the URL they landed on.

    Known URLs are skipped before anything is parsed, and several aliases of one
    page are stored once.
    """
    fresh = resolve_alias(not_captured(new, existing, force), landed)
    return first_wins(not_captured(fresh, existing, force), ["site", "url"], "pos")


def content_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(site, url, change): added, removed or changed between two captures, by content hash."""
    before = old.select("site", "url", F.col("content_hash").alias("_old"))
    after = new.select("site", "url", F.col("content_hash").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    )
    joined = before.join(after, ["site", "url"], "full_outer")
    return joined.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("site", "url", change.alias("change"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one but not the other, with ``side``; empty when the sets agree."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(
        b.subtract(a).withColumn("side", F.lit("right"))
    )
