"""Chapters from captured pages, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chapter_name
from ..functions.url import canonical_url, path
from ..operators.discovery import enforce_page_cap, within_page_cap
from ..session import Stages, cut_lineage
from ..sources.markup import parse_pages
from . import capture, chapters
from .book import chapter_document


def build_chapters(
    pages: DataFrame,
    files: DataFrame,
    assets: DataFrame | None = None,
    max_pages: int | None = None,
    content_selector: str | None = None,
) -> DataFrame:
    """(site, file, page_id, html): ``pages(page_id, site, url, title, html)`` to finished documents.

    One document for each canonical address of a site, from the page with the
    least id, in the language the page states. A page whose content root is empty
    keeps an empty document; a page without a root has none. With ``max_pages``, a
    site of more canonical addresses is not built at all (``enforce_page_cap`` and
    ``check_page_cap`` say which). A ``content_selector`` names the content root of sites
    outside the usual layouts; where it matches nothing, the usual containers are looked for.

    A page stays one row from the parse on (:mod:`chapters`): its rewrites neither sort nor
    shuffle. Pages are stored after each step that asks where nodes stand, since a plan of
    all steps at once does not end, and before fragment pruning, which needs every chapter's
    ids. Each stored table replaces the one before, so two of them at most take disk. Each page is parsed once.
    """
    canonical = canonical_url("url")
    slim = pages.select("page_id", "site", "url", "title").withColumn("canonical", canonical)
    if max_pages is not None:
        over = enforce_page_cap(slim.select("site", F.col("canonical").alias("url")), max_pages)
        slim, pages = within_page_cap(slim, over), within_page_cap(pages, over)
    own = () if content_selector is None else (content_selector,)
    first = slim.groupBy("site", "canonical").agg(F.min("page_id").alias("page_id"))
    chosen = pages.join(first.select("page_id"), "page_id", "left_semi")
    parsed = parse_pages(chosen, "page_id", "html", "site", "url", "title")
    if own:
        parsed = cut_lineage(parsed)
    store = Stages(pages.sparkSession, "chapters").keep
    captured = chapters.capture_content(chapters.page_language(parsed), *own, store=store)
    structured = store(chapters.clean_structure(captured, store)).filter("rooted")
    if own:
        rooted = capture.rooted_pages(parsed.select("page_id", F.inline("rows")), *own)
        structured = structured.join(rooted, "page_id", "left_semi")
    linked = chapters.figures_and_headers(store(chapters.rewrite_links_and_images(structured, files, assets)))
    named = store(linked.withColumn("file", chapter_name(path(canonical), canonical)))
    pruned = store(chapters.prune_dangling_fragments(named, files))
    joined = pruned.withColumn("html", chapters.markup(F.col("rows")))
    document = chapter_document(F.col("title"), F.col("url"), F.col("language"), F.col("html"))
    return joined.select("site", "file", "page_id", document.alias("html"))
