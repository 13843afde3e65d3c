"""Book tables: reading order, chapters, contents, manifest, spine and package metadata.

``sites(site, base_url, title, language, name, description, author, captured_on)``,
``pages(site, url, route, title, language, ...)``, ``nav(site, url, nav_pos)``,
``images(site, name)``. Positions are distributed prefix sums, never made by putting
a whole site into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.ids import chapter_name, page_key, uuid5_url
from ..functions.media import media_type_for_file
from ..functions.text import escape_html, utc_timestamp
from ..functions.url import host
from ..operators.windows import ordinals
from ..session import cut_lineage

# The package's own entries, its accessibility statement and media types.
CONTAINER_PATH = "META-INF/container.xml"
CONTAINER = (
    '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n'
    '  <rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles>\n'
    "</container>\n"
)
MIMETYPE = "application/epub+zip"
XHTML_TYPE = "application/xhtml+xml"
FIXED_ITEMS = (
    ("cover-page", "cover.xhtml", XHTML_TYPE, ""),
    ("nav", "nav.xhtml", XHTML_TYPE, "nav"),
    ("ncx", "toc.ncx", "application/x-dtbncx+xml", ""),
    ("css", "styles/book.css", "text/css", ""),
    ("cover-image", "images/cover.jpg", "image/jpeg", "cover-image"),
)
ACCESSIBILITY = (
    ("rendition:layout", "reflowable"),
    ("schema:accessModeSufficient", "textual"),
    ("schema:accessMode", "textual"),
    ("schema:accessMode", "visual"),
    ("schema:accessibilityFeature", "alternativeText"),
    ("schema:accessibilityFeature", "readingOrder"),
    ("schema:accessibilityFeature", "tableOfContents"),
    ("schema:accessibilityHazard", "none"),
    (
        "schema:accessibilitySummary",
        "The publication has a table of contents, source links, reflowable text, and alternative text for images.",
    ),
)
LANDMARK_KINDS = ("cover", "toc", "bodymatter")
STYLES = (
    "body { line-height: 1.5; margin: 5%; }\nimg { max-width: 100%; height: auto; }\n"
    "pre { white-space: pre-wrap; overflow-wrap: anywhere; }\ntable { border-collapse: collapse; }\n"
    "th, td { border: 1px solid; padding: 0.3em; }\n.cover { text-align: center; }\n"
)
XHTML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"'


def nav_order(reading: DataFrame) -> DataFrame:
    """Add ``nav_pos`` 1..n per site to a reading list (rank, part, pos)."""
    return ordinals(reading, ["site"], "rank", "part", "pos", "url", name="nav_pos")


def reading_order(pages: DataFrame, nav: DataFrame) -> DataFrame:
    """Add ``ord`` 1..n per site: navigation order first, remaining pages by page key."""
    placed = pages.join(nav.select("site", "url", "nav_pos"), ["site", "url"], "left").withColumn("_key", page_key("url"))
    return ordinals(placed, ["site"], F.col("nav_pos").isNull(), "nav_pos", "_key", "url", name="ord").drop("_key", "nav_pos")


def chapter_files(pages: DataFrame) -> DataFrame:
    """(site, url, file) of every page."""
    return pages.select("site", "url", chapter_name("route", "url").alias("file"))


def chapters(pages: DataFrame, nav: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, ord, id, file, title, lang, url): one chapter per page in reading order.

    The rows are stored, since all tables of a book start from them.
    """
    defaults = sites.select("site", F.col("language").alias("_site_language"))
    ordered = reading_order(pages, nav).join(defaults, "site", "left")
    rows = ordered.select(
        "site",
        "ord",
        F.concat(F.lit("chapter-"), F.col("ord").cast("string")).alias("id"),
        chapter_name("route", "url").alias("file"),
        "title",
        F.coalesce(F.nullif("language", F.lit("")), "_site_language").alias("lang"),
        "url",
    )
    return cut_lineage(rows)


def chapter_document(title: Column, url: Column, lang: Column, content: Column) -> Column:
    """The chapter file as XHTML text: title, content, and where it was captured."""
    lang, title, url = escape_html(lang), escape_html(title), escape_html(url)
    head = F.concat(
        F.lit('<head><meta charset="utf-8"/><title>'), title,
        F.lit('</title><link rel="stylesheet" type="text/css" href="../styles/book.css"/></head>\n'),
    )
    origin = F.concat(F.lit('<footer class="origin"><a href="'), url, F.lit('">'), url, F.lit("</a></footer>\n"))
    return F.concat(
        F.lit(XHTML_HEAD + ' xml:lang="'), lang, F.lit('" lang="'), lang, F.lit('">\n'), head,
        F.lit("<body><article>\n<h1>"), title, F.lit("</h1>\n"), content, F.lit("\n"), origin, F.lit("</article></body>\n</html>\n"),
    )


def toc(chapters: DataFrame) -> DataFrame:
    """(site, ord, nav_item, ncx_point): one contents entry per chapter."""
    number = F.col("ord").cast("string")
    file, label = escape_html("file"), escape_html("title")
    nav_item = F.concat(F.lit('<li><a href="text/'), file, F.lit('">'), label, F.lit("</a></li>"))
    ncx_point = F.concat(
        F.lit('<navPoint id="nav-'), number, F.lit('" playOrder="'), number, F.lit('"><navLabel><text>'), label,
        F.lit('</text></navLabel><content src="text/'), file, F.lit('"/></navPoint>'),
    )
    return chapters.select("site", "ord", nav_item.alias("nav_item"), ncx_point.alias("ncx_point"))


def landmarks(chapters: DataFrame) -> DataFrame:
    """(site, kind, href, label): cover, contents and first chapter."""
    first = chapters.filter("ord = 1").select(
        "site", F.lit("bodymatter").alias("kind"), F.concat(F.lit("text/"), "file").alias("href"), F.lit("First chapter").alias("label")
    )
    fixed = chapters.filter("ord = 1").select(
        "site",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(kind).alias("kind"), F.lit(href).alias("href"), F.lit(label).alias("label"))
                    for kind, href, label in (("cover", "cover.xhtml", "Front cover"), ("toc", "nav.xhtml", "All chapters"))
                )
            )
        ),
    )
    return fixed.unionByName(first)


def manifest(chapters: DataFrame, images: DataFrame, math: DataFrame) -> DataFrame:
    """(site, part, ord, id, href, media_type, properties): fixed items, chapters, images.

    ``math(site, url)`` lists the chapters with formulas. The cover counts in
    image numbering but has its own fixed item.
    """
    fixed_items = F.array(
        *(
            F.struct(
                F.lit(0).alias("part"), F.lit(n).cast("long").alias("ord"), F.lit(id_).alias("id"),
                F.lit(href).alias("href"), F.lit(kind).alias("media_type"), F.lit(properties).alias("properties"),
            )
            for n, (id_, href, kind, properties) in enumerate(FIXED_ITEMS, 1)
        )
    )
    fixed = chapters.filter("ord = 1").select("site", F.inline(fixed_items))
    with_math = chapters.join(math.select("site", "url", F.lit(True).alias("_math")).distinct(), ["site", "url"], "left")
    listed = with_math.select(
        "site",
        F.lit(1).alias("part"),
        "ord",
        "id",
        F.concat(F.lit("text/"), "file").alias("href"),
        F.lit(XHTML_TYPE).alias("media_type"),
        F.when(F.col("_math"), "mathml").otherwise("").alias("properties"),
    )
    named = images.select("site", "name").union(
        chapters.filter("ord = 1").select("site", F.lit("cover.jpg").alias("name"))
    ).distinct()
    numbered = ordinals(named, ["site"], "name", name="ord")
    assets = numbered.filter("name <> 'cover.jpg'").select(
        "site",
        F.lit(2).alias("part"),
        "ord",
        F.concat(F.lit("asset-"), F.col("ord").cast("string")).alias("id"),
        F.concat(F.lit("images/"), "name").alias("href"),
        media_type_for_file("name").alias("media_type"),
        F.lit("").alias("properties"),
    )
    return fixed.unionByName(listed).unionByName(assets)


def spine(chapters: DataFrame) -> DataFrame:
    """(site, ord, idref, linear): cover, contents out of line, chapters in order."""
    fixed = chapters.filter("ord = 1").select(
        "site",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(n).cast("long").alias("ord"), F.lit(idref).alias("idref"), F.lit(linear).alias("linear"))
                    for n, idref, linear in ((-1, "cover-page", True), (0, "nav", False))
                )
            )
        ),
    )
    return fixed.unionByName(
        chapters.select("site", "ord", F.col("id").alias("idref"), F.lit(True).alias("linear"))
    )


def package_metadata(sites: DataFrame, modified: Column | None = None) -> DataFrame:
    """One row per site with the values of the package document's metadata."""
    publisher = F.coalesce(F.nullif("name", F.lit("")), host("base_url"))
    return sites.select(
        "site",
        F.concat(F.lit("urn:uuid:"), uuid5_url("base_url")).alias("identifier"),
        "title",
        "language",
        F.col("base_url").alias("source"),
        publisher.alias("publisher"),
        F.coalesce(F.nullif("author", F.lit("")), publisher).alias("creator"),
        F.nullif("description", F.lit("")).alias("description"),
        F.nullif("captured_on", F.lit("")).alias("date"),
        F.lit("Documentation").alias("subject"),
        F.lit(f"quireflow {__version__}").alias("contributor"),
        (utc_timestamp() if modified is None else modified).alias("modified"),
    )


def accessibility(sites: DataFrame) -> DataFrame:
    """(site, n, property, value): accessibility statement, the same for every book."""
    entries = F.array(
        *(
            F.struct(F.lit(n).alias("n"), F.lit(name).alias("property"), F.lit(value).alias("value"))
            for n, (name, value) in enumerate(ACCESSIBILITY, 1)
        )
    )
    return sites.select("site", F.inline(entries))


def book_summary(chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """(site, chapters, assets)."""
    counted = chapters.groupBy("site").agg(F.count("*").alias("chapters"))
    images = assets.groupBy("site").agg(F.count_distinct("name").alias("assets"))
    return counted.join(images, "site", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))


def text_parts(df: DataFrame, path: str, part: Column, text: Column) -> DataFrame:
    return df.select(F.col("site").alias("book"), F.lit(path).alias("path"), part.cast("long").alias("part"), text.alias("data"))


def book_files(
    tables: dict[str, DataFrame], documents: DataFrame, images: DataFrame, styles: str = STYLES
) -> DataFrame:
    """(book, path, part, data): every file of every book as ordered fragments.

    ``documents(site, file, html)`` are finished chapters and ``images(site,
    name, data)`` the pictures, cover.jpg among them. Contents, package and NCX
    are emitted one entry per row, so a long book is never one value.
    """
    end = F.lit(1 << 40)
    meta = tables["metadata"]
    lang, title = escape_html("language"), escape_html("title")
    opened = F.concat(
        F.lit(XHTML_HEAD + ' xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="'), lang, F.lit('" lang="'), lang, F.lit('">\n')
    )
    linked = '</title><link rel="stylesheet" type="text/css" href="styles/book.css"/></head>\n'
    landmark = F.concat(
        F.lit('<li><a epub:type="'), F.col("kind"), F.lit('" href="'), escape_html("href"), F.lit('">'), escape_html("label"), F.lit("</a></li>\n")
    )
    landmark_place = F.array_position(F.array(*map(F.lit, LANDMARK_KINDS)), F.col("kind"))
    ncx_head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="'),
        lang, F.lit('">\n<head><meta name="dtb:uid" content="'), F.col("identifier"), F.lit('"/></head><docTitle><text>'), title,
        F.lit("</text></docTitle><navMap>"),
    )
    element = lambda name, value: F.concat(F.lit(f"  <dc:{name}>"), escape_html(value), F.lit(f"</dc:{name}>\n"))
    package_head = F.concat_ws(
        "",
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book-id" xml:lang="'),
        lang, F.lit('" prefix="schema: http://schema.org/">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n'),
        F.lit('  <dc:identifier id="book-id">'), F.col("identifier"), F.lit("</dc:identifier>\n"),
        *(element(name, name) for name in ("title", "language", "source", "publisher", "creator", "description", "date", "subject")),
        F.lit('  <dc:contributor id="producer">'), escape_html("contributor"),
        F.lit('</dc:contributor>\n  <meta refines="#producer" property="role" scheme="marc:relators">bkp</meta>\n'),
        F.lit('  <meta property="dcterms:modified">'), F.col("modified"), F.lit("</meta>\n"),
        *(F.lit(f'  <meta property="{name}">{value}</meta>\n') for name, value in ACCESSIBILITY),
        F.lit("</metadata>\n<manifest>"),
    )
    item = F.concat(
        F.lit('<item id="'), F.col("id"), F.lit('" href="'), escape_html("href"), F.lit('" media-type="'), F.col("media_type"),
        F.when(F.col("properties") == "", '"/>').otherwise(F.concat(F.lit('" properties="'), F.col("properties"), F.lit('"/>'))),
    )
    itemref = F.concat(
        F.lit('\n<itemref idref="'), F.col("idref"), F.when(F.col("linear"), '"/>').otherwise('" linear="no"/>')
    )
    package = "EPUB/package.opf"
    parts = (
        text_parts(meta, "mimetype", F.lit(0), F.lit(MIMETYPE)),
        text_parts(meta, CONTAINER_PATH, F.lit(0), F.lit(CONTAINER)),
        text_parts(meta, "EPUB/styles/book.css", F.lit(0), F.lit(styles)),
        text_parts(
            meta, "EPUB/cover.xhtml", F.lit(0),
            F.concat(opened, F.lit("<head><title>"), title, F.lit(linked + '<body><section class="cover" epub:type="cover"><img src="images/cover.jpg" alt="Cover for '), title, F.lit('"/></section></body>\n</html>\n')),
        ),
        text_parts(
            meta, "EPUB/nav.xhtml", F.lit(0),
            F.concat(opened, F.lit("<head><title>Contents" + linked + '<body><nav epub:type="toc" id="toc"><h1>Contents</h1><ol>')),
        ),
        text_parts(tables["toc"], "EPUB/nav.xhtml", F.col("ord"), F.concat("nav_item", F.lit("\n"))),
        text_parts(meta, "EPUB/nav.xhtml", end, F.lit('</ol></nav>\n<nav epub:type="landmarks" hidden="hidden"><ol>\n')),
        text_parts(tables["landmarks"], "EPUB/nav.xhtml", end + landmark_place, landmark),
        text_parts(meta, "EPUB/nav.xhtml", end * 2, F.lit("</ol></nav></body>\n</html>\n")),
        text_parts(meta, "EPUB/toc.ncx", F.lit(0), ncx_head),
        text_parts(tables["toc"], "EPUB/toc.ncx", F.col("ord"), F.concat("ncx_point", F.lit("\n"))),
        text_parts(meta, "EPUB/toc.ncx", end, F.lit("</navMap>\n</ncx>\n")),
        text_parts(meta, package, F.lit(0), package_head),
        text_parts(tables["manifest"], package, F.col("part") * F.lit(1 << 38) + F.col("ord"), item),
        text_parts(meta, package, end, F.lit('</manifest>\n<spine toc="ncx">')),
        text_parts(tables["spine"], package, end + 2 + F.col("ord"), itemref),
        text_parts(meta, package, end * 2, F.lit("</spine>\n</package>\n")),
    )
    chapters_out = documents.select(
        F.col("site").alias("book"), F.concat(F.lit("EPUB/text/"), "file").alias("path"), F.lit(0).cast("long").alias("part"), F.col("html").alias("data")
    )
    texts = parts[0]
    for part in (*parts[1:], chapters_out):
        texts = texts.unionByName(part)
    pictures = images.select(
        F.col("site").alias("book"), F.concat(F.lit("EPUB/images/"), "name").alias("path"), F.lit(0).cast("long").alias("part"), F.col("data").cast("binary").alias("data")
    )
    return texts.withColumn("data", F.encode("data", "UTF-8")).unionByName(pictures)


def book_tables(
    pages: DataFrame, nav: DataFrame, sites: DataFrame, images: DataFrame, math: DataFrame
) -> dict[str, DataFrame]:
    chapter_rows = chapters(pages, nav, sites)
    return {
        "chapters": chapter_rows,
        "toc": toc(chapter_rows),
        "landmarks": landmarks(chapter_rows),
        "manifest": manifest(chapter_rows, images, math),
        "spine": spine(chapter_rows),
        "metadata": package_metadata(sites),
        "summary": book_summary(chapter_rows, images),
    }
