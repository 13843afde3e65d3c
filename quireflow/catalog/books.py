"""Links, book tables, checks, sources and sinks, colours and the capture stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import chapter_name
from ..functions.url import canonical_url, path
from ..operators import colors
from ..operators import tree as t
from ..operators.windows import ordinals
from ..plans import book, checks, clean
from ..session import cut_lineage, scratch_folder
from ..sources import archives, markup, sinks, tables
from . import inputs as i
from . import oracle as o
from .inputs import attr_sql, below
from .registry import ORACLES, QUERIES, query, table
from .rewrites import HEADINGS_SQL, LINKS_SQL, POLICY_SQL, RICH_URL, pos
from .sites import CAP, DISCOVERED, LANG, NAV_SQL, STORED, bases, cap, derived, reading_list

FILE_SQL = o.chapter_name(o.part("url", "path"), "url")


def _alias(key: str, same_as: str) -> None:
    """The survey lists some operators twice; both names run the one query."""
    QUERIES[key] = QUERIES[same_as]
    ORACLES[key] = ORACLES[same_as]


_alias("d13_normalize_headings", "w02_normalize_headings")
_alias("d15_unique_ids", "w04_unique_ids")

# ---- links -----------------------------------------------------------------

FILES_SQL = f"files AS MATERIALIZED (SELECT DISTINCT {i.SITE} AS site, {o.canonical('url')} AS url, {o.chapter_name(o.part(o.canonical('url'), 'path'), o.canonical('url'))} AS file FROM pages)"
RESOLVED_SQL = f"""absolutes AS MATERIALIZED (SELECT *, {POLICY_SQL} AS policy, {o.join('url', 'href')} AS absolute FROM links),
  resolved AS MATERIALIZED (SELECT a.page_id, a.site, a.pos, a.url, CASE WHEN policy IN ('none', 'keep') THEN href WHEN policy = 'unwrap' THEN NULL
    WHEN policy = 'own' THEN '#' || {o.xml_id('substr(href, 2)')} WHEN f.file IS NOT NULL THEN f.file || CASE WHEN contains(absolute, '#') AND NOT ends_with(absolute, '#')
      THEN '#' || {o.xml_id("substr(absolute, strpos(absolute, '#') + 1)")} ELSE '' END ELSE absolute END AS new_href
    FROM absolutes a LEFT JOIN files f ON f.site = a.site AND a.policy = 'resolve' AND f.url = {o.canonical('a.absolute')})"""
LINK_PREFIX = f"{RICH_URL}, {LINKS_SQL}, {FILES_SQL}, {RESOLVED_SQL}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    known = i.pages(spark, folder).select("site", canonical_url("url").alias("url")).distinct()
    return known.select("site", "url", chapter_name(path("url"), "url").alias("file"))


@query("j05_resolve_links", f"{LINK_PREFIX} SELECT page_id, pos, new_href FROM resolved")
def j05(spark: SparkSession, folder: str) -> DataFrame:
    links = clean.link_rows(i.rich_nodes(spark, folder, "site", "url"), "site", "url")
    return clean.resolve_links(links, files(spark, folder)).select("page_id", pos("node_id").alias("pos"), "new_href")


@query("d16_rewrite_links", f"{LINK_PREFIX} SELECT page_id, pos, new_href AS href FROM resolved WHERE new_href IS NOT NULL")
def d16(spark: SparkSession, folder: str) -> DataFrame:
    nodes = i.rich_nodes(spark, folder, "site", "url")
    made = clean.rewrite_links(nodes, files(spark, folder)).filter((F.col("tag") == "a") & (t.attr("href") != ""))
    return made.select("page_id", pos().alias("pos"), t.attr("href").alias("href"))


PRUNED_SQL = f"""ids AS MATERIALIZED (SELECT DISTINCT site, {o.chapter_name(o.part(o.canonical('url'), 'path'), o.canonical('url'))} AS file, {attr_sql('id')} AS id FROM nodes WHERE {attr_sql('id')} IS NOT NULL),
  held AS (SELECT r.*, {o.chapter_name(o.part(o.canonical('url'), 'path'), o.canonical('url'))} AS own FROM resolved r WHERE new_href IS NOT NULL),
  aimed AS (SELECT h.*, contains(new_href, '#') AND {o.part('new_href', 'scheme')} = '' AS local, CASE WHEN starts_with(new_href, '#') THEN own ELSE split_part(new_href, '#', 1) END AS target,
    substr(new_href, strpos(new_href, '#') + 1) AS fragment FROM held h),
  judged AS (SELECT a.*, local AND EXISTS (SELECT 1 FROM files f WHERE f.site = a.site AND f.file = a.target)
    AND NOT EXISTS (SELECT 1 FROM ids d WHERE d.site = a.site AND d.file = a.target AND d.id = a.fragment) AS dangling FROM aimed a),
  pruned AS MATERIALIZED (SELECT page_id, site, pos, url, own, CASE WHEN NOT dangling THEN new_href WHEN NOT starts_with(new_href, '#') THEN target END AS final FROM judged)"""


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    nodes = i.rich_nodes(spark, folder, "site", "url")
    made = clean.rewrite_links(nodes, files(spark, folder))
    named = made.withColumn("file", chapter_name(path(canonical_url("url")), canonical_url("url")))
    return cut_lineage(named)


@query("j07_prune_fragments", f"{LINK_PREFIX}, {PRUNED_SQL} SELECT page_id, pos, final FROM pruned")
def j07(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _linked(spark, folder)
    links = clean.link_rows(nodes, "site", "file")
    found = clean.prune_fragments(links, clean.chapter_ids(nodes), files(spark, folder))
    return found.select("page_id", pos("node_id").alias("pos"), F.col("new_href").alias("final"))


@query(
    "d19_prune_dangling_fragments",
    f"{LINK_PREFIX}, {PRUNED_SQL} SELECT page_id, pos, final AS href FROM pruned WHERE final IS NOT NULL",
)
def d19(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.prune_dangling_fragments(_linked(spark, folder), files(spark, folder))
    return made.filter((F.col("tag") == "a") & (t.attr("href") != "")).select(
        "page_id", pos().alias("pos"), t.attr("href").alias("href")
    )


@query(
    "j16_dangling_targets",
    f"{LINK_PREFIX}, {PRUNED_SQL} SELECT a.site, a.target AS file, a.fragment FROM aimed a WHERE local AND NOT EXISTS (SELECT 1 FROM ids d WHERE d.site = a.site AND d.file = a.target AND d.id = a.fragment)",
)
def j16(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _linked(spark, folder)
    links = clean.link_rows(nodes, "site", "file").filter(F.col("href").contains("#") & ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    target = F.when(F.col("href").startswith("#"), F.col("file")).otherwise(F.substring_index("href", "#", 1))
    aimed = links.select("site", target.alias("file"), F.regexp_extract("href", "#(.*)$", 1).alias("fragment"))
    return checks.dangling_targets(aimed, clean.chapter_ids(nodes))


# ---- book tables -----------------------------------------------------------

PAGES_SQL = f"""book_pages AS MATERIALIZED (SELECT site, url, title, CASE WHEN page_id % 4 = 0 THEN '' ELSE {LANG} END AS language, html, page_id FROM captured),
  ordered_nav AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY rank, part, pos, url) AS nav_pos FROM reading),
  chapters AS MATERIALIZED (SELECT p.site, row_number() OVER (PARTITION BY p.site ORDER BY n.nav_pos NULLS LAST, left(sha256(p.url), 16), p.url) AS ord, p.url, p.title, p.page_id,
    {o.chapter_name(o.part('p.url', 'path'), 'p.url')} AS file, CASE WHEN p.language = '' THEN 'en-' || p.site ELSE p.language END AS lang
    FROM book_pages p LEFT JOIN ordered_nav n ON n.site = p.site AND n.url = p.url)"""
BOOK = f"{STORED}, {DISCOVERED}, {NAV_SQL}, {PAGES_SQL}"
SITE_COLUMNS = (
    "site",
    "url AS base_url",
    "concat('Docs & ', site) AS title",
    "concat('en-', site) AS language",
    "CASE WHEN site = 'com' THEN '' ELSE concat('Name ', site) END AS name",
    "CASE WHEN site = 'net' THEN '' ELSE concat('About <', site, '>') END AS description",
    "CASE WHEN site = 'org' THEN 'A. Writer' ELSE '' END AS author",
    "'2024-05-06' AS captured_on",
)
SITES_SQL = f"sites AS (SELECT {', '.join(SITE_COLUMNS)} FROM bases)"
IMAGE_NAME = "concat('i', page_id % 40, CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.dat' END)"


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return bases(spark, folder).selectExpr(*SITE_COLUMNS)


def book_pages(spark: SparkSession, folder: str) -> DataFrame:
    captured = derived(spark, folder, "stored")
    language = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.regexp_extract("html", '<html lang="([^"]*)', 1))
    return captured.withColumns({"language": language, "route": path("url")})


def images(spark: SparkSession, folder: str) -> DataFrame:
    return cap(spark, folder).selectExpr("site", f"{IMAGE_NAME} AS name").distinct()


def math(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, "stored").filter("page_id % 9 = 1").select("site", "url")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    nav = book.nav_order(reading_list(spark, folder))
    return book.chapters(book_pages(spark, folder), nav, sites(spark, folder))


@query("o01_reading_order", f"{BOOK} SELECT site, url, ord FROM chapters")
def o01(spark: SparkSession, folder: str) -> DataFrame:
    nav = book.nav_order(reading_list(spark, folder))
    return book.reading_order(book_pages(spark, folder), nav).select("site", "url", "ord")


@query("w06_chapter_order", f"{BOOK} SELECT site, 'chapter-' || ord AS id, file, ord FROM chapters")
def w06(spark: SparkSession, folder: str) -> DataFrame:
    return chapters(spark, folder).select("site", "id", "file", "ord")


@query("m03_chapters", f"{BOOK} SELECT site, ord, 'chapter-' || ord AS id, file, title, lang, url FROM chapters")
def m03(spark: SparkSession, folder: str) -> DataFrame:
    return chapters(spark, folder)


BODY = "concat('<p>', replace(replace(replace(html, '&', ' '), '<', ' '), '>', ' '), '</p>')"
DOCUMENT_SQL = f"""'<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="' || {o.escape('lang')} || '" lang="' || {o.escape('lang')} || '">' || chr(10)
  || '<head><meta charset="utf-8"/><title>' || {o.escape('title')} || '</title><link rel="stylesheet" type="text/css" href="../styles/book.css"/></head>' || chr(10)
  || '<body><article>' || chr(10) || '<h1>' || {o.escape('title')} || '</h1>' || chr(10) || {BODY} || chr(10)
  || '<footer class="origin"><a href="' || {o.escape('url')} || '">' || {o.escape('url')} || '</a></footer>' || chr(10) || '</article></body>' || chr(10) || '</html>' || chr(10)"""


@query("m04_chapter_document", f"{BOOK} SELECT site, ord, {DOCUMENT_SQL} AS document FROM chapters JOIN (SELECT site, url, html FROM captured) USING (site, url)")
def m04(spark: SparkSession, folder: str) -> DataFrame:
    texts = derived(spark, folder, "stored").selectExpr("site", "url", f"{BODY} AS body")
    made = book.chapter_document(F.col("title"), F.col("url"), F.col("lang"), F.col("body"))
    return chapters(spark, folder).join(texts, ["site", "url"]).select("site", "ord", made.alias("document"))


@query(
    "m05_toc",
    f"""{BOOK} SELECT site, ord, '<li><a href="text/' || file || '">' || {o.escape('title')} || '</a></li>' AS nav_item,
    '<navPoint id="nav-' || ord || '" playOrder="' || ord || '"><navLabel><text>' || {o.escape('title')} || '</text></navLabel><content src="text/' || file || '"/></navPoint>' AS ncx_point FROM chapters""",
)
def m05(spark: SparkSession, folder: str) -> DataFrame:
    return book.toc(chapters(spark, folder))


MANIFEST_SQL = f"""names AS (SELECT DISTINCT site, {IMAGE_NAME} AS name FROM cap UNION SELECT DISTINCT site, 'cover.jpg' FROM cap),
  numbered AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY name) AS ord FROM names),
  manifest AS (SELECT b.site, 0 AS part, f.n AS ord, f.id, f.href, f.media_type, f.properties FROM bases b, (VALUES (1, 'cover-page', 'cover.xhtml', 'application/xhtml+xml', ''), (2, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav'),
      (3, 'ncx', 'toc.ncx', 'application/x-dtbncx+xml', ''), (4, 'css', 'styles/book.css', 'text/css', ''), (5, 'cover-image', 'images/cover.jpg', 'image/jpeg', 'cover-image')) f(n, id, href, media_type, properties)
    UNION ALL SELECT site, 1, ord, 'chapter-' || ord, 'text/' || file, 'application/xhtml+xml', CASE WHEN page_id % 9 = 1 THEN 'mathml' ELSE '' END FROM chapters
    UNION ALL SELECT site, 2, ord, 'asset-' || ord, 'images/' || name, CASE WHEN ends_with(name, '.png') THEN 'image/png' WHEN ends_with(name, '.jpg') THEN 'image/jpeg' ELSE 'application/octet-stream' END, '' FROM numbered WHERE name <> 'cover.jpg')"""


@query("m06_manifest", f"{BOOK}, {MANIFEST_SQL} SELECT * FROM manifest")
def m06(spark: SparkSession, folder: str) -> DataFrame:
    return book.manifest(chapters(spark, folder), images(spark, folder), math(spark, folder))


@query(
    "m07_spine",
    f"""{BOOK} SELECT site, ord, 'chapter-' || ord AS idref, true AS linear FROM chapters UNION ALL SELECT site, -1, 'cover-page', true FROM bases UNION ALL SELECT site, 0, 'nav', false FROM bases""",
)
def m07(spark: SparkSession, folder: str) -> DataFrame:
    return book.spine(chapters(spark, folder))


@query(
    "m08_package_metadata",
    f"""{CAP}, {SITES_SQL} SELECT site, (SELECT 'urn:uuid:' || left(d, 8) || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17]), 1) || d[18:20] || '-' || d[21:32]
      FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(base_url)) AS d)) AS identifier, title, language, base_url AS source,
    CASE WHEN name = '' THEN {o.part('base_url', 'netloc')} ELSE name END AS publisher, CASE WHEN author <> '' THEN author WHEN name = '' THEN {o.part('base_url', 'netloc')} ELSE name END AS creator,
    nullif(description, '') AS description, captured_on AS date, 'Documentation' AS subject, 'quireflow 0.1.0' AS contributor, '2024-05-06T07:08:09Z' AS modified FROM sites""",
)
def m08(spark: SparkSession, folder: str) -> DataFrame:
    return book.package_metadata(sites(spark, folder), F.lit("2024-05-06T07:08:09Z"))


@query(
    "m09_book_summary",
    f"{BOOK} SELECT site, count(*) AS chapters, (SELECT count(DISTINCT {IMAGE_NAME}) FROM cap c WHERE c.site = chapters.site) AS assets FROM chapters GROUP BY site",
)
def m09(spark: SparkSession, folder: str) -> DataFrame:
    return book.book_summary(chapters(spark, folder), images(spark, folder))


@query(
    "k05_book_tables",
    f"""{BOOK}, {MANIFEST_SQL} SELECT site, 'chapters' AS name, count(*) AS n FROM chapters GROUP BY site UNION ALL SELECT site, 'toc', count(*) FROM chapters GROUP BY site
    UNION ALL SELECT site, 'landmarks', 3 FROM bases UNION ALL SELECT site, 'manifest', count(*) FROM manifest GROUP BY site UNION ALL SELECT site, 'spine', count(*) + 2 FROM chapters GROUP BY site
    UNION ALL SELECT site, 'metadata', 1 FROM bases UNION ALL SELECT site, 'summary', 1 FROM bases""",
)
def k05(spark: SparkSession, folder: str) -> DataFrame:
    nav = cut_lineage(book.nav_order(reading_list(spark, folder)).select("site", "url", "nav_pos"))
    made = book.book_tables(
        cut_lineage(book_pages(spark, folder).drop("html")), nav, sites(spark, folder), images(spark, folder), math(spark, folder)
    )
    counted = [df.groupBy("site").agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in made.items()]
    total = counted[0]
    for part in counted[1:]:
        total = total.unionByName(part)
    return total


@query("a03_stage_counts", f"{BOOK} SELECT site, 'pages' AS stage, count(*) AS count FROM book_pages GROUP BY site UNION ALL SELECT site, 'chapters', count(*) FROM chapters GROUP BY site UNION ALL SELECT site, 'assets', count(DISTINCT {IMAGE_NAME}) FROM cap GROUP BY site")
def a03(spark: SparkSession, folder: str) -> DataFrame:
    return checks.stage_counts(book_pages(spark, folder), chapters(spark, folder), images(spark, folder))


@query("o03_path_order", f"SELECT {i.SITE} AS site, {FILE_SQL} AS file FROM pages")
def o03(spark: SparkSession, folder: str) -> DataFrame:
    named = i.pages(spark, folder).select("site", chapter_name(path("url"), "url").alias("file"))
    return tables.path_order(named, "site", "file")


# ---- checks ----------------------------------------------------------------

ENTRY_COLUMNS = (
    "concat('book-', page_id) AS book",
    "CAST(n AS INT) AS ordinal",
    """CASE n WHEN 0 THEN CASE WHEN page_id % 5 = 0 THEN 'EPUB/first.txt' ELSE 'mimetype' END WHEN 1 THEN concat('EPUB/text/c', page_id, '.xhtml')
     ELSE CASE page_id % 7 WHEN 0 THEN '../evil.png' WHEN 1 THEN 'EPUB/my image.png' WHEN 2 THEN 'EPUB/a/../../../x' WHEN 3 THEN 'EPUB/what?.png' WHEN 4 THEN 'EPUB/end.' ELSE 'EPUB/images/ok.png' END END AS name""",
    "CASE WHEN n = 0 AND page_id % 3 <> 0 THEN 'stored' ELSE 'deflated' END AS method",
)
ENTRIES_SQL = f"entries AS MATERIALIZED (SELECT {', '.join(ENTRY_COLUMNS)} FROM pages, (VALUES (0), (1), (2)) v(n))"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    numbered = table(spark, folder, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return numbered.selectExpr(*ENTRY_COLUMNS)


def finding_sql(code: str, message: str, source: str, site: str = "site", file: str = "NULL") -> str:
    return f"SELECT {site} AS site, '{code}' AS code, 'error' AS severity, {message} AS message, 'validate' AS stage, CAST(NULL AS VARCHAR) AS url, {file} AS file, CAST(NULL AS VARCHAR) AS hint FROM {source}"


@query("v01_check_mimetype_order", f"WITH {ENTRIES_SQL} " + finding_sql("EPUB_MIMETYPE_ORDER", "'mimetype is not the first ZIP entry.'", "entries WHERE ordinal = 0 AND name <> 'mimetype'", "book", "CAST(NULL AS VARCHAR)"))
def v01(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_mimetype_order(entries(spark, folder))


@query("v02_check_mimetype_stored", f"WITH {ENTRIES_SQL} " + finding_sql("EPUB_MIMETYPE_COMPRESSED", "'mimetype must be stored without compression.'", "entries WHERE ordinal = 0 AND name = 'mimetype' AND method = 'deflated'", "book", "CAST(NULL AS VARCHAR)"))
def v02(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_mimetype_stored(entries(spark, folder))


@query("v03_check_entry_paths", f"WITH {ENTRIES_SQL} " + finding_sql("EPUB_ENTRY_UNSAFE", "'EPUB entry escapes the extraction directory: ' || name", "entries WHERE name IN ('../evil.png', 'EPUB/a/../../../x')", "book", "name"))
def v03(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_entry_paths(entries(spark, folder))


@query("v14_check_file_names", f"WITH {ENTRIES_SQL} " + finding_sql("FILE_NAME_UNPORTABLE", "'File name is not portable: ' || name", "entries WHERE name IN ('EPUB/my image.png', 'EPUB/what?.png', 'EPUB/end.')", "book", "name"))
def v14(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_file_names(entries(spark, folder))


@query("s09_list_files", f"WITH {ENTRIES_SQL} SELECT book, name FROM entries WHERE regexp_matches(name, '^EPUB/text/[^/]*[.]xhtml$')")
def s09(spark: SparkSession, folder: str) -> DataFrame:
    return tables.list_files(entries(spark, folder), ".xhtml", "EPUB/text/", recursive=False).select("book", "name")


LISTED = "CASE WHEN page_id % 2 = 0 THEN concat('EPUB/text/c', page_id, '.xhtml') ELSE 'EPUB/images/ok.png' END AS name"


@query(
    "j14_manifest_diff",
    f"""WITH {ENTRIES_SQL}, listed AS (SELECT concat('book-', page_id) AS book, {LISTED} FROM pages), present AS (SELECT book, name FROM entries WHERE name NOT IN ('mimetype', 'EPUB/package.opf'))
    SELECT book, name, 'absent' AS side FROM (SELECT * FROM listed EXCEPT SELECT * FROM present) UNION ALL SELECT book, name, 'unlisted' FROM (SELECT * FROM present EXCEPT SELECT * FROM listed)""",
)
def j14(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "pages").selectExpr("concat('book-', page_id) AS book", LISTED)
    return checks.manifest_diff(listed, entries(spark, folder))


@query("j15_nav_not_in_spine", f"{BOOK} SELECT site, file FROM chapters WHERE page_id % 5 = 0")
def j15(spark: SparkSession, folder: str) -> DataFrame:
    toc = chapters(spark, folder)
    kept = derived(spark, folder, "stored").filter("page_id % 5 <> 0").select("site", chapter_name(path("url"), "url").alias("file"))
    return checks.nav_not_in_spine(toc, kept)


FILED = f"{RICH_URL}, filed AS MATERIALIZED (SELECT *, 'EPUB/text/' || {FILE_SQL} AS file FROM nodes)"


def filed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("EPUB/text/"), chapter_name(path("url"), "url"))
    return i.rich_nodes(spark, folder, "site", "url").withColumn("file", name)


BARE_LANGUAGE = "CASE WHEN page_id % 3 = 0 THEN replace(html, '<html lang=', '<html data-x=') WHEN page_id % 3 = 1 THEN replace(html, '<html ', '<htm ') ELSE html END AS html"


@query("v05_check_language", finding_sql("A11Y_LANGUAGE", "'The XHTML document has no language.'", "pages WHERE page_id % 3 <> 2", i.SITE, FILE_SQL))
def v05(spark: SparkSession, folder: str) -> DataFrame:
    changed = i.pages(spark, folder).selectExpr("page_id", "url", "site", BARE_LANGUAGE)
    nodes = markup.parse_html(changed, "page_id", "html", "site", "url").withColumn("file", chapter_name(path("url"), "url"))
    return checks.check_language(nodes)


@query("v06_check_image_alt", f"{FILED} " + finding_sql("A11Y_IMAGE_ALT", "'An image has no alt text.'", f"filed WHERE tag = 'img' AND coalesce({attr_sql('alt')}, '') = ''", file="file"))
def v06(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_image_alt(filed_nodes(spark, folder))


@query("v07_check_table_header", f"{FILED} " + finding_sql("A11Y_TABLE_HEADER", "'A table has no header cells.'", f"filed n WHERE tag = 'table' AND NOT EXISTS (SELECT 1 FROM nodes h WHERE {below('n', 'h')} AND h.tag = 'th')", file="file"))
def v07(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_table_header(filed_nodes(spark, folder))


JUMPS_SQL = f"""{FILED}, {HEADINGS_SQL}, jumps AS (SELECT f.site, f.file, a.level AS a, b.level AS b FROM headings a JOIN headings b ON b.page_id = a.page_id AND b.i = a.i + 1 JOIN filed f ON f.page_id = b.page_id AND f.pos = b.pos WHERE b.level > a.level + 1)"""
JUMP_MESSAGE = "'Heading level jumps from h' || a || ' to h' || b || '.'"


@query("v08_check_heading_order", f"{JUMPS_SQL} " + finding_sql("A11Y_HEADING_ORDER", JUMP_MESSAGE, "jumps", file="file"))
def v08(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_heading_order(filed_nodes(spark, folder))


# Files for the link check: every page's chapter, linked to by name.
TO_FILE = f"replace(html, '</article>', concat('<a href=\"c', page_id + 1, '.xhtml#x\">n</a><a href=\"../text/./c', page_id, '.xhtml\">s</a><a href=\"gone/', page_id, '.xhtml\">g</a><a href=\"x.png\">p</a></article>')) AS html"
TO_FILE_SQL = f"(SELECT page_id, url, {i.SITE} AS site, {TO_FILE} FROM pages)"
BROKEN_SQL = """(SELECT 'all' AS site, 'EPUB/text/c' || page_id || '.xhtml' AS file, 'gone/' || page_id || '.xhtml' AS href, 'EPUB/text/gone/' || page_id || '.xhtml' AS target FROM pages
  UNION ALL SELECT 'all', 'EPUB/text/c' || page_id || '.xhtml', 'c' || (page_id + 1) || '.xhtml#x', 'EPUB/text/c' || (page_id + 1) || '.xhtml' FROM pages WHERE page_id + 1 NOT IN (SELECT page_id FROM pages))"""


def linked_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    raw = i.pages(spark, folder).selectExpr("page_id", "'all' AS site", "concat('EPUB/text/c', page_id, '.xhtml') AS file", TO_FILE)
    return markup.parse_html(raw, "page_id", "html", "site", "file"), raw.select("site", "file")


@query("j12_broken_links", f"SELECT * FROM {BROKEN_SQL}")
def j12(spark: SparkSession, folder: str) -> DataFrame:
    return checks.broken_links(*linked_files(spark, folder))


@query("v09_check_links", finding_sql("LINK_BROKEN_INTERNAL", "'Internal link target does not exist: ' || href", BROKEN_SQL, file="file"))
def v09(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_links(*linked_files(spark, folder))


PACKAGE_SQL = f"""broken AS (SELECT site, file, unnest(list_filter([CASE WHEN tag = 'script' THEN 'PACKAGE_SCRIPT' END, CASE WHEN len(list_filter(attrs, lambda a: starts_with(a.name, 'on'))) > 0 THEN 'PACKAGE_HANDLER' END,
  CASE WHEN tag = 'a' AND starts_with({attr_sql('href')}, 'data:') THEN 'PACKAGE_DATA_LINK' END], lambda x: x IS NOT NULL)) AS rule FROM filed
  UNION ALL SELECT site, file, 'PACKAGE_REPEATED_ID' FROM (SELECT site, file, page_id, {attr_sql('id')} AS id FROM filed) WHERE id IS NOT NULL GROUP BY site, file, page_id, id HAVING count(*) > 1)"""


@query("v12_check_package", f"{FILED}, {PACKAGE_SQL} SELECT site, rule AS code, 'error' AS severity, 'Content breaks rule ' || rule AS message, 'validate' AS stage, CAST(NULL AS VARCHAR) AS url, file, CAST(NULL AS VARCHAR) AS hint FROM broken")
def v12(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_package(filed_nodes(spark, folder))


OPF = """concat('<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier>', page_id, '</dc:identifier>', CASE WHEN page_id % 2 = 0 THEN '<dc:title>T</dc:title>' ELSE '' END,
 '<dc:language>en</dc:language>', CASE WHEN page_id % 5 = 0 THEN '<dc:language>de</dc:language>' ELSE '' END, '<meta property="dcterms:modified">', CASE WHEN page_id % 3 = 0 THEN '2024-01-01' ELSE '2024-01-01T00:00:00Z' END,
 '</meta><meta property="schema:accessMode">textual</meta><meta property="schema:accessibilityFeature">x</meta><meta property="schema:accessibilityHazard">none</meta>', CASE WHEN page_id % 7 = 0 THEN '' ELSE '<meta property="schema:accessibilitySummary">y</meta>' END, '</metadata></package>')"""


@query(
    "v13_check_metadata",
    """SELECT 'book-' || page_id AS site, rule AS code, 'error' AS severity, 'Package metadata breaks rule ' || rule AS message, 'validate' AS stage, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS hint
    FROM (SELECT page_id, 'METADATA_TITLE' AS rule FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'METADATA_LANGUAGE' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'METADATA_MODIFIED' FROM pages WHERE page_id % 3 = 0
      UNION ALL SELECT page_id, 'METADATA_ACCESSIBILITY' FROM pages WHERE page_id % 7 = 0)""",
)
def v13(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "pages").selectExpr("concat('book-', page_id) AS site", f"{OPF} AS document")
    return checks.check_metadata(packages)


NESTED_SQL = f"nested AS (SELECT * FROM filed n WHERE tag IN ({', '.join(repr(x) for x in checks.BLOCK_CHILDREN)}) AND EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'n')} AND a.tag IN ({', '.join(repr(x) for x in checks.PHRASING_PARENTS)})))"


@query("v15_check_nesting", f"{FILED}, {NESTED_SQL} " + finding_sql("CONTENT_NESTING", "'Block element in phrasing content: ' || tag", "nested", file="file"))
def v15(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_nesting(filed_nodes(spark, folder))


@query("v16_run_stage", "SELECT 'all' AS site, count(*) AS n FROM pages")
def v16(spark: SparkSession, folder: str) -> DataFrame:
    def work() -> DataFrame:
        return table(spark, folder, "pages").groupBy(F.lit("all").alias("site")).agg(F.count("*").alias("n"))

    return checks.run_stage(spark, "capture", "all", work)


@query(
    "v16_run_stages",
    """SELECT 'all' AS site, n, stage, status, counted, count FROM (
      SELECT 0 AS n, 'scrape' AS stage, 'passed' AS status, 'rows' AS counted, count(*) AS count FROM pages
      UNION ALL SELECT 0, 'scrape', 'passed', 'characters', sum(length(html))::BIGINT FROM pages
      UNION ALL SELECT 1, 'build', 'passed', 'rows', count(*) FROM pages WHERE contains(html, '<h1>')
      UNION ALL SELECT 2, 'validate', 'failed', NULL, NULL UNION ALL SELECT 3, 'report', 'skipped', NULL, NULL)""",
)
def v16_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Counts gathered while stages are stored; the third fails at its first row, and the first two keep theirs."""
    stages = [
        ("scrape", lambda stored: i.pages(spark, folder)),
        ("build", lambda stored: stored["scrape"].filter(F.col("html").contains("<h1>")).drop("html")),
        ("validate", lambda stored: stored["build"].withColumn("broken", F.raise_error(F.concat(F.lit("bad page "), "page_id")))),
        ("report", lambda stored: stored["validate"]),
    ]
    runs = checks.run_stages(stages, {"characters": ("html", F.length("html"))})
    return checks.stage_report(spark, "all", runs).drop("message")


@query(
    "s10_response_findings",
    """SELECT site, code, severity, message, 'scrape' AS stage, url, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS hint FROM (
      SELECT regexp_extract(url, 'example.(com|net|org)', 1) AS site, url, 'RESPONSE_STATUS' AS code, 'warning' AS severity,
        'Could not fetch ' || url || ': HTTP ' || CASE page_id % 6 WHEN 0 THEN 404 WHEN 2 THEN 301 ELSE 500 END AS message FROM pages WHERE page_id % 6 IN (0, 2, 3) AND page_id % 4 <> 1
      UNION ALL SELECT regexp_extract(url, 'example.(com|net|org)', 1), url, 'RESPONSE_FAILED', 'error',
        'Could not fetch ' || url || ': ' || CASE WHEN page_id % 8 = 1 THEN 'connection reset' ELSE 'no response' END FROM pages WHERE page_id % 4 = 1)""",
)
def s10_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth request has no answer, with or without a reason; the others answer with a status."""
    from ..plans.capture import response_findings

    answered = table(spark, folder, "pages").selectExpr("page_id", f"{i.SITE} AS site", "url", STATUSES)
    lost = F.col("page_id") % 4 == 1
    return response_findings(
        answered.withColumn("status", F.when(~lost, F.col("status"))).withColumn("error", F.when(F.col("page_id") % 8 == 1, "connection reset"))
    )


@query(
    "s01_read_pages_checked",
    """SELECT CASE page_id % 5 WHEN 0 THEN 'RECORD_DAMAGED' WHEN 1 THEN 'RECORD_INCOMPLETE' ELSE 'ok' END AS code,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS name, CASE page_id % 5 WHEN 0 THEN 'A stored record cannot be read.' WHEN 1 THEN 'A stored record has no discovered_from.' ELSE sha256(html) END AS told
    FROM pages""",
)
def s01_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Stored records of all pages; one in five is cut off, one lacks a required list."""
    target = scratch_folder(spark, "damaged")
    found = F.when(F.col("page_id") % 5 != 1, F.array(F.lit("sitemap")))
    record = F.to_json(F.struct("url", "html", F.sha2("html", 256).alias("content_hash"), found.alias("discovered_from")))
    pages = table(spark, folder, "pages").withColumn("value", record)
    cut = F.when(F.col("page_id") % 5 == 0, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value"))
    pages.select(cut.alias("value")).write.text(f"{target}/pages")
    sound, findings = tables.read_pages_checked(spark, f"{target}/pages")
    return findings.select("code", F.col("site").alias("name"), F.col("message").alias("told")).unionByName(
        sound.select(F.lit("ok").alias("code"), F.col("url").alias("name"), F.col("content_hash").alias("told"))
    )


@query(
    "s03_sitemap_files",
    "SELECT 'loc' AS tag, url AS loc FROM pages UNION ALL SELECT 'i:loc', 'https://i.example/' || page_id || '.png' FROM pages",
)
def s03_files(spark: SparkSession, folder: str) -> DataFrame:
    """All pages in sitemap files of many entries."""
    target = scratch_folder(spark, "sitemaps")
    entry = F.concat(
        F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><i:image><i:loc>https://i.example/"), "page_id", F.lit(".png</i:loc></i:image></url>")
    )
    entries = table(spark, folder, "pages").select((F.col("page_id") % 3).alias("part"), F.lit(1).alias("n"), entry.alias("value"))
    ends = F.array(
        F.struct(F.lit(0).alias("n"), F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i">').alias("value")),
        F.struct(F.lit(2).alias("n"), F.lit("</urlset>").alias("value")),
    )
    whole = entries.unionByName(entries.select("part").distinct().select("part", F.inline(ends)))
    whole.repartition("part").sortWithinPartitions("part", "n").drop("n").write.partitionBy("part").text(f"{target}/map")
    found = tables.sitemap_files(spark, f"{target}/map", ("loc", "i:loc"))
    return found.select("tag", "loc")


@query("x06_duplicate_ids", f"{RICH_URL} SELECT page_id, {attr_sql('id')} AS id, count(*) AS n FROM nodes WHERE {attr_sql('id')} IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def x06(spark: SparkSession, folder: str) -> DataFrame:
    return checks.duplicate_ids(i.rich_nodes(spark, folder))


UNION_SQL = f"""{JUMPS_SQL}, found AS MATERIALIZED (SELECT *, 1 AS check_ord FROM ({finding_sql('A11Y_TABLE_HEADER', "'A table has no header cells.'", f"filed n WHERE tag = 'table' AND NOT EXISTS (SELECT 1 FROM nodes h WHERE {below('n', 'h')} AND h.tag = 'th')", file='file')})
  UNION ALL SELECT *, 0 FROM ({finding_sql('A11Y_IMAGE_ALT', "'An image has no alt text.'", f"filed WHERE tag = 'img' AND coalesce({attr_sql('alt')}, '') = ''", file='file')}) UNION ALL SELECT *, 2 FROM ({finding_sql('A11Y_HEADING_ORDER', JUMP_MESSAGE, 'jumps', file='file')}))"""


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    nodes = filed_nodes(spark, folder)
    return checks.union_findings(
        checks.check_image_alt(nodes), checks.check_table_header(nodes), checks.check_heading_order(nodes)
    )


@query("x05_union_findings", f"{UNION_SQL} SELECT * FROM found")
def x05(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder)


COUNTS_SQL = "counts AS (SELECT b.site, count(f.code) AS errors, 0 AS warnings, CASE WHEN count(f.code) > 0 THEN 'failed' ELSE 'passed' END AS status FROM (SELECT DISTINCT site FROM src UNION SELECT 'clean') b LEFT JOIN found f ON f.site = b.site GROUP BY b.site)"


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    known = i.pages(spark, folder).select(F.explode(F.array("site", F.lit("clean"))).alias("site"))
    return checks.finding_counts(_findings(spark, folder), known)


@query("a01_finding_counts", f"{UNION_SQL}, {COUNTS_SQL} SELECT * FROM counts")
def a01(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    counted = cut_lineage(_counts(spark, folder).select("site", "status", "errors", "warnings"))
    built = counted.withColumns({"status": F.lit("passed"), "errors": F.lit(0).cast("long"), "warnings": F.lit(0).cast("long")})
    return counted.withColumn("stage", F.lit("validate")).unionByName(built.withColumn("stage", F.lit("build")))


@query("a02_report_status", f"{UNION_SQL}, {COUNTS_SQL} SELECT site, status FROM counts")
def a02(spark: SparkSession, folder: str) -> DataFrame:
    return checks.report_status(_stages(spark, folder))


REPORT_SQL = """SELECT '{"command":"run","status":"' || status || '","workspace":"' || site || '","stages":[{"stage":"build","status":"passed","counts":{"errors":0,"warnings":0}},{"stage":"validate","status":"' || status || '","counts":{"errors":' || errors || ',"warnings":0}}],"format_version":1}' AS document FROM counts"""


@query("k03_write_report", f"{UNION_SQL}, {COUNTS_SQL} {REPORT_SQL}")
def k03(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "report")
    sinks.write_report(_stages(spark, folder), f"{target}/report")
    return sinks.inspect(spark, "report", target)


# ---- sources and sinks -----------------------------------------------------


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    return book_pages(spark, folder).select(
        "url",
        "route",
        "title",
        F.when(F.col("language") == "", "en").otherwise(F.col("language")).alias("language"),
        "html",
        F.sha2("html", 256).alias("content_hash"),
        F.array(F.lit("sitemap")).alias("discovered_from"),
    )


RECORDS_SQL = f"""records AS (SELECT url, {o.part('url', 'path')} AS route, title, CASE WHEN page_id % 4 = 0 THEN 'en' ELSE {LANG} END AS language, sha256(html) AS content_hash, left(sha256(url), 16) AS page_key, 0 AS assets FROM captured)"""


@query("s01_read_pages", f"{STORED}, {RECORDS_SQL} SELECT * FROM records")
def s01(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "pages")
    sinks.write_pages(page_records(spark, folder), f"{target}/pages")
    stored = tables.read_pages(spark, f"{target}/pages")
    return stored.select("url", "route", "title", "language", "content_hash", "page_key", F.size("assets").cast("long").alias("assets"))


@query("k01_write_pages", f"{STORED}, {RECORDS_SQL} SELECT url, CASE WHEN left(content_hash, 1) < '8' THEN 'new ' || title ELSE title END AS title, content_hash FROM records")
def k01(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "pages")
    old = page_records(spark, folder)
    new = old.filter("content_hash < '8'").withColumn("title", F.concat(F.lit("new "), "title"))
    sinks.write_pages(sinks.upsert(old, new, ["url"]), f"{target}/pages")
    return tables.read_pages(spark, f"{target}/pages").select("url", "title", "content_hash")


@query("k07_inspect", f"{STORED}, {RECORDS_SQL} SELECT url FROM records")
def k07(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "pages")
    sinks.write_pages(page_records(spark, folder), f"{target}/pages")
    return sinks.inspect(spark, "pages", target).select(F.get_json_object("document", "$.url").alias("url"))


def site_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Facts and lists of all sites; positions are numbered without a list per site."""
    known = sites(spark, folder)
    named = known.select("site", "base_url")

    def numbered(rows: DataFrame, *order: str) -> DataFrame:
        placed = ordinals(rows, ["site"], *order, name="pos").withColumn("pos", F.col("pos") - 1)
        return placed.join(named, "site").drop("site").withColumnRenamed("base_url", "site")

    title = F.concat(F.lit("Link "), F.col("pos").cast("string")).alias("title")
    nav = numbered(derived(spark, folder, "nav").select("site", title, "url"), "title", "url")
    listed = numbered(derived(spark, folder, "sitemap").select("site", "url"), "url")
    facts = known.select(
        "base_url", "title", "language", F.lit("generic").alias("adapter"), F.lit(1).alias("ir_version"), F.struct("name", "author").alias("metadata")
    )
    return facts, {"nav": nav, "sitemap_urls": listed, "pages": listed.filter("false")}


def stored_sites(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    target = scratch_folder(spark, "sites")
    sinks.write_site_parts(*site_parts(spark, folder), target)
    return tables.read_site_parts(spark, target)


@query("s02_read_sites", f"{CAP}, {SITES_SQL} SELECT base_url, title, language, 1 AS ir_version, name, (SELECT count(*) FROM sitemap m WHERE m.site = s.site) AS sitemap_urls, (SELECT count(*) FROM nav n WHERE n.site = s.site) AS nav FROM sites s")
def s02(spark: SparkSession, folder: str) -> DataFrame:
    facts, lists = stored_sites(spark, folder)
    counts = [lists[name].groupBy(F.col("site").alias("base_url")).agg(F.count("*").alias(name)) for name in ("sitemap_urls", "nav")]
    joined = facts.join(counts[0], "base_url", "left").join(counts[1], "base_url", "left").fillna(0, ["sitemap_urls", "nav"])
    return joined.select("base_url", "title", "language", "ir_version", F.col("metadata.name").alias("name"), "sitemap_urls", "nav")


@query("k02_write_sites", f"{CAP}, {SITES_SQL} SELECT s.base_url AS site, n.pos, n.title FROM sites s JOIN (SELECT site, title, row_number() OVER (PARTITION BY site ORDER BY title, url) - 1 AS pos FROM nav) n ON n.site = s.site")
def k02(spark: SparkSession, folder: str) -> DataFrame:
    return stored_sites(spark, folder)[1]["nav"].select("site", "pos", "title")


SITEMAP_XML = """concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i"><url><loc> ', replace(url, '&', '&amp;'), ' </loc><i:image><i:loc>https://i.example/', page_id, '.png</i:loc></i:image></url>',
 CASE WHEN page_id % 10 = 0 THEN '<url>' ELSE '' END, '</urlset>') AS body"""


@query("s03_sitemap_locations", "SELECT page_id, 0 AS ord, url AS loc FROM pages WHERE page_id % 10 <> 0 UNION ALL SELECT page_id, 1, 'https://i.example/' || page_id || '.png' FROM pages WHERE page_id % 10 <> 0")
def s03(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "pages").selectExpr("page_id", SITEMAP_XML)
    return tables.sitemap_locations(documents, "page_id")


XHTML = """concat('<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en"><body><p><p>', page_id, '</p></p><br/>', CASE WHEN page_id % 4 = 0 THEN '<b>' ELSE '' END, '<script src="a.js"/><i><![CDATA[<b>', page_id, '</b> & ]]></i><a href="x"/></body></html>') AS html"""


@query("s08_parse_xhtml", "SELECT page_id, page_id % 4 <> 0 AS sound, CASE WHEN page_id % 4 <> 0 THEN 4 ELSE 0 END AS depth, CASE WHEN page_id % 4 <> 0 THEN '<b>' || page_id || '</b> & ' END AS literal FROM pages")
def s08(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "pages").selectExpr("page_id", XHTML).withColumn(
        "error", markup.xml_error(F.encode("html", "UTF-8"))
    )
    nodes = markup.parse_html(documents.filter("error IS NULL"), "page_id", "html", xml=True)
    literal = F.max(F.when((F.col("kind") == "text") & F.col("text").contains("<"), F.col("text")))
    deepest = nodes.groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "element", F.col("depth"))).cast("long").alias("depth"), literal.alias("literal")
    )
    return (
        documents.select("page_id", F.col("error").isNull().alias("sound"))
        .join(deepest, "page_id", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
    )


@query(
    "v04_check_well_formed",
    finding_sql("XHTML_INVALID", "'mismatched tag: line 1, column ' || (strpos(html, '</body>') + 1)", f"(SELECT page_id, url, {XHTML} FROM pages) WHERE page_id % 4 = 0", i.SITE, FILE_SQL),
)
def v04(spark: SparkSession, folder: str) -> DataFrame:
    documents = i.pages(spark, folder).selectExpr("site", "url", XHTML)
    checked = documents.select(
        "site", chapter_name(path("url"), "url").alias("file"), markup.xml_error(F.encode("html", "UTF-8")).alias("error")
    )
    return checks.check_well_formed(checked)


STATUSES = "CAST(CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 500 ELSE 200 END AS INT) AS status"


@query("s10_ok_responses", "SELECT url, CASE WHEN page_id % 6 = 1 THEN 204 ELSE 200 END AS status FROM pages WHERE page_id % 6 IN (1, 4, 5)")
def s10(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.capture import ok_responses

    return ok_responses(table(spark, folder, "pages").selectExpr("url", STATUSES))


def _book_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Whole books of the test pages, with their text as chapters."""
    captured = cut_lineage(book_pages(spark, folder))
    nav = cut_lineage(book.nav_order(reading_list(spark, folder)).select("site", "url", "nav_pos"))
    made = book.book_tables(captured, nav, sites(spark, folder), images(spark, folder), math(spark, folder))
    text = captured.select("site", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("content"))
    documents = made["chapters"].join(text, ["site", "url"]).select(
        "site",
        "file",
        book.chapter_document(
            F.col("title"), F.col("url"), F.col("lang"), F.concat(F.lit("<p>"), F.regexp_replace("content", "[&<>]", " "), F.lit("</p>"))
        ).alias("html"),
    )
    pictures = images(spark, folder).union(sites(spark, folder).select("site", F.lit("cover.jpg"))).withColumn(
        "data", F.encode(F.concat("site", "name"), "UTF-8")
    )
    return book.book_files(made, documents, pictures)


ARCHIVE_COUNT_SQL = f"(SELECT site, 7 + 1 + count(*) + (SELECT count(DISTINCT {IMAGE_NAME}) FROM cap c WHERE c.site = chapters.site) AS entries FROM chapters GROUP BY site)"


@query("k06_write_epub", f"{BOOK} SELECT site AS book, entries FROM {ARCHIVE_COUNT_SQL}")
def k06(spark: SparkSession, folder: str) -> DataFrame:
    written = archives.write_epub(_book_rows(spark, folder), scratch_folder(spark, "epub"))
    return written.select("book", "entries")


@query(
    "s05_read_epub",
    f"""{BOOK} SELECT site AS book, 'mimetype' AS first_entry, 'stored' AS first_method, entries, entries - 1 AS packed, true AS sorted FROM {ARCHIVE_COUNT_SQL}""",
)
def s05(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_folder(spark, "epub")
    cut_lineage(archives.write_epub(_book_rows(spark, folder), target))
    stored = archives.read_epub(spark, target)
    named = stored.withColumn("book", F.regexp_extract("book", "([^/]*)[.]epub$", 1))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("ordinal") > 0, F.struct("ordinal", "name")))), lambda e: e["name"])
    return named.groupBy("book").agg(
        F.min_by("name", "ordinal").alias("first_entry"),
        F.min_by("method", "ordinal").alias("first_method"),
        F.count("*").alias("entries"),
        F.count_if(F.col("method") == "deflated").alias("packed"),
        (ordered == F.array_sort(ordered)).alias("sorted"),
    )


# ---- colours ---------------------------------------------------------------

PIXEL_COLUMNS = (
    "concat('img', user_id % 25) AS image",
    "CAST((event_id * 37) % 256 AS INT) AS r",
    "CAST((event_id * 91 + 7) % 128 AS INT) AS g",
    "CAST((user_id * 53) % 256 AS INT) AS b",
    "CAST(CASE WHEN user_id % 25 = 3 THEN 0 ELSE event_id % 256 END AS INT) AS a",
)
PIXELS_SQL = f"pixels AS MATERIALIZED (SELECT {', '.join(PIXEL_COLUMNS)} FROM events)"
BUCKETS_SQL = """buckets AS MATERIALIZED (SELECT image, (r >> 5) * 64 + (g >> 5) * 8 + (b >> 5) AS bucket, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels
  WHERE greatest(r, g, b) - least(r, g, b) >= 48 GROUP BY ALL), dominant AS MATERIALIZED (SELECT * FROM buckets WHERE n >= 8 QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, bucket) = 1)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*PIXEL_COLUMNS)


def rounded(*names: str):
    return [F.round(name, 6).alias(name) for name in names]


@query("o07_top_bucket", f"WITH {PIXELS_SQL}, {BUCKETS_SQL} SELECT image, bucket, n FROM dominant")
def o07(spark: SparkSession, folder: str) -> DataFrame:
    return colors.top_bucket(colors.color_buckets(pixels(spark, folder))).select("image", "bucket", "n")


@query("c11_dominant_color", f"WITH {PIXELS_SQL}, {BUCKETS_SQL} SELECT image, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM dominant")
def c11(spark: SparkSession, folder: str) -> DataFrame:
    return colors.dominant_color(pixels(spark, folder)).select("image", *rounded("r", "g", "b"))


INKS_SQL = f"inks AS MATERIALIZED (SELECT image, CASE WHEN w >= 1 THEN {o.luminance('(x / w)', '(y / w)', '(z / w)')} END AS ink FROM (SELECT image, sum(a)::DOUBLE AS w, sum(r * a)::DOUBLE AS x, sum(g * a)::DOUBLE AS y, sum(b * a)::DOUBLE AS z FROM pixels GROUP BY image))"


@query("c12_ink_luminance", f"WITH {PIXELS_SQL}, {INKS_SQL} SELECT image, round(ink, 9) AS ink FROM inks")
def c12(spark: SparkSession, folder: str) -> DataFrame:
    return colors.ink_luminance(pixels(spark, folder)).withColumn("ink", F.round("ink", 9))


BRAND_COLUMNS = (
    "page_id AS site",
    "concat('#', lpad(hex(page_id * 7919 % 16777216), 6, '0')) AS c1",
    "CASE WHEN page_id % 3 = 0 THEN '#000040' ELSE 'none' END AS c2",
    "CASE WHEN page_id % 2 = 0 THEN concat('img', page_id % 25) END AS logo",
    "concat('img', (page_id + 1) % 25) AS icon",
)


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr(*BRAND_COLUMNS).withColumn("theme_colors", F.array("c1", "c2"))


def _hex(name: str, at: int) -> str:
    return f"CAST(('0x' || substr({name}, {at}, 2))::INT AS DOUBLE)"


LUM_C1 = o.luminance(_hex("c1", 2), _hex("c1", 4), _hex("c1", 6))
ACCENT_SQL = f"""brands AS (SELECT {', '.join(BRAND_COLUMNS)} FROM pages), dark AS (SELECT image, r, g, b FROM dominant WHERE {o.luminance('r', 'g', 'b')} < 0.35),
  accents AS MATERIALIZED (SELECT site, logo, icon, CASE WHEN {LUM_C1} < 0.35 THEN [{_hex('c1', 2)}, {_hex('c1', 4)}, {_hex('c1', 6)}] WHEN c2 = '#000040' THEN [0.0, 0.0, 64.0]
    WHEN l.image IS NOT NULL THEN [l.r, l.g, l.b] WHEN k.image IS NOT NULL THEN [k.r, k.g, k.b] ELSE [36.0, 43.0, 56.0] END::DOUBLE[] AS c
    FROM brands LEFT JOIN dark l ON l.image = logo LEFT JOIN dark k ON k.image = icon)"""


def _accents(spark: SparkSession, folder: str) -> DataFrame:
    return colors.accent_color(brands(spark, folder), colors.dominant_color(pixels(spark, folder)))


@query("c10_accent_color", f"WITH {PIXELS_SQL}, {BUCKETS_SQL}, {ACCENT_SQL} SELECT site, round(c[1], 6) AS r, round(c[2], 6) AS g, round(c[3], 6) AS b FROM accents")
def c10(spark: SparkSession, folder: str) -> DataFrame:
    return _accents(spark, folder).select("site", *(F.round(f"accent.{c}", 6).alias(c) for c in "rgb"))


@query("c13_light_mark", f"WITH {PIXELS_SQL}, {BUCKETS_SQL}, {ACCENT_SQL}, {INKS_SQL} SELECT site, coalesce(ink > 0.6 AND {o.luminance('c[1]', 'c[2]', 'c[3]')} < 0.2, false) AS light_mark FROM accents LEFT JOIN inks ON image = coalesce(logo, icon)")
def c13(spark: SparkSession, folder: str) -> DataFrame:
    inks = colors.ink_luminance(pixels(spark, folder))
    return colors.light_mark(_accents(spark, folder), inks).select("site", "light_mark")


# ---- the whole build -------------------------------------------------------


@query("q02_build_chapters")
def q02(spark: SparkSession, folder: str) -> DataFrame:
    """Finished chapter documents of all pages: capture, clean, link, prune, serialise."""
    from ..plans.build import build_chapters

    titled = i.rich_pages(spark, folder).withColumn("title", F.regexp_extract("html", "<h1>([^<]*)", 1))
    return build_chapters(titled, files(spark, folder))


# ---- streams and reruns ----------------------------------------------------


SEEN_MICROS = "(page_id * 7919) % 86400 * 1000000 + page_id"


@query(
    "i02_capture_stream",
    f"""SELECT regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS site, {o.canonical('url')} AS url, arg_min(page_id, {SEEN_MICROS}) AS page_id
    FROM pages GROUP BY 1, 2""",
)
def i02(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest capture of each address from a feed whose files are in no order of time; a record ten days on closes it."""
    from ..streaming.capture import capture_stream

    target = scratch_folder(spark, "stream")
    day = 1_700_000_000_000_000
    feed = table(spark, folder, "pages").select("page_id", "url", F.expr(f"timestamp_micros({day} + {SEEN_MICROS})").alias("seen"))
    feed.repartition(4, F.xxhash64("page_id")).write.parquet(f"{target}/feed")
    end = feed.limit(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("http://end.invalid/").alias("url"), F.expr(f"timestamp_micros({day} + 864000000000)").alias("seen"))
    query = capture_stream(spark, f"{target}/feed", feed.schema, f"{target}/pages", f"{target}/state", "seen", "2 days")
    query.awaitTermination()
    # what closes the feed comes when all else has been read
    end.write.mode("append").parquet(f"{target}/feed")
    capture_stream(spark, f"{target}/feed", feed.schema, f"{target}/pages", f"{target}/state", "seen", "2 days").awaitTermination()
    return spark.read.parquet(f"{target}/pages").select("site", "url", "page_id")


@query("i03_rebuild", f"{BOOK} SELECT site, ord, file FROM chapters")
def i03(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters from stored tables alone: written once, then built without the capture."""
    target = scratch_folder(spark, "rebuild")
    stored = {
        "pages": book_pages(spark, folder).drop("html"),
        "reading": reading_list(spark, folder),
        "sites": sites(spark, folder),
    }
    for name, df in stored.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    again = {name: spark.read.parquet(f"{target}/{name}") for name in stored}
    made = book.chapters(again["pages"], book.nav_order(again["reading"]), again["sites"])
    return made.select("site", "ord", "file")


