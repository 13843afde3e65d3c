"""Discovery, provenance, increments, and the flagship capture summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import canonical_url
from ..operators import discovery as d
from ..operators.windows import first_wins
from . import inputs as i
from . import oracle as o
from .registry import query, table

TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
LANG = "regexp_extract(html, '<html lang=\"([^\"]*)', 1)"
# Tables derived from the pages, in SQL both engines read alike. `captured` lacks some pages, so that comparing it with
# the listed ones finds something; `stored` has all.
DERIVED = {
    "sitemap": ("site, page_id AS pos, CASE WHEN page_id % 5 = 0 THEN concat('https://moved.example/', page_id) ELSE url END AS url", "page_id % 2 = 0"),
    "nav": (
        "site, page_id AS pos, concat('Link ', page_id) AS title, CASE page_id % 4 WHEN 1 THEN concat(url, '/gone') WHEN 2 THEN concat('https://moved.example/', page_id) ELSE url END AS url",
        "page_id % 3 = 0",
    ),
    "landed": ("site, concat('https://moved.example/', page_id) AS url, url AS landed", "page_id % 3 <> 1"),
    "captured": ("site, url, title, page_id, html", "page_id % 7 <> 0"),
    "stored": ("site, url, title, page_id, html", "true"),
}


def cap(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "pages").selectExpr("page_id", "url", f"{i.SITE} AS site", f"{TITLE} AS title", "html")
    return raw.withColumn("url", canonical_url("url"))


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns, condition = DERIVED[name]
    picked = cap(spark, folder).filter(condition).selectExpr(*_split(columns))
    return first_wins(picked, ["site", "url"], "page_id") if name in ("captured", "stored") else picked


def _split(columns: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for at, character in enumerate(columns):
        depth += (character == "(") - (character == ")")
        if character == "," and depth == 0:
            parts.append(columns[start:at])
            start = at + 1
    return [*parts, columns[start:]]


def bases(spark: SparkSession, folder: str) -> DataFrame:
    return cap(spark, folder).groupBy("site").agg(F.min("url").alias("url"))


CAP = f"""WITH cap AS MATERIALIZED (SELECT page_id, {i.SITE} AS site, {o.canonical('url')} AS url, {TITLE} AS title, html FROM pages),
 bases AS (SELECT site, min(url) AS url FROM cap GROUP BY site),
 captured AS MATERIALIZED (SELECT {DERIVED['captured'][0]} FROM cap WHERE {DERIVED['captured'][1]} QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id) = 1),
 """ + ", ".join(f"{name} AS (SELECT {DERIVED[name][0]} FROM cap WHERE {DERIVED[name][1]})" for name in ("sitemap", "nav", "landed"))
# The same tables where all pages are there: for books and records.
STORED = CAP.replace(DERIVED["captured"][1], DERIVED["stored"][1])
DISCOVERED = """discovered AS MATERIALIZED (SELECT site, url, rank, pos FROM (SELECT site, url, 0 AS rank, 0 AS pos FROM bases UNION ALL SELECT site, url, 1, pos FROM nav UNION ALL SELECT site, url, 2, pos FROM sitemap)
  QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY rank, pos) = 1)"""


NAV_SCOPE = "regexp_extract(url, '^(https?://[^/]*)', 1)"
SCOPE_BASE = f"CASE WHEN page_id % 2 = 0 THEN {NAV_SCOPE} ELSE concat({NAV_SCOPE}, '/the') END"


@query(
    "f01_filter_in_scope",
    f"""SELECT page_id, href FROM (SELECT page_id, base, {o.join('url', 'ref')} AS href FROM
      (SELECT page_id, url, {SCOPE_BASE} AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages)) WHERE {o.in_scope('href', 'base')}""",
)
def f01(spark: SparkSession, folder: str) -> DataFrame:
    links = _page_links(spark, folder)
    return d.filter_in_scope(links, "href", "base").select("page_id", "href")


def _page_links(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.url import url_join

    raw = table(spark, folder, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ref")
    )
    return raw.select("page_id", url_join("url", "ref").alias("href"), F.expr(SCOPE_BASE).alias("base"))




@query(
    "f02_filter_nav_links",
    f"""WITH links AS (SELECT host AS site, page_id, title, {o.join('url', 'ref')} AS href, host FROM (SELECT page_id, url, {NAV_SCOPE} AS host,
      unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS ref, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title FROM pages))
    SELECT site, {o.canonical('href')} AS url, arg_min(trim(title, {o.WS}), page_id * 1000000 + length(title)) AS title FROM links
    WHERE trim(title, {o.WS}) <> '' AND {o.in_scope('href', 'host')} GROUP BY ALL""",
)
def f02(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.url import url_join

    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", pattern, F.lit(1)).alias("ref"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("title")
    )
    raw = table(spark, folder, "pages").select("page_id", "url", F.expr(NAV_SCOPE).alias("base"), F.explode(pairs).alias("link"))
    links = raw.select(
        F.col("base").alias("site"),
        "base",
        (F.col("page_id") * 1000000 + F.length("link.title")).alias("pos"),
        F.col("link.title").alias("title"),
        url_join("url", F.col("link.ref")).alias("href"),
    )
    return d.filter_nav_links(links).select("site", "url", "title")


@query("x01_discover", f"{CAP}, {DISCOVERED} SELECT site, url, rank, pos FROM discovered")
def x01(spark: SparkSession, folder: str) -> DataFrame:
    return _discovered(spark, folder)


def _discovered(spark: SparkSession, folder: str) -> DataFrame:
    return d.discover(bases(spark, folder), derived(spark, folder, "nav"), derived(spark, folder, "sitemap"))


@query("w01_first_wins", f"{CAP} SELECT site, url, min(page_id) AS page_id FROM cap GROUP BY site, url")
def w01(spark: SparkSession, folder: str) -> DataFrame:
    return first_wins(cap(spark, folder).select("site", "url", "page_id"), ["site", "url"], "page_id")


ALIAS = "SELECT u.site, u.url AS alias, coalesce(l.landed, u.url) AS url{more} FROM {table} u LEFT JOIN landed l ON l.site = u.site AND l.url = u.url"


@query("j01_resolve_alias", f"{CAP} {ALIAS.format(table='sitemap', more=', u.pos')}")
def j01(spark: SparkSession, folder: str) -> DataFrame:
    return d.resolve_alias(derived(spark, folder, "sitemap"), derived(spark, folder, "landed"))


NAV_SQL = f"""listed AS (SELECT site, url, title, 0 AS rank, 0 AS part, pos FROM ({ALIAS.format(table='nav', more=', u.title, u.pos')})
    UNION ALL SELECT site, url, NULL, 1, rank, pos FROM ({ALIAS.format(table='discovered', more=', u.rank, u.pos')})),
  reading AS MATERIALIZED (SELECT f.site, f.url, coalesce(f.title, c.title) AS title, f.rank, f.part, f.pos FROM (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY rank, part, pos) = 1) f
    JOIN captured c ON c.site = f.site AND c.url = f.url)"""


def reading_list(spark: SparkSession, folder: str, pages: str = "stored") -> DataFrame:
    return d.captured_nav(
        derived(spark, folder, "nav"),
        _discovered(spark, folder),
        derived(spark, folder, "landed"),
        derived(spark, folder, pages),
    )


@query("j02_captured_nav", f"{CAP}, {DISCOVERED}, {NAV_SQL} SELECT site, url, title, rank, part, pos FROM reading")
def j02(spark: SparkSession, folder: str) -> DataFrame:
    return reading_list(spark, folder, "captured")


@query("o02_nav_order", f"{STORED}, {DISCOVERED}, {NAV_SQL} SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY rank, part, pos, url) AS place FROM reading")
def o02(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.book import nav_order

    return nav_order(reading_list(spark, folder)).select("site", "url", F.col("nav_pos").alias("place"))


@query("j03_not_captured", f"{CAP} SELECT site, url, pos FROM sitemap s WHERE NOT EXISTS (SELECT 1 FROM captured c WHERE c.site = s.site AND c.url = s.url)")
def j03(spark: SparkSession, folder: str) -> DataFrame:
    return d.not_captured(derived(spark, folder, "sitemap"), derived(spark, folder, "captured"))


PROVENANCE = """provenance AS MATERIALIZED (SELECT c.site, c.url, EXISTS (SELECT 1 FROM sitemap s WHERE s.site = c.site AND s.url = c.url) AS in_sitemap,
  EXISTS (SELECT 1 FROM nav n WHERE n.site = c.site AND n.url = c.url) OR EXISTS (SELECT 1 FROM bases b WHERE b.site = c.site AND b.url = c.url) AS in_nav FROM captured c)"""


def _provenance(spark: SparkSession, folder: str) -> DataFrame:
    return d.provenance(
        derived(spark, folder, "captured").select("site", "url"),
        derived(spark, folder, "sitemap"),
        derived(spark, folder, "nav"),
        bases(spark, folder),
    )


@query(
    "j04_provenance",
    f"""{CAP}, {PROVENANCE} SELECT site, url, CASE WHEN in_sitemap AND in_nav THEN 'sitemap navigation' WHEN in_sitemap THEN 'sitemap' WHEN in_nav THEN 'navigation' ELSE 'entrypoint' END AS discovered_from FROM provenance""",
)
def j04(spark: SparkSession, folder: str) -> DataFrame:
    return _provenance(spark, folder).withColumn("discovered_from", F.array_join("discovered_from", " "))


@query(
    "a14_provenance_histogram",
    f"""{CAP}, {PROVENANCE}, sources AS (SELECT site, 'sitemap' AS source FROM provenance WHERE in_sitemap UNION ALL SELECT site, 'navigation' FROM provenance WHERE in_nav
      UNION ALL SELECT site, 'entrypoint' FROM provenance WHERE NOT in_sitemap AND NOT in_nav)
    SELECT site, source, count(*) AS pages FROM sources GROUP BY ROLLUP (site, source)""",
)
def a14(spark: SparkSession, folder: str) -> DataFrame:
    return d.provenance_histogram(_provenance(spark, folder))


@query("a11_site_urls", f"{STORED} SELECT DISTINCT site, url FROM captured")
def a11(spark: SparkSession, folder: str) -> DataFrame:
    return d.site_urls(derived(spark, folder, "stored"))


@query(
    "a13_enforce_page_cap",
    f"""{CAP}, {DISCOVERED} SELECT site, count(DISTINCT url) AS discovered, 'Discovered ' || count(DISTINCT url) || ' pages, above --max-pages 5.' AS message FROM discovered GROUP BY site HAVING count(DISTINCT url) > 5""",
)
def a13(spark: SparkSession, folder: str) -> DataFrame:
    return d.enforce_page_cap(_discovered(spark, folder), 5)


EXPECTED = "expected AS MATERIALIZED (SELECT site, url FROM sitemap UNION SELECT site, url FROM nav)"


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    return d.expected_urls(derived(spark, folder, "sitemap"), derived(spark, folder, "nav"))


@query("x02_expected_urls", f"{CAP}, {EXPECTED} SELECT site, url FROM expected")
def x02(spark: SparkSession, folder: str) -> DataFrame:
    return _expected(spark, folder)


MISSING = "SELECT e.site, e.url{more} FROM expected e WHERE NOT EXISTS (SELECT 1 FROM captured c WHERE c.site = e.site AND c.url = e.url)"


@query("j10_missing_pages", f"{CAP}, {EXPECTED} {MISSING.format(more='')}")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    return d.missing_pages(_expected(spark, folder), derived(spark, folder, "captured"))


@query("x03_expected_minus_captured", f"{CAP}, {EXPECTED} SELECT site, url FROM expected EXCEPT SELECT site, url FROM captured")
def x03(spark: SparkSession, folder: str) -> DataFrame:
    return d.expected_minus_captured(_expected(spark, folder), derived(spark, folder, "captured"))


@query(
    "v10_check_page_coverage",
    f"{CAP}, {EXPECTED} " + MISSING.format(more=", 'COVERAGE_MISSING_PAGE' AS code, 'error' AS severity, 'A discovered page was not captured.' AS message, 'validate' AS stage"),
)
def v10(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.checks import check_page_coverage

    return check_page_coverage(_expected(spark, folder), derived(spark, folder, "captured")).select(
        "site", "url", "code", "severity", "message", "stage"
    )


@query(
    "x04_same_set",
    f"{CAP}, {EXPECTED} (SELECT site, url, 'left' AS side FROM (SELECT site, url FROM expected EXCEPT SELECT site, url FROM captured)) UNION ALL (SELECT site, url, 'right' FROM (SELECT site, url FROM captured EXCEPT SELECT site, url FROM expected))",
)
def x04(spark: SparkSession, folder: str) -> DataFrame:
    return d.same_set(_expected(spark, folder), derived(spark, folder, "captured").select("site", "url"))


@query(
    "i01_incremental_capture",
    f"""{CAP}, fresh AS (SELECT s.site, coalesce(l.landed, s.url) AS url, s.url AS alias, s.pos FROM sitemap s LEFT JOIN landed l ON l.site = s.site AND l.url = s.url
      WHERE NOT EXISTS (SELECT 1 FROM captured c WHERE c.site = s.site AND c.url = s.url))
    SELECT f.site, f.url, f.alias, f.pos FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM captured c WHERE c.site = f.site AND c.url = f.url) QUALIFY row_number() OVER (PARTITION BY f.site, f.url ORDER BY f.pos) = 1""",
)
def i01(spark: SparkSession, folder: str) -> DataFrame:
    return d.incremental_capture(
        derived(spark, folder, "sitemap"), derived(spark, folder, "captured"), derived(spark, folder, "landed")
    )


@query(
    "i04_content_changes",
    f"""{CAP}, old AS (SELECT site, url, sha256(html) AS h FROM captured WHERE page_id % 5 <> 0),
    new AS (SELECT site, url, sha256(CASE WHEN page_id % 4 = 0 THEN html || ' ' ELSE html END) AS h FROM captured WHERE page_id % 6 <> 0)
    SELECT coalesce(o.site, n.site) AS site, coalesce(o.url, n.url) AS url, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old o FULL OUTER JOIN new n ON n.site = o.site AND n.url = o.url WHERE o.h IS DISTINCT FROM n.h""",
)
def i04(spark: SparkSession, folder: str) -> DataFrame:
    pages = derived(spark, folder, "captured")
    old = pages.filter("page_id % 5 <> 0").withColumn("content_hash", F.sha2("html", 256))
    edited = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    new = pages.filter("page_id % 6 <> 0").withColumn("content_hash", F.sha2(edited, 256))
    return d.content_changes(old, new)


SUMMARY_LINKS = 'href="([^"]*)"'


@query(
    "q01_capture_summary",
    f"""WITH cap AS MATERIALIZED (SELECT page_id, {o.canonical('url')} AS canonical, {o.part('url', 'netloc')} AS host, {LANG} AS lang,
      regexp_extract_all(html, '{SUMMARY_LINKS}', 1) AS refs, url FROM pages),
    kept AS MATERIALIZED (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY host, canonical ORDER BY page_id) = 1),
    links AS (SELECT host, {o.join('url', 'ref')} AS href FROM (SELECT host, url, unnest(refs) AS ref FROM kept)),
    targets AS (SELECT l.host, count(*) AS links, count(*) FILTER (WHERE {o.part('href', 'netloc')} = l.host) AS internal,
      count(k.canonical) AS resolved FROM links l LEFT JOIN kept k ON k.host = l.host AND k.canonical = {o.canonical('l.href')} GROUP BY l.host)
    SELECT c.host, count(*) AS captures, count(DISTINCT canonical) AS pages, count(DISTINCT lang) AS languages,
      coalesce(any_value(t.links), 0) AS links, coalesce(any_value(t.internal), 0) AS internal_links, coalesce(any_value(t.internal - t.resolved), 0) AS broken_links
    FROM cap c LEFT JOIN targets t ON t.host = c.host GROUP BY c.host""",
)
def q01(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.summary import capture_summary

    return capture_summary(table(spark, folder, "pages"))


