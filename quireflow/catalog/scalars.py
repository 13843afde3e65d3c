"""Scalar functions over whole tables: URLs, identifiers, text, media types and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import color, ids, media, text, url
from . import oracle as o
from .registry import Source, lit, query, scalar_query, table

# Each page URL in one of several shapes: upper-case scheme, dot segments, doubled
# slashes, empty fragment, query with reserved characters.
URL_SHAPES = """CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN replace(url, 'https:', 'HTTPS:')
 WHEN 2 THEN concat(url, '//a/./b/../c/') WHEN 3 THEN replace(url, '.com/', '.com//x//')
 WHEN 4 THEN concat(replace(url, 'http://', 'ftp://'), '#') WHEN 5 THEN concat(url, '?q=a b|c#f?g')
 ELSE concat(substr(url, 1, 8), replace(substr(url, 9), '/', '//'), '/') END"""
URLS = Source("pages", ("page_id", "url", f"{URL_SHAPES} AS u"))

REFERENCES = """CASE page_id % 13 WHEN 0 THEN regexp_extract(html, 'href="([^"]*)"', 1) WHEN 1 THEN 'g' WHEN 2 THEN './g/'
 WHEN 3 THEN '../../g' WHEN 4 THEN '//other.example/g' WHEN 5 THEN '#s' WHEN 6 THEN '?y'
 WHEN 7 THEN 'https://x/y/../z' WHEN 8 THEN 'http:rel/x' WHEN 9 THEN 'mailto:a@b.example' WHEN 10 THEN ''
 WHEN 11 THEN '/a/b/../../../c/.' ELSE concat('x/', page_id, '/..') END"""
JOINS = Source("pages", ("page_id", "url", f"{REFERENCES} AS ref"))

PATHS = Source(
    "pages",
    (
        "page_id",
        """CASE page_id % 6 WHEN 0 THEN concat('/a/./b/', page_id, '/../c') WHEN 1 THEN '../x/..'
        WHEN 2 THEN concat('/', page_id, '/.') WHEN 3 THEN concat('a/b//../', page_id) WHEN 4 THEN '/../..'
        ELSE regexp_extract(url, '[a-z]/(.*)', 1) END AS path""",
    ),
)

scalar_query(
    "u01_url_parts",
    URLS,
    ("page_id",),
    {
        name: (lambda name=name: url.url_parts("u")[name], o.part("u", name))
        for name in ("scheme", "netloc", "path", "query", "fragment")
    },
)
scalar_query(
    "u02_url_build",
    URLS,
    ("page_id",),
    {
        "rebuilt": (
            lambda: url.url_build(url.url_parts("u")),
            o.assemble(*(o.part("u", n) for n in ("scheme", "netloc", "path", "query", "fragment"))),
        )
    },
)
scalar_query(
    "u03_remove_dot_segments",
    PATHS,
    ("page_id",),
    {"resolved": (lambda: url.remove_dot_segments("path"), o.dots("path"))},
)
scalar_query("u04_url_join", JOINS, ("page_id", "ref"), {"joined": (lambda: url.url_join("url", "ref"), o.join("url", "ref"))})
scalar_query(
    "u05_url_defrag",
    URLS,
    ("page_id",),
    {
        "bare": (lambda: url.url_defrag("u")["url"], "split_part(u, '#', 1)"),
        "fragment": (
            lambda: url.url_defrag("u")["fragment"],
            "CASE WHEN contains(u, '#') THEN substr(u, strpos(u, '#') + 1) ELSE '' END",
        ),
    },
)
scalar_query("u06_canonical_url", URLS, ("page_id",), {"canonical": (lambda: url.canonical_url("u"), o.canonical("u"))})

SCOPES = Source(
    "pages",
    (
        "page_id",
        f"{URL_SHAPES} AS u",
        """CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]*/[a-z]*)', 1)
        WHEN 1 THEN concat(regexp_extract(url, '^(https?://[^/]*/[a-z]*)', 1), '/') WHEN 2 THEN url
        ELSE concat(regexp_extract(url, '^(https?://[^/]*)', 1), '/e') END AS base""",
    ),
)
scalar_query("u07_in_scope", SCOPES, ("page_id",), {"scoped": (lambda: url.in_scope("u", "base"), o.in_scope("u", "base"))})
scalar_query(
    "u08_candidate_urls",
    SCOPES,
    ("page_id",),
    {
        "candidates": (
            lambda: F.array_join(url.candidate_urls("base", "sitemap.xml"), " "),
            f"""CASE WHEN rtrim(base, '/') || '/sitemap.xml' = {o.part('base', 'scheme')} || '://' || {o.part('base', 'netloc')} || '/sitemap.xml'
            THEN rtrim(base, '/') || '/sitemap.xml' ELSE rtrim(base, '/') || '/sitemap.xml ' ||
            {o.part('base', 'scheme')} || '://' || {o.part('base', 'netloc')} || '/sitemap.xml' END""",
        )
    },
)
scalar_query("u09_host", URLS, ("page_id",), {"host": (lambda: url.host("u"), "regexp_extract(u, '^[^:]*://([^/?#]*)', 1)")})

scalar_query("h01_sha256_hex", URLS, ("page_id",), {"digest": (lambda: ids.sha256_hex("u"), "sha256(u)")})
UUID_HEX = f"sha1(unhex('{ids.URL_NAMESPACE_HEX}') || encode(url))"
scalar_query(
    "h02_uuid5_url",
    URLS,
    ("page_id",),
    {
        "uuid": (
            lambda: ids.uuid5_url("url"),
            f"""(SELECT left(d, 8) || '-' || d[9:12] || '-5' || d[14:16] || '-'
            || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17]), 1) || d[18:20] || '-' || d[21:32]
            FROM (SELECT {UUID_HEX} AS d))""",
        )
    },
)
scalar_query("h03_page_key", URLS, ("page_id",), {"page_key": (lambda: ids.page_key("u"), "left(sha256(u), 16)")})
NAMES = Source(
    "pages",
    (
        "page_id",
        "url",
        """CASE page_id % 6 WHEN 0 THEN regexp_extract(url, '//[^/]*([^?#]*)', 1) WHEN 1 THEN concat('/guide/step ', page_id, '/')
        WHEN 2 THEN '..' WHEN 3 THEN concat('  ', page_id, ' / Score & Confidence ') WHEN 4 THEN '--'
        ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS name""",
    ),
)
scalar_query("h04_route_name", NAMES, ("page_id",), {"route_name": (lambda: ids.route_name("name"), o.route_name("name"))})
scalar_query(
    "h05_xml_id",
    NAMES,
    ("page_id",),
    {
        "xml_id": (lambda: ids.xml_id("name"), o.xml_id("name")),
        "again": (lambda: ids.xml_id(ids.xml_id("name")), o.xml_id("name")),
    },
)
scalar_query(
    "h06_chapter_name", NAMES, ("page_id",), {"file": (lambda: ids.chapter_name("name", "url"), o.chapter_name("name", "url"))}
)
scalar_query("h07_workspace_name", URLS, ("page_id",), {"site": (lambda: ids.workspace_name("u"), o.site_key("u"))})
MEDIA = Source(
    "pages",
    (
        "page_id",
        """CASE page_id % 5 WHEN 0 THEN concat('https://a.example/i/', page_id, '.PNG') WHEN 1 THEN concat('https://a.example/', page_id)
        WHEN 2 THEN concat('https://a.example/v1.2/.hidden', page_id) WHEN 3 THEN concat('https://a.example/p.', page_id, '.webp?x=1')
        ELSE url END AS u""",
        """CASE page_id % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN ' Image/JPEG ; q=1' WHEN 2 THEN 'image/svg+xml; charset=utf-8'
        WHEN 3 THEN 'text/html' WHEN 4 THEN '' WHEN 5 THEN 'image/vnd.microsoft.icon' WHEN 6 THEN 'image/webp' ELSE 'image/avif' END AS kind""",
        "CAST(CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 204 WHEN 2 THEN 301 ELSE 200 END AS INT) AS status",
        """CASE page_id % 9 WHEN 0 THEN 'a.b.SVG' WHEN 1 THEN 'x.Jpeg' WHEN 2 THEN 'y.xhtml' WHEN 3 THEN '.png' WHEN 4 THEN 'noext'
        WHEN 5 THEN 'dir.d/z' WHEN 6 THEN concat('im/', page_id, '.css') WHEN 7 THEN 'w.webp' ELSE 'v.avif' END AS file""",
        "CASE page_id % 5 WHEN 0 THEN 'webp' WHEN 1 THEN 'Heif' WHEN 2 THEN 'png' WHEN 3 THEN 'magick7' ELSE 'jpeg' END AS format",
    ),
)


def _map_sql(pairs: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"(CASE {key} {cases} ELSE '{default}' END)"


def _extension_sql(x: str) -> str:
    name = f"split_part({x}, '/', -1)"
    return f"regexp_extract({name}, '.(\\.[^.]*)$', 1)"


TYPE_SQL = _map_sql(media.EXTENSION_BY_MEDIA_TYPE, o.lower(f"trim(split_part(kind, ';', 1), {o.WS})"), "")
PATH_EXTENSION_SQL = _extension_sql(o.part("u", "path"))
scalar_query(
    "h08_asset_name",
    MEDIA,
    ("page_id",),
    {
        "asset": (
            lambda: ids.asset_name("u", "kind"),
            f"left(sha256(u), 20) || CASE WHEN {TYPE_SQL} <> '' THEN {TYPE_SQL} WHEN {PATH_EXTENSION_SQL} <> '' THEN {PATH_EXTENSION_SQL} ELSE '.bin' END",
        )
    },
)
HTML = Source("pages", ("page_id", "html"))
scalar_query("h09_content_hash", HTML, ("page_id",), {"content_hash": (lambda: ids.content_hash("html"), "sha256(html)")})

DOCS = Source("documents", ("doc_id", "text", "source", "lang"))
PADDED = Source("documents", ("doc_id", "concat('  ', text, '  ') AS text"))
scalar_query(
    "t01_strip_ws",
    PADDED,
    ("doc_id",),
    {
        "stripped": (lambda: text.strip_ws("text"), f"trim(text, {o.WS})"),
        "no_dots": (lambda: text.strip_chars("text", " ."), "trim(text, ' .')"),
    },
)
scalar_query("t02_ascii_lower", DOCS, ("doc_id",), {"lowered": (lambda: text.ascii_lower("text"), o.lower("text"))})
scalar_query(
    "t03_starts_with_any",
    DOCS,
    ("doc_id",),
    {
        "starts": (
            lambda: text.starts_with_any("text", ("The", "De", "En", "É")),
            "regexp_matches(text, '^(The|De|En|É)')",
        )
    },
)
scalar_query("t04_escape_html", HTML, ("page_id",), {"escaped": (lambda: text.escape_html("html"), o.escape("html"))})
scalar_query(
    "t05_base64",
    DOCS,
    ("doc_id",),
    {
        "encoded": (lambda: text.base64_encode(F.encode("text", "UTF-8")), "to_base64(encode(text))"),
        "decoded": (
            lambda: F.decode(
                text.base64_decode(
                    F.regexp_replace(
                        F.regexp_replace(text.base64_encode(F.encode("text", "UTF-8")), "=", ""), "A", "A \n-"
                    )
                ),
                "UTF-8",
            ),
            "text",
        ),
    },
)
BODIES = Source(
    "pages",
    (
        "page_id",
        "CASE page_id % 3 WHEN 0 THEN html ELSE replace(html, '<meta charset=\"utf-8\">', '') END AS page",
        "CASE page_id % 4 WHEN 0 THEN 'E9' WHEN 1 THEN 'C0AF' WHEN 2 THEN '' ELSE 'C3A9' END AS tail",
        "CAST(CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 204 ELSE 200 END AS INT) AS status",
        "CASE page_id % 7 WHEN 0 THEN 'Text/HTML; charset=latin1' WHEN 1 THEN 'application/xml' ELSE 'Text/html' END AS kind",
    ),
)
def _body() -> Column:
    return F.concat(F.encode("page", "UTF-8"), F.unhex("tail"))


_UTF8_SQL = "(TRY(decode(encode(page) || unhex(tail))) IS NOT NULL)"
_DECLARES_SQL = "regexp_matches(lower(page[1:1024]), '<meta[^>]*charset')"
scalar_query("t06_valid_utf8", BODIES, ("page_id",), {"valid": (lambda: text.valid_utf8(_body()), _UTF8_SQL)})
scalar_query(
    "t07_declares_charset", BODIES, ("page_id",), {"declared": (lambda: text.declares_charset(_body()), _DECLARES_SQL)}
)
scalar_query(
    "t08_decide_charset",
    BODIES,
    ("page_id",),
    {
        "charset": (
            lambda: text.decide_charset("status", "kind", _body()),
            f"""CASE WHEN status BETWEEN 200 AND 299 AND status <> 204 AND kind ILIKE 'text/html%' AND kind NOT ILIKE '%charset=%'
            AND NOT {_DECLARES_SQL} AND {_UTF8_SQL} THEN 'utf-8' END""",
        )
    },
)
MARKED = Source(
    "documents",
    (
        "doc_id",
        """replace(replace(replace(text, ' the ', ' “the’ — '), ' de ', ' *de* _x_… '), ' of ',
        ' [of `a<b>c`](http://x.example/y) <em class="q">`<i>`</em> ![im][r] ') AS marked""",
    ),
)
scalar_query("t09_normalize_words", MARKED, ("doc_id",), {"words": (lambda: text.normalize_words("marked"), o.words("marked"))})
scalar_query(
    "t11_strip_markdown",
    MARKED,
    ("doc_id",),
    {"plain": (lambda: text.strip_markdown("marked"), o.strip_markdown("marked"))},
)
TITLES = Source(
    "pages",
    (
        "page_id",
        "CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '//([^/]*)', 1) ELSE '' END AS og",
        "CASE page_id % 3 WHEN 0 THEN ' App ' ELSE '  ' END AS app",
        """CASE page_id % 5 WHEN 0 THEN concat(regexp_extract(html, '<title>([^<]*)', 1), ' | A - B | ', page_id, ' ')
        WHEN 1 THEN concat('x - y – z - ', page_id) WHEN 2 THEN 'a-b' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title""",
    ),
)
scalar_query(
    "t12_site_name",
    TITLES,
    ("page_id",),
    {
        "name": (
            lambda: text.site_name("og", "app", "title"),
            f"""(SELECT CASE WHEN og <> '' THEN og WHEN trim(app) <> '' THEN trim(app) WHEN s = '' THEN t
            ELSE trim(split_part(t, s, -1)) END FROM (SELECT t, regexp_extract(t, '\\s[|–—-]\\s') AS s
            FROM (SELECT trim(title, {o.WS}) AS t)))""",
        )
    },
)
scalar_query(
    "t13_truncate_tail",
    DOCS,
    ("doc_id",),
    {"tail": (lambda: text.truncate_tail("text"), "CASE WHEN length(text) > 4000 THEN right(text, 4000) ELSE text END")},
)
scalar_query(
    "t14_format_message",
    Source("documents", ("doc_id", "n_chars")),
    ("doc_id",),
    {
        "message": (
            lambda: text.format_message("Heading level jumps from h%d to h%d.", F.col("doc_id"), F.col("n_chars")),
            "'Heading level jumps from h' || doc_id || ' to h' || n_chars || '.'",
        )
    },
)
scalar_query(
    "t15_timestamps",
    Source("events", ("event_id", "ts")),
    ("event_id",),
    {
        "stamp": (lambda: text.utc_timestamp(F.col("ts")), "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"),
        "day": (lambda: text.capture_date(F.col("ts")), "strftime(ts, '%Y-%m-%d')"),
    },
)
JSONS = Source(
    "documents",
    ("doc_id", """concat('{"title": "', source, '", "n": ', n_chars, ', "o": {"title": null}}') AS js"""),
)
scalar_query(
    "t16_json_text",
    JSONS,
    ("doc_id",),
    {
        "title": (lambda: text.json_text("js", "title"), "coalesce(js ->> '$.title', '')"),
        "number": (lambda: text.json_text("js", "n"), "''"),
        "absent": (lambda: text.json_text("js", "zz"), "''"),
    },
)

scalar_query(
    "c01_extension_for_media_type",
    MEDIA,
    ("page_id",),
    {"extension": (lambda: media.extension_for_media_type("kind"), TYPE_SQL)},
)
scalar_query(
    "c02_media_type_for_file",
    MEDIA,
    ("page_id",),
    {
        "media_type": (
            lambda: media.media_type_for_file("file"),
            _map_sql(media.MEDIA_TYPE_BY_EXTENSION, f"lower({_extension_sql('file')})", "application/octet-stream"),
        )
    },
)
COLORS = Source(
    "pages",
    (
        "page_id",
        """CASE page_id % 5 WHEN 0 THEN concat('#', lpad(hex(page_id * 7919 % 16777216), 6, '0')) WHEN 1 THEN concat(' ', lpad(hex(page_id * 31 % 4096), 3, '0'), ' ')
        WHEN 2 THEN '#12345' WHEN 3 THEN 'teal' ELSE lower(lpad(hex(page_id * 104729 % 16777216), 6, '0')) END AS value""",
    ),
)
_RGB_SQL = f"""(SELECT CASE WHEN length(h) = 3 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] WHEN length(h) = 6 THEN h END
  FROM (SELECT regexp_extract(trim(value, {o.WS}), '^#?([0-9A-Fa-f]{{3}}|[0-9A-Fa-f]{{6}})$', 1) AS h))"""


def _channel_sql(at: int) -> str:
    return f"CAST(('0x' || substr({_RGB_SQL}, {at}, 2))::INT AS DOUBLE)"


scalar_query(
    "c03_parse_hex_color",
    COLORS,
    ("page_id",),
    {
        name: (lambda name=name: color.parse_hex_color("value")[name], _channel_sql(at))
        for name, at in (("r", 1), ("g", 3), ("b", 5))
    },
)
scalar_query(
    "c04_chroma_luminance",
    COLORS,
    ("page_id",),
    {
        "chroma": (
            lambda: color.chroma(color.parse_hex_color("value")),
            f"greatest({_channel_sql(1)}, {_channel_sql(3)}, {_channel_sql(5)}) - least({_channel_sql(1)}, {_channel_sql(3)}, {_channel_sql(5)})",
        ),
        "luminance": (
            lambda: F.round(color.luminance(color.parse_hex_color("value")), 9),
            f"round({o.luminance(_channel_sql(1), _channel_sql(3), _channel_sql(5))}, 9)",
        ),
    },
)
scalar_query(
    "c05_accept_icon",
    MEDIA,
    ("page_id",),
    {
        "accepted": (
            lambda: media.accept_icon("kind", "status"),
            f"(status >= 200 AND status < 300 AND {TYPE_SQL} NOT IN ('', '.ico'))",
        )
    },
)
scalar_query(
    "c06_normalized_image_name",
    MEDIA,
    ("page_id",),
    {
        "output": (
            lambda: media.normalized_image_name("file", "format"),
            f"""CASE WHEN lower({_extension_sql('file')}) = '.svg' OR regexp_matches(lower(format), '^(webp|heif|tiff|magick)')
            THEN left(split_part(file, '/', -1), length(split_part(file, '/', -1)) - length({_extension_sql('file')})) || '.png'
            ELSE split_part(file, '/', -1) END""",
        )
    },
)
