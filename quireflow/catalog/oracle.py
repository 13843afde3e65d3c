"""SQL building blocks for the checks, written for DuckDB and apart from the Spark code."""

from __future__ import annotations

from .registry import lit

WS = lit(" \t\n\u000b\u000c\r")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?'"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


def part(x: str, name: str) -> str:
    group = ("scheme", "netloc", "path", "query", "fragment").index(name) + 1
    found = f"regexp_extract({x}, {SPLIT_URL}, {group})"
    return lower(found) if name == "scheme" else found


def assemble(scheme: str, netloc: str, path: str, query: str, fragment: str) -> str:
    return f"""(SELECT (CASE WHEN _s = '' THEN '' ELSE _s || ':' END)
      || (CASE WHEN _n <> '' OR (_s IN ('http','https','file','ftp','ws','wss') AND NOT starts_with(_p, '//'))
            THEN '//' || _n || (CASE WHEN _p = '' OR starts_with(_p, '/') THEN _p ELSE '/' || _p END)
            ELSE _p END)
      || (CASE WHEN _q = '' THEN '' ELSE '?' || _q END) || (CASE WHEN _f = '' THEN '' ELSE '#' || _f END)
      FROM (SELECT {scheme} AS _s, {netloc} AS _n, {path} AS _p, {query} AS _q, {fragment} AS _f))"""


def canonical(x: str) -> str:
    """String surgery on the defragmented URL, for authority URLs (all test URLs are)."""
    bare = f"regexp_replace({x}, '[?#][\\s\\S]*$', '')"
    head = f"regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')"
    tail = f"regexp_replace(substr({bare}, length({head}) + 1), '/+', '/', 'g')"
    return f"({lower(f'split_part({head}, chr(58), 1)')} || substr({head}, length(split_part({head}, ':', 1)) + 1) || CASE WHEN {tail} IN ('', '/') THEN '/' ELSE rtrim({tail}, '/') END)"


def dots(path: str) -> str:
    """Dot-segment removal by folding a string: each step appends a segment or cuts the last one."""
    return f"""(SELECT CASE WHEN starts_with(_p, '/') THEN _o ELSE substr(_o, 2) END FROM (SELECT _p,
      list_reduce(list_prepend('', _l), lambda a, s: CASE WHEN s = '.' THEN a
        WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)
      || (CASE WHEN _l[-1] IN ('.', '..') THEN '/' ELSE '' END) AS _o
      FROM (SELECT _p, string_split(CASE WHEN starts_with(_p, '/') THEN substr(_p, 2) ELSE _p END, '/') AS _l
        FROM (SELECT {path} AS _p))))"""


def join(base: str, ref: str) -> str:
    return f"""(SELECT CASE WHEN _b = '' THEN _r WHEN _r = '' THEN _b
      WHEN _rs <> '' AND _rs <> _bs THEN _r
      WHEN starts_with(_after, '//') THEN {assemble('_bs', part('_r', 'netloc'), dots('_rp'), '_rq', '_rf')}
      WHEN _rp = '' THEN {assemble('_bs', '_bn', '_bp', "CASE WHEN _rq = '' THEN _bq ELSE _rq END", '_rf')}
      WHEN starts_with(_rp, '/') THEN {assemble('_bs', '_bn', dots('_rp'), '_rq', '_rf')}
      WHEN _bn <> '' AND _bp = '' THEN {assemble('_bs', '_bn', dots("'/' || _rp"), '_rq', '_rf')}
      ELSE {assemble('_bs', '_bn', dots("regexp_replace(_bp, '[^/]*$', '') || _rp"), '_rq', '_rf')} END
      FROM (SELECT *, CASE WHEN _rs = '' THEN _r ELSE substr(_r, length(_rs) + 2) END AS _after FROM (
        SELECT _b, _r, {part('_b', 'scheme')} AS _bs, {part('_b', 'netloc')} AS _bn, {part('_b', 'path')} AS _bp,
          {part('_b', 'query')} AS _bq, {part('_r', 'scheme')} AS _rs, {part('_r', 'path')} AS _rp,
          {part('_r', 'query')} AS _rq, {part('_r', 'fragment')} AS _rf
        FROM (SELECT {base} AS _b, {ref} AS _r))))"""


def in_scope(url: str, base: str) -> str:
    base_path = f"rtrim({part(base, 'path')}, '/')"
    return (
        f"({part(url, 'scheme')} IN ('http', 'https') AND {part(url, 'netloc')} = {part(base, 'netloc')} AND "
        f"({base_path} = '' OR {part(url, 'path')} = {base_path} OR starts_with({part(url, 'path')}, {base_path} || '/')))"
    )


def dashed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^A-Za-z0-9._-]+', '-', 'g'), '-')"


def route_name(x: str) -> str:
    named = dashed(f"trim({x}, '/')")
    return f"(CASE WHEN {named} IN ('', '.', '..') THEN 'index' ELSE {named} END)"


def xml_id(x: str) -> str:
    named = dashed(f"trim({x}, {WS})")
    return f"(CASE WHEN {named} = '' THEN 'id' WHEN regexp_matches({named}, '^[A-Za-z_]') THEN {named} ELSE 'id-' || {named} END)"


def chapter_name(route: str, url: str) -> str:
    return f"({route_name(route)} || '-' || left(sha256({url}), 8) || '.xhtml')"


def site_key(url: str) -> str:
    flat = f"replace(trim({part(url, 'path')}, '/'), '/', '-')"
    return f"({part(url, 'netloc')} || '-' || CASE WHEN {flat} = '' THEN 'root' ELSE {flat} END)"


def escape(x: str) -> str:
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {lit(plain)}, '{reference}')"
    return x


def words(x: str) -> str:
    for plain, folded in (
        ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"),
        ("\u2014", "-"), ("\u00a0", " "), ("\u202f", " "), ("\u2026", "..."),
        ("*", ""), ("_", ""), ("`", ""), ("\\", ""),
    ):
        x = f"replace({x}, {lit(plain)}, {lit(folded)})"
    return lower(f"trim(regexp_replace({x}, '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g'))")


def strip_markdown(x: str) -> str:
    return f"""regexp_replace(array_to_string(list_transform(string_split({x}, '`'),
      lambda s, i: CASE WHEN i % 2 = 0 THEN s ELSE regexp_replace(s, '</?[A-Za-z][^<>]*>', '', 'g') END), '`'),
      '!?\\[([^\\]]*)\\](?:\\([^)]*\\)|\\[[^\\]]*\\])', '\\1', 'g')"""


def strip_bullet(x: str) -> str:
    space = "[ \\t\\n\\x0b\\x0c\\r]"
    return f"regexp_replace({x}, '^(?:>{space}*)*(?:[*+\\-]|[0-9]+[.)]){space}+|^(?:>{space}*)+', '')"


def luminance(r: str, g: str, b: str) -> str:
    def linear(x: str) -> str:
        return f"(CASE WHEN {x} / 255.0 <= 0.04045 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END)"

    return f"(0.2126 * {linear(r)} + 0.7152 * {linear(g)} + 0.0722 * {linear(b)})"
