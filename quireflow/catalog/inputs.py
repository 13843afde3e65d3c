"""Inputs the queries derive from the test tables, each with the SQL that derives the same.

The pages hold few element kinds, so ``rich_pages`` writes a fixed tail of
markup, numbered by page, into every article of the whole table. Its links lead
to the next page, to the page itself, and nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import markup
from .registry import lit, spread, table

SITE = "regexp_extract(url, 'example.(com|net|org)', 1)"

TAIL = """concat('<h', 1 + page_id % 6, ' id="a b">Step &amp; go</h', 1 + page_id % 6, '><h', 1 + (page_id * 5) % 6,
 ' id="a-b">Two</h', 1 + (page_id * 5) % 6, '><h3 id="a b">Again</h3><h3 id="a b-2">Clash</h3><details class="d"><summary>More</summary>',
 '<summary>No</summary><p>Body<custom><div style="display:none">x</div></custom></details>',
 '<p>Icon <img src="/i/', page_id, '.png" alt=""> and <img src="j.webp" alt="ok"></p><img src="b.png" onclick="x()">',
 '<table><tr><td>Level<td>Value<tr><td>High<td>', page_id, '</table><table><tr><th>H</th></tr><tr><td>1</td></tr></table>',
 '<pre>Name  Score  Note', chr(10), 'Alpha  0.91  High', chr(10), 'Beta  ', page_id, '  Mid', chr(10), 'Gamma  1  Low', chr(10),
 CASE WHEN page_id % 3 = 0 THEN 'odd line' ELSE 'x  y' END, chr(10), '</pre><pre>plain', chr(10), 'code</pre>',
 '<a href="#a b">self</a> <a href="#">top</a> <a href="mailto:x@y.example">mail</a> <a href="data:text/plain,x">data</a> ',
 '<a href="', next_url, '">next</a> <a href="', url, '">own</a> <a href="/gone/', page_id, '#x y">gone</a> ',
 '<a class="perma" href="#q"><span></span></a><span class="s"><div>soft</div><b>bold<ul><li>item<li>two</ul></b></span>',
 '<div role="tablist"><span role="tab" aria-controls="p1">One</span><span role="tab" aria-controls="p2">Two</span></div>',
 '<div id="p1" hidden role="tabpanel">panel one</div>', CASE WHEN page_id % 2 = 0 THEN '<div id="p2" aria-hidden="true">panel two</div>' ELSE '' END,
 '<svg aria-label="Flow"><g><svg></svg></g></svg><math xmlns="http://www.w3.org/1998/Math/MathML"><mi>e</mi><mn>', page_id, '</mn></math>',
 '<iframe src="/frame/', page_id, '" title="Demo"></iframe><div aria-hidden="true">hid</div><button>push</button><h5>End</h5>')"""

RICH = f"replace(html, '</article>', concat({TAIL}, '</article>'))"
PAIRED_SQL = """(SELECT p.page_id, p.url, p.html, coalesce(q.url, '') AS next_url FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 1)"""
RICH_SQL = f"(SELECT page_id, url, {SITE} AS site, {RICH} AS html FROM {PAIRED_SQL})"
PLAIN_SQL = f"(SELECT page_id, url, {SITE} AS site, html FROM pages)"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"), "page_id").selectExpr("page_id", "url", f"{SITE} AS site", "html")


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "pages")
    following = raw.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return (
        spread(raw, "page_id")
        .join(following, "page_id", "left")
        .fillna("", ["next_url"])
        .selectExpr("page_id", "url", f"{SITE} AS site", f"{RICH} AS html")
    )


def nodes(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return markup.parse_html(pages(spark, folder), "page_id", "html", *keep)


def rich_nodes(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return markup.parse_html(rich_pages(spark, folder), "page_id", "html", *keep)


TOKENS = lit(markup.TOKEN_PATTERN)
NAME = "'^</?([A-Za-z][^\\s/>]*)'"
RAW = "'(?i)^<(?:script|style)[\\s/>]'"
ATTRIBUTE = lit(markup.ATTRIBUTE_PATTERN)
_PAIRS = ", ".join(f"'{old}>{new}'" for old, news in markup.IMPLIED_END.items() for new in news)
_RANKS = " ".join(f"WHEN '{tag}' THEN {rank}" for tag, rank in markup.END_RANK.items())
_VOID = ", ".join(f"'{tag}'" for tag in markup.VOID_TAGS)


def rank(x: str) -> str:
    return f"(CASE {x} {_RANKS} ELSE {markup.DEFAULT_RANK} END)"


def unescape(x: str) -> str:
    """References found in the test pages: four common names, copy, middot, and none numeric."""
    for reference, plain in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        x = f"replace({x}, '{reference}', {lit(plain)})"
    return x


def tokens_sql(source: str) -> str:
    """CTE list ending in ``tok``: every token with its position and kind, without element structure."""
    return f"""src AS MATERIALIZED (SELECT * FROM {source}),
 raw_tokens AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i
   FROM (SELECT page_id, regexp_extract_all(html, {TOKENS}, 0) AS t FROM src)),
 pieces AS (
   SELECT page_id, i, 0 AS j, tok, '' AS raw FROM raw_tokens WHERE NOT regexp_matches(tok, {RAW})
   UNION ALL SELECT page_id, i, 0, regexp_extract(tok, '^<[^>]*>'), 'open' FROM raw_tokens WHERE regexp_matches(tok, {RAW})
   UNION ALL SELECT page_id, i, 1, regexp_replace(regexp_replace(tok, '^<[^>]*>', ''), '</[^<>]*>$', ''), 'text' FROM raw_tokens
     WHERE regexp_matches(tok, {RAW}) AND regexp_replace(regexp_replace(tok, '^<[^>]*>', ''), '</[^<>]*>$', '') <> ''
   UNION ALL SELECT page_id, i, 2, regexp_extract(tok, '</[^<>]*>$'), 'close' FROM raw_tokens WHERE regexp_matches(tok, {RAW})),
 tok AS MATERIALIZED (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos, tok AS source, raw,
   CASE WHEN raw <> '' THEN raw WHEN starts_with(tok, '<!--') THEN 'comment' WHEN regexp_matches(tok, '^<[!?]') THEN 'other'
     WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close'
     WHEN regexp_matches(tok, '^<[A-Za-z]') THEN CASE WHEN lower(regexp_extract(tok, {NAME}, 1)) IN ({_VOID}) OR ends_with(tok, '/>') THEN 'void' ELSE 'open' END
     ELSE 'text' END AS code,
   lower(regexp_extract(tok, {NAME}, 1)) AS tag FROM pieces)"""


def nodes_sql(source: str, *keep: str) -> str:
    """CTE list ending in ``nodes``: a token walk with an explicit stack, one token of every page per step."""
    kept = "".join(f", s.{name}" for name in keep)
    return f"""RECURSIVE {tokens_sql(source)},
 walk AS (
   SELECT page_id, CAST(-1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS tags, CAST([] AS BIGINT[]) AS spots,
     CAST([] AS BIGINT[]) AS popped, CAST(-1 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth FROM src
   UNION ALL
   SELECT page_id, pos, CASE WHEN code = 'open' THEN list_append(left_tags, tag) ELSE left_tags END,
     CASE WHEN code = 'open' THEN list_append(left_at, pos) ELSE left_at END, popped,
     CASE WHEN len(left_at) = 0 THEN -1 ELSE left_at[-1] END, len(left_at) + 1
   FROM (SELECT page_id, pos, code, tag, tags[1:len(tags) - k] AS left_tags, spots[1:len(spots) - k] AS left_at, spots[len(spots) - k + 1:len(spots)] AS popped
     FROM (SELECT t.page_id, t.pos, t.code, t.tag, w.tags, w.spots,
       CASE WHEN t.code IN ('open', 'void') THEN
         coalesce(list_position(list_transform(list_reverse(w.tags), lambda x: (x || '>' || t.tag) IN ({_PAIRS})), false) - 1, len(w.tags))
       WHEN t.code = 'close' AND list_contains(w.tags, t.tag) AND len(list_filter(
           list_reverse(w.tags)[1:list_position(list_reverse(w.tags), t.tag) - 1], lambda x: {rank('x')} > {rank('t.tag')})) = 0
         THEN list_position(list_reverse(w.tags), t.tag) ELSE 0 END AS k
       FROM walk w JOIN tok t ON t.page_id = w.page_id AND t.pos = w.pos + 1))),
 closings AS (SELECT page_id, unnest(popped) AS opened, pos AS closed_at FROM walk),
 page_ends AS (SELECT page_id, max(pos) + 1 AS n FROM tok GROUP BY page_id),
 nodes AS MATERIALIZED (SELECT t.page_id{kept}, t.pos, w.parent, w.depth,
   CASE WHEN t.code = 'open' THEN coalesce(c.closed_at, e.n) ELSE t.pos END AS closed_at,
   CASE WHEN t.code IN ('open', 'void') THEN 'element' WHEN t.code = 'comment' THEN 'comment' ELSE 'text' END AS kind,
   CASE WHEN t.code IN ('open', 'void') THEN t.tag ELSE '' END AS tag,
   CASE WHEN t.code IN ('open', 'void') THEN list_transform(list_zip(
       regexp_extract_all(regexp_replace(regexp_replace(source, {NAME}, ''), '/?>$', ''), {ATTRIBUTE}, 1),
       regexp_extract_all(regexp_replace(regexp_replace(source, {NAME}, ''), '/?>$', ''), {ATTRIBUTE}, 3)),
     lambda z: struct_pack(name := lower(z[1]), value := {unescape("regexp_replace(coalesce(z[2], ''), '^[\"'']|[\"'']$', '', 'g')")})) ELSE [] END AS attrs,
   CASE WHEN t.raw = 'text' THEN source WHEN t.code = 'text' THEN {unescape('source')} WHEN t.code = 'comment'
     THEN regexp_replace(source, '^<!--|-->$', '', 'g') END AS text
   FROM tok t JOIN walk w USING (page_id, pos) JOIN page_ends e USING (page_id) JOIN src s USING (page_id)
   LEFT JOIN closings c ON c.page_id = t.page_id AND c.opened = t.pos WHERE t.code IN ('open', 'void', 'text', 'comment'))"""


def attr_sql(name: str, node: str = "") -> str:
    prefix = f"{node}." if node else ""
    return f"list_filter({prefix}attrs, lambda a: a.name = '{name}')[1].value"


def below(a: str, d: str) -> str:
    return f"({d}.page_id = {a}.page_id AND {d}.pos > {a}.pos AND {d}.pos < {a}.closed_at)"
