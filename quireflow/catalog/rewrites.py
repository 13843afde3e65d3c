"""Tree edits and document rewrites over every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import selectors
from ..operators import tree as t
from ..plans import capture, clean
from ..sources import markup
from . import inputs as i
from . import oracle as o
from .inputs import attr_sql, below
from .registry import lit, query

RICH = f"WITH {i.nodes_sql(i.RICH_SQL)}"
RICH_URL = f"WITH {i.nodes_sql(i.RICH_SQL, 'url', 'site')}"
ATTRS_SQL = "array_to_string(list_transform(attrs, lambda a: a.name || '=' || a.value), '|')"


def attrs_text():
    return F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|")


def pos(name: str = "open_seq"):
    return (F.col(name) / markup.SEQ_GAP).cast("long")


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def rows(nodes: DataFrame, *more) -> DataFrame:
    return nodes.select("page_id", pos().alias("pos"), "kind", "tag", *more)


@query("f03_keep_tags", f"{RICH} SELECT page_id, pos, kind, tag FROM nodes WHERE kind <> 'element' OR tag IN ({names(clean.ALLOWED_TAGS)})")
def f03(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.keep_tags(i.rich_nodes(spark, folder)))


def _filtered_attrs(condition: str) -> str:
    return f"array_to_string(list_transform(list_filter(attrs, lambda a: {condition}), lambda a: a.name || '=' || a.value), '|')"


@query(
    "f04_keep_attrs",
    f"{RICH} SELECT page_id, pos, kind, tag, {_filtered_attrs(f'a.name IN ({names(clean.ALLOWED_ATTRIBUTES)})')} AS attrs FROM nodes",
)
def f04(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.keep_attrs(i.rich_nodes(spark, folder)), attrs_text().alias("attrs"))


@query("f05_drop_comments", f"{RICH} SELECT page_id, pos, kind, tag FROM nodes WHERE kind <> 'comment'")
def f05(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.drop_comments(i.rich_nodes(spark, folder)))


def _without(match: str, columns: str = "page_id, pos, kind, tag") -> str:
    """Rows that neither match nor lie below a match."""
    return f"""SELECT {columns} FROM nodes d WHERE NOT coalesce({match.format(n='d')}, false)
    AND NOT EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'd')} AND coalesce({match.format(n='a')}, false))"""


BOILERPLATE_SQL = f"({{n}}.tag IN ({names(capture.BOILERPLATE_TAGS)}) OR list_contains({{n}}.attrs, {{{{'name': 'role', 'value': 'navigation'}}}}) OR list_contains({{n}}.attrs, {{{{'name': 'aria-hidden', 'value': 'true'}}}}))"
HIDDEN_SQL = "(len(list_filter({n}.attrs, lambda x: x.name = 'hidden' OR (x.name = 'style' AND regexp_matches(x.value, '(?i)display\\s*:\\s*none')))) > 0)"


@query("f06_drop_subtrees", f"{RICH} {_without(BOILERPLATE_SQL)}")
def f06(spark: SparkSession, folder: str) -> DataFrame:
    return rows(capture.drop_boilerplate(i.rich_nodes(spark, folder)))


@query(
    "f07_drop_attrs",
    f"{RICH} SELECT page_id, pos, kind, tag, {_filtered_attrs(f'a.name NOT IN ({names(capture.PRESENTATION_ATTRIBUTES)})')} AS attrs FROM nodes",
)
def f07(spark: SparkSession, folder: str) -> DataFrame:
    return rows(capture.drop_attrs(i.rich_nodes(spark, folder)), attrs_text().alias("attrs"))


@query("f08_drop_hidden", f"{RICH} {_without(HIDDEN_SQL)}")
def f08(spark: SparkSession, folder: str) -> DataFrame:
    return rows(capture.drop_hidden(i.rich_nodes(spark, folder)))


@query(
    "f10_fetchable_images",
    f"""{RICH} SELECT page_id, pos, {attr_sql('src')} AS src FROM nodes WHERE tag = 'img' AND coalesce({attr_sql('src')}, '') <> ''
    AND NOT regexp_matches({attr_sql('src')}, '^data:')""",
)
def f10(spark: SparkSession, folder: str) -> DataFrame:
    found = capture.fetchable_images(i.rich_nodes(spark, folder, "url"))
    return found.select("page_id", pos("node_id").alias("pos"), "src")


@query(
    "f11_select_nodes",
    f"""{RICH} SELECT page_id, pos, kind, tag FROM nodes WHERE kind = 'element' AND (len(list_filter(attrs, lambda a: a.name = 'id')) > 0
    OR coalesce({attr_sql('role')} = 'tab', false) OR tag = 'article')""",
)
def f11(spark: SparkSession, folder: str) -> DataFrame:
    wanted = t.has_attr("id") | F.coalesce(t.attr("role") == "tab", F.lit(False)) | (F.col("tag") == "article")
    return rows(t.select_nodes(i.rich_nodes(spark, folder), wanted))


@query(
    "f12_heading_level",
    f"{RICH} SELECT page_id, pos, CAST(tag[2] AS INT) AS level FROM nodes WHERE regexp_matches(tag, '^h[1-6]$')",
)
def f12(spark: SparkSession, folder: str) -> DataFrame:
    headings = i.rich_nodes(spark, folder).filter(t.is_heading())
    return headings.select("page_id", pos().alias("pos"), t.heading_level().alias("level"))


EMPTY_SQL = f"""({{n}}.tag IN ({names(clean.DROPPED_WHEN_EMPTY)}) AND len(list_filter({{n}}.attrs, lambda x: x.name = 'id')) = 0
  AND NOT EXISTS (SELECT 1 FROM nodes c WHERE {below('{n}', 'c')} AND ((c.kind = 'text' AND replace(c.text, chr(8203), '') <> '')
  OR c.tag IN ({names(clean.KEPT_WHEN_EMPTY)}) OR len(list_filter(c.attrs, lambda x: x.name = 'id')) > 0)))"""
EMPTY_QUERY = f"""{RICH}, empty AS MATERIALIZED (SELECT * FROM nodes n WHERE {EMPTY_SQL.format(n='n')})
  SELECT page_id, pos, kind, tag FROM nodes d WHERE NOT EXISTS (SELECT 1 FROM empty a WHERE a.page_id = d.page_id AND (a.pos = d.pos OR {below('a', 'd')}))"""


@query("f13_drop_empty_links", EMPTY_QUERY)
def f13(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.drop_empty_links(i.rich_nodes(spark, folder)))


POLICY_SQL = f"""(CASE WHEN coalesce(href, '') = '' THEN 'none' WHEN {o.part('href', 'scheme')} IN ('mailto', 'tel') THEN 'keep'
  WHEN {o.part('href', 'scheme')} NOT IN ('', 'http', 'https') OR href = '#' THEN 'unwrap' WHEN starts_with(href, '#') THEN 'own' ELSE 'resolve' END)"""
LINKS_SQL = f"links AS MATERIALIZED (SELECT page_id, url, site, pos, {attr_sql('href')} AS href FROM nodes WHERE tag = 'a' AND coalesce({attr_sql('href')}, '') <> '')"


@query("f14_link_policy", f"{RICH_URL}, {LINKS_SQL} SELECT page_id, pos, {POLICY_SQL} AS policy FROM links")
def f14(spark: SparkSession, folder: str) -> DataFrame:
    links = clean.link_rows(i.rich_nodes(spark, folder, "url"), "url")
    return links.select("page_id", pos("node_id").alias("pos"), clean.link_policy("href").alias("policy"))


@query(
    "j08_descendants",
    f"""{RICH} SELECT a.page_id, a.pos AS ancestor, d.pos AS descendant FROM nodes a JOIN nodes d ON {below('a', 'd')}
    WHERE a.tag IN ('div', 'p', 'article', 'table', 'span') AND d.kind = 'element'""",
)
def j08(spark: SparkSession, folder: str) -> DataFrame:
    pairs = t.descendants(
        i.rich_nodes(spark, folder),
        t.is_element("div", "p", "article", "table", "span"),
        F.col("kind") == "element",
    )
    return pairs.select("page_id", pos("ancestor_id").alias("ancestor"), pos().alias("descendant"))


@query(
    "j09_children",
    f"""{RICH} SELECT p.page_id, p.pos AS parent, c.pos AS child FROM nodes p JOIN nodes c ON c.page_id = p.page_id AND c.parent = p.pos
    WHERE p.tag IN ('details', 'ul') AND c.tag IN ('summary', 'li') AND (p.tag = 'ul') = (c.tag = 'li')""",
)
def j09(spark: SparkSession, folder: str) -> DataFrame:
    source = i.rich_nodes(spark, folder)
    found = t.children(source, F.col("tag") == "details", "summary").unionByName(
        t.children(source, F.col("tag") == "ul", "li")
    )
    return found.select("page_id", pos("parent_id").alias("parent"), pos().alias("child"))


@query(
    "j13_tabs_with_panels",
    f"""{RICH} SELECT a.page_id, a.pos, EXISTS (SELECT 1 FROM nodes p WHERE p.page_id = a.page_id AND {attr_sql('id', 'p')} = {attr_sql('aria-controls', 'a')}) AS has_panel
    FROM nodes a WHERE {attr_sql('role', 'a')} = 'tab'""",
)
def j13(spark: SparkSession, folder: str) -> DataFrame:
    tabs = clean.tabs_with_panels(i.rich_nodes(spark, folder)).filter("is_tab")
    return tabs.select("page_id", pos().alias("pos"), "has_panel")


@query(
    "a05_chapter_ids",
    f"{RICH_URL} SELECT DISTINCT site, {o.chapter_name(o.part('url', 'path'), 'url')} AS file, {attr_sql('id')} AS id FROM nodes WHERE {attr_sql('id')} IS NOT NULL",
)
def a05(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.ids import chapter_name
    from ..functions.url import path

    found = i.rich_nodes(spark, folder, "url", "site")
    return clean.chapter_ids(found.withColumn("file", chapter_name(path("url"), "url")))


@query("a06_has_math", f"{RICH} SELECT page_id, bool_or(tag = 'math') AS has_math FROM nodes GROUP BY page_id")
def a06(spark: SparkSession, folder: str) -> DataFrame:
    return i.rich_nodes(spark, folder).groupBy("page_id").agg(F.bool_or(F.col("tag") == "math").alias("has_math"))


TEXT_MATCH = "n.tag IN ('div', 'span', 'h1', 'table', 'a', 'article')"


def text_match():
    return t.is_element("div", "span", "h1", "table", "a", "article")


@query(
    "a08_subtree_text",
    f"""{RICH} SELECT n.page_id, n.pos, coalesce(string_agg(d.text, '' ORDER BY d.pos), '') AS text FROM nodes n
    LEFT JOIN nodes d ON {below('n', 'd')} AND d.kind = 'text' WHERE {TEXT_MATCH} GROUP BY n.page_id, n.pos""",
)
def a08(spark: SparkSession, folder: str) -> DataFrame:
    found = t.subtree_text(i.rich_nodes(spark, folder), text_match())
    return found.select("page_id", pos("node_id").alias("pos"), "text")


@query(
    "a09_subtree_flags",
    f"""{RICH} SELECT n.page_id, n.pos, coalesce(bool_or(d.kind = 'text' AND d.text <> ''), false) AS has_text,
    coalesce(bool_or(d.tag IN ('img', 'br')), false) AS has_kept FROM nodes n LEFT JOIN nodes d ON {below('n', 'd')} WHERE {TEXT_MATCH} GROUP BY n.page_id, n.pos""",
)
def a09(spark: SparkSession, folder: str) -> DataFrame:
    found = t.subtree_flags(i.rich_nodes(spark, folder), text_match(), t.is_element("img", "br"))
    return found.select("page_id", pos().alias("pos"), "has_text", "has_kept")


@query(
    "a10_joined_text",
    f"""{RICH} SELECT n.page_id, n.pos, string_agg(trim(d.text, {o.WS}), ' ' ORDER BY d.pos) AS text FROM nodes n
    JOIN nodes d ON {below('n', 'd')} AND d.kind = 'text' AND trim(d.text, {o.WS}) <> '' WHERE {TEXT_MATCH} GROUP BY n.page_id, n.pos""",
)
def a10(spark: SparkSession, folder: str) -> DataFrame:
    found = t.joined_text(i.rich_nodes(spark, folder), text_match(), " ")
    return found.select("page_id", pos("node_id").alias("pos"), "text")


HEADINGS_SQL = """headings AS MATERIALIZED (SELECT page_id, pos, CAST(tag[2] AS BIGINT) AS level,
  row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM nodes WHERE regexp_matches(tag, '^h[1-6]$'))"""


@query(
    "w02_normalize_headings",
    f"""{RICH}, {HEADINGS_SQL}, fold AS (SELECT page_id, i, pos, CAST(2 AS BIGINT) AS level FROM headings WHERE i = 1
    UNION ALL SELECT h.page_id, h.i, h.pos, least(greatest(h.level, 2), f.level + 1) FROM fold f JOIN headings h ON h.page_id = f.page_id AND h.i = f.i + 1)
    SELECT page_id, pos, 'h' || level AS tag FROM fold""",
)
def w02(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.normalize_headings(i.rich_nodes(spark, folder)).filter(t.is_heading())).drop("kind")


@query(
    "w03_heading_jumps",
    f"""WITH {i.tokens_sql(i.RICH_SQL)}, nodes AS (SELECT page_id, pos, tag FROM tok WHERE code = 'open'), {HEADINGS_SQL}
    SELECT b.page_id, b.pos, a.level AS previous, b.level AS level FROM headings a JOIN headings b
    ON b.page_id = a.page_id AND b.i = a.i + 1 WHERE b.level > a.level + 1""",
)
def w03(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.checks import heading_jumps

    jumps = heading_jumps(i.rich_nodes(spark, folder))
    return jumps.select(
        "page_id", pos().alias("pos"), F.col("previous").cast("long").alias("previous"), F.col("level").cast("long").alias("level")
    )


IDS_SQL = f"""ids AS MATERIALIZED (SELECT page_id, pos, {o.xml_id(attr_sql('id'))} AS base, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i
  FROM nodes WHERE coalesce({attr_sql('id')}, '') <> ''),
  fold AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, '' AS name, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT page_id FROM ids)
    UNION ALL SELECT page_id, i, pos, name, list_append(used, name) FROM (SELECT d.page_id, d.i, d.pos, f.used,
      CASE WHEN NOT list_contains(f.used, d.base) THEN d.base ELSE d.base || '-' ||
        list_filter(range(2, len(f.used) + 3), lambda k: NOT list_contains(f.used, d.base || '-' || k))[1] END AS name
      FROM fold f JOIN ids d ON d.page_id = f.page_id AND d.i = f.i + 1))"""


@query("w04_unique_ids", f"{RICH}, {IDS_SQL} SELECT page_id, pos, name FROM fold WHERE i > 0")
def w04(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.unique_ids(i.rich_nodes(spark, folder)).withColumn("name", t.attr("id"))
    return made.filter("name <> ''").select("page_id", pos().alias("pos"), "name")


@query(
    "w07_token_depth",
    f"""SELECT page_id, pos, CAST(sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END)
      OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS depth FROM
      (SELECT page_id, unnest(range(1, len(t) + 1)) - 1 AS pos, CASE WHEN regexp_matches(unnest(t), '^<[A-Za-z]') THEN 'open' WHEN regexp_matches(unnest(t), '^</[A-Za-z]') THEN 'close' ELSE '' END AS kind
       FROM (SELECT page_id, list_filter(regexp_extract_all(html, {i.TOKENS}, 0), lambda x: NOT regexp_matches(x, {i.RAW})) AS t FROM pages))""",
)
def w07(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.windows import token_depth

    flat = markup.tokens(i.pages(spark, folder)).filter("kind <> 'raw'")
    numbered = flat.withColumn("pos", (F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1).cast("long"))
    return token_depth(numbered).select("page_id", "pos", "depth")


@query(
    "w08_first_row",
    f"""{RICH} SELECT n.page_id, n.pos, min(d.pos) AS first_row FROM nodes n JOIN nodes d ON {below('n', 'd')} AND d.tag = 'tr' WHERE n.tag = 'table' GROUP BY n.page_id, n.pos""",
)
def w08(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.windows import first_row

    return first_row(i.rich_nodes(spark, folder)).select(
        "page_id", pos().alias("pos"), pos("first_row").alias("first_row")
    )


RANK_SQL = """(CASE WHEN n.tag = 'h9' THEN 0 WHEN n.tag = 'pre' AND n.page_id % 2 = 0 THEN 1 WHEN n.tag = 'article' THEN 2 ELSE 3 END)"""


@query(
    "w09_first_match",
    f"""{RICH} SELECT page_id, rank, min(pos) AS pos FROM (SELECT page_id, pos, {RANK_SQL} AS rank, min({RANK_SQL}) OVER (PARTITION BY page_id) AS best
    FROM nodes n WHERE kind = 'element') WHERE rank = best GROUP BY page_id, rank""",
)
def w09(spark: SparkSession, folder: str) -> DataFrame:
    rank = (
        F.when(F.col("tag") == "h9", 0)
        .when((F.col("tag") == "pre") & (F.col("page_id") % 2 == 0), 1)
        .when(F.col("tag") == "article", 2)
        .otherwise(3)
    )
    source = i.rich_nodes(spark, folder).filter("kind = 'element'")
    chosen = capture.first_match(source, rank, "chosen")
    return chosen.select("page_id", F.col("chosen.rank").alias("rank"), pos("chosen.open_seq").alias("pos")).distinct()


@query(
    "d01_content_root",
    f"""{RICH}, ranked AS (SELECT n.page_id, n.pos, n.closed_at, CASE WHEN n.tag = 'article' THEN 1 WHEN n.tag = 'main' THEN 2 END AS rank FROM nodes n WHERE n.tag IN ('article', 'main')),
    roots AS (SELECT page_id, arg_min(struct_pack(pos := pos, closed_at := closed_at), rank * 1000000 + pos) AS r FROM ranked GROUP BY page_id)
    SELECT n.page_id, n.pos, n.kind, n.tag FROM nodes n JOIN roots USING (page_id) WHERE n.pos > r.pos AND n.pos < r.closed_at""",
)
def d01(spark: SparkSession, folder: str) -> DataFrame:
    return rows(capture.content_root(i.rich_nodes(spark, folder)))


#: Selector strings, each with the SQL condition that says the same of a node ``n``.
SELECTORS = {
    "article table td": f"n.tag = 'td' AND EXISTS (SELECT 1 FROM nodes a JOIN nodes b ON {below('a', 'b')} WHERE {below('b', 'n')} AND a.tag = 'article' AND b.tag = 'table')",
    ".d *, #p1": f"(EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'n')} AND list_contains(string_split({attr_sql('class', 'a')}, ' '), 'd')) OR {attr_sql('id', 'n')} = 'p1')",
    "div[role=tabpanel][hidden]": f"n.tag = 'div' AND {attr_sql('role', 'n')} = 'tabpanel' AND {attr_sql('hidden', 'n')} IS NOT NULL",
    "article [aria-hidden='TRUE' i]": f"{attr_sql('aria-hidden', 'n')} = 'true' AND EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'n')} AND a.tag = 'article')",
    'a[href^="/gone"], a[href$=example], img[src*=".web"]': f"(n.tag = 'a' AND (starts_with({attr_sql('href', 'n')}, '/gone') OR ends_with({attr_sql('href', 'n')}, 'example')) OR n.tag = 'img' AND contains({attr_sql('src', 'n')}, '.web'))",
}


@query(
    "f11_selector_strings",
    f"{RICH} " + " UNION ALL ".join(f"SELECT {lit(s)} AS selector, page_id, pos FROM nodes n WHERE n.kind = 'element' AND {sql}" for s, sql in SELECTORS.items()),
)
def f11_strings(spark: SparkSession, folder: str) -> DataFrame:
    nodes = i.rich_nodes(spark, folder)
    for n, selector in enumerate(SELECTORS):
        nodes = selectors.mark(nodes, selector, f"m{n}")
    found = F.array(*[F.when(F.col(f"m{n}"), F.lit(s)) for n, s in enumerate(SELECTORS)])
    return nodes.select(F.explode(F.array_compact(found)).alias("selector"), "page_id", pos().alias("pos"))


@query(
    "d01_content_selector",
    f"""{RICH}, ranked AS (SELECT n.page_id, n.pos, n.closed_at, CASE WHEN {attr_sql('id', 'n')} = 'p2' AND {attr_sql('aria-hidden', 'n')} = 'true' THEN 0
      WHEN n.tag = 'ul' AND EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'n')} AND {attr_sql('class', 'a')} = 's') THEN 1 END AS rank FROM nodes n WHERE n.kind = 'element'),
    roots AS (SELECT page_id, arg_min(struct_pack(pos := pos, closed_at := closed_at), rank * 1000000 + pos) AS r FROM ranked WHERE rank IS NOT NULL GROUP BY page_id)
    SELECT n.page_id, n.pos, n.kind, n.tag FROM nodes n JOIN roots USING (page_id) WHERE n.pos > r.pos AND n.pos < r.closed_at""",
)
def d01_selector(spark: SparkSession, folder: str) -> DataFrame:
    """Own selectors before the usual ones: the second panel of even pages, a list of the others."""
    return rows(capture.content_root(i.rich_nodes(spark, folder), "article #p2[aria-hidden='TRUE' i]", "body .s ul"))


@query(
    "d02_label_tab_panels",
    f"""{RICH} SELECT p.page_id, p.pos, string_agg(d.text, '' ORDER BY d.pos) AS label FROM nodes p
    JOIN nodes a ON a.page_id = p.page_id AND {attr_sql('role', 'a')} = 'tab' AND {attr_sql('aria-controls', 'a')} = {attr_sql('id', 'p')}
    JOIN nodes d ON {below('a', 'd')} AND d.kind = 'text' GROUP BY p.page_id, p.pos""",
)
def d02(spark: SparkSession, folder: str) -> DataFrame:
    made = capture.label_tab_panels(i.rich_nodes(spark, folder))
    labels = made.filter(F.col("open_seq") % markup.SEQ_GAP == 2).filter(t.is_text())
    return labels.select("page_id", pos("parent_id").alias("pos"), F.col("text").alias("label"))


@query(
    "d03_nav_links",
    f"""{RICH_URL} SELECT a.page_id, a.pos, trim(string_agg(d.text, '' ORDER BY d.pos), {o.WS}) AS title, {o.join('a.url', attr_sql('href', 'a'))} AS href
    FROM nodes n JOIN nodes a ON {below('n', 'a')} AND a.tag = 'a' JOIN nodes d ON {below('a', 'd')} AND d.kind = 'text'
    WHERE n.tag = 'nav' GROUP BY ALL""",
)
def d03(spark: SparkSession, folder: str) -> DataFrame:
    links = capture.nav_links(i.rich_nodes(spark, folder, "url"), F.col("tag") == "nav")
    return links.select("page_id", pos("pos").alias("pos"), "title", "href")


@query(
    "d03_nav_selector",
    f"""{RICH_URL}, navs AS (SELECT page_id, min(pos) AS pos, arg_min(closed_at, pos) AS closed_at FROM nodes s
      WHERE list_contains(string_split({attr_sql('class', 's')}, ' '), 'ad') OR s.tag = 'li' AND EXISTS (SELECT 1 FROM nodes v WHERE {below('v', 's')} AND v.tag = 'nav') GROUP BY page_id)
    SELECT a.page_id, a.pos, trim(string_agg(d.text, '' ORDER BY d.pos), {o.WS}) AS title, {o.join('a.url', attr_sql('href', 'a'))} AS href
    FROM navs n JOIN nodes a ON {below('n', 'a')} AND a.tag = 'a' JOIN nodes d ON {below('a', 'd')} AND d.kind = 'text' GROUP BY ALL""",
)
def d03_selector(spark: SparkSession, folder: str) -> DataFrame:
    """The navigation by an own selector: what comes first of an advert and a list item of the page's menu."""
    links = capture.nav_links(i.rich_nodes(spark, folder, "url"), ".ad, nav li")
    return links.select("page_id", pos("pos").alias("pos"), "title", "href")


@query(
    "d04_iframe_to_link",
    f"""{RICH_URL} SELECT page_id, pos, 'href=' || {o.join('url', attr_sql('src'))} AS attrs, {attr_sql('title')} AS label FROM nodes WHERE tag = 'iframe'""",
)
def d04(spark: SparkSession, folder: str) -> DataFrame:
    made = capture.iframe_to_link(i.rich_nodes(spark, folder, "url"))
    label = F.lead("text").over(W.partitionBy("page_id").orderBy("open_seq"))
    following = F.lead("open_seq").over(W.partitionBy("page_id").orderBy("open_seq"))
    marked = made.withColumn("label", label).withColumn("following", following)
    return marked.filter((F.col("tag") == "a") & (F.col("following") == F.col("open_seq") + 1)).select(
        "page_id", pos().alias("pos"), attrs_text().alias("attrs"), "label"
    )


@query(
    "d05_page_titles",
    f"""{RICH}, firsts AS (SELECT page_id, arg_min(struct_pack(pos := pos, closed_at := closed_at), pos) AS h FROM nodes WHERE tag = 'h1' GROUP BY page_id)
    SELECT f.page_id, trim(string_agg(d.text, '' ORDER BY d.pos), {o.WS}) AS title,
      (SELECT {attr_sql('lang', 'l')} FROM nodes l WHERE l.page_id = f.page_id AND l.tag = 'html') AS language
    FROM firsts f JOIN nodes d ON d.page_id = f.page_id AND d.pos > h.pos AND d.pos < h.closed_at AND d.kind = 'text' GROUP BY f.page_id""",
)
def d05(spark: SparkSession, folder: str) -> DataFrame:
    return capture.page_titles(i.rich_nodes(spark, folder))


@query(
    "d06_drop_title_heading",
    f"""{RICH}, firsts AS (SELECT page_id, arg_min(struct_pack(pos := pos, closed_at := closed_at), pos) AS h FROM nodes WHERE regexp_matches(tag, '^h[1-6]$') GROUP BY page_id),
    dropped AS (SELECT f.page_id, h FROM firsts f JOIN src s USING (page_id) WHERE
      (SELECT string_agg(trim(d.text, {o.WS}), ' ' ORDER BY d.pos) FROM nodes d WHERE d.page_id = f.page_id AND d.pos > h.pos AND d.pos < h.closed_at AND d.kind = 'text' AND trim(d.text, {o.WS}) <> '')
      = (CASE WHEN page_id % 2 = 0 THEN trim({i.unescape("regexp_extract(html, '<h1>([^<]*)', 1)")}, {o.WS}) ELSE 'other' END))
    SELECT n.page_id, n.pos, n.kind, n.tag FROM nodes n LEFT JOIN dropped d USING (page_id) WHERE d.page_id IS NULL OR NOT (n.pos >= h.pos AND n.pos < h.closed_at)""",
)
def d06(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import strip_ws, unescape_html

    heading = strip_ws(unescape_html(F.regexp_extract("html", "<h1>([^<]*)", 1)))
    titled = i.rich_pages(spark, folder).withColumn(
        "title", F.when(F.col("page_id") % 2 == 0, heading).otherwise("other")
    )
    return rows(clean.drop_title_heading(markup.parse_html(titled, "page_id", "html", "title")))


@query(
    "d07_drop_tab_strips",
    f"""{RICH}, strips AS (SELECT l.page_id, l.pos, l.closed_at FROM nodes l JOIN nodes a ON {below('l', 'a')} AND {attr_sql('role', 'a')} = 'tab'
      WHERE {attr_sql('role', 'l')} = 'tablist' GROUP BY ALL HAVING bool_and(EXISTS (SELECT 1 FROM nodes p WHERE p.page_id = a.page_id AND {attr_sql('id', 'p')} = {attr_sql('aria-controls', 'a')})))
    SELECT page_id, pos, kind, tag FROM nodes d WHERE NOT EXISTS (SELECT 1 FROM strips s WHERE s.page_id = d.page_id AND d.pos >= s.pos AND d.pos < s.closed_at)""",
)
def d07(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.drop_tab_strips(i.rich_nodes(spark, folder)))


@query(
    "d08_tabular_pre_to_table",
    f"""{RICH}, texts AS (SELECT n.page_id, n.pos, string_agg(d.text, '' ORDER BY d.pos) AS text FROM nodes n JOIN nodes d ON {below('n', 'd')} AND d.kind = 'text' WHERE n.tag = 'pre' GROUP BY ALL),
    lines AS (SELECT page_id, pos, i, string_split_regex(line, '[ \\t]{{2,}}') AS cells FROM (SELECT page_id, pos, i, trim(line, {o.WS}) AS line FROM
      (SELECT page_id, pos, unnest(string_split(text, chr(10))) AS line, unnest(range(1000)) AS i FROM texts) WHERE line IS NOT NULL) WHERE line <> ''),
    widths AS (SELECT page_id, pos, len(cells) AS w, count(*) AS n FROM lines GROUP BY ALL),
    modes AS (SELECT page_id, pos, arg_min(w, -n * 1000 + w) AS w, max(n) AS n, sum(n) AS total FROM widths GROUP BY ALL),
    tables AS (SELECT * FROM modes WHERE total >= 3 AND w >= 3 AND n / total >= 0.75)
    SELECT t.page_id, t.pos, string_agg('<tr>' || (CASE WHEN len(l.cells) <> t.w THEN '<td colspan="' || t.w || '">' || array_to_string(l.cells, '  ') || '</td>'
      WHEN l.first THEN '<th scope="col">' || array_to_string(l.cells, '</th><th scope="col">') || '</th>'
      ELSE '<td>' || array_to_string(l.cells, '</td><td>') || '</td>' END) || '</tr>', '' ORDER BY l.i) AS body
    FROM tables t JOIN (SELECT *, i = min(i) OVER (PARTITION BY page_id, pos) AS first FROM lines) l USING (page_id, pos) GROUP BY t.page_id, t.pos""",
)
def d08(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.tabular_pre_to_table(i.rich_nodes(spark, folder))
    tables = clean.enclosing_outermost(made, F.col("tag") == "tbody", "body_id")
    rebuilt = tables.filter(F.col("body_id") % markup.SEQ_GAP == 1).filter("open_seq > body_id")
    return t.serialize(rebuilt, "page_id", "body_id", name="body").select("page_id", pos("body_id").alias("pos"), "body")


@query(
    "d09_sanitize",
    f"""{RICH} SELECT page_id, pos, kind, tag, {_filtered_attrs(f'a.name IN ({names(clean.ALLOWED_ATTRIBUTES)})')} AS attrs FROM nodes
    WHERE kind = 'text' OR tag IN ({names(clean.ALLOWED_TAGS)})""",
)
def d09(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.sanitize(i.rich_nodes(spark, folder)), attrs_text().alias("attrs"))


@query(
    "d10_details_to_section",
    f"""{RICH} SELECT n.page_id, n.pos, n.kind, CASE WHEN n.tag = 'details' THEN 'section'
      WHEN n.tag = 'summary' AND p.tag = 'details' AND n.pos = (SELECT min(c.pos) FROM nodes c WHERE c.page_id = n.page_id AND c.parent = n.parent AND c.tag = 'summary') THEN 'h3'
      ELSE n.tag END AS tag FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.pos = n.parent""",
)
def d10(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.details_to_section(i.rich_nodes(spark, folder)))


@query("d11_drop_empty_links", EMPTY_QUERY)
def d11(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.drop_empty_links(i.rich_nodes(spark, folder)))


NESTING_SQL = f"""hard AS MATERIALIZED (SELECT page_id, pos FROM nodes WHERE tag IN ({names(clean.HARD_FLOW)})),
  phrasing AS MATERIALIZED (SELECT n.page_id, n.pos, n.closed_at, (SELECT min(h.pos) FROM hard h WHERE {below('n', 'h')}) AS first_hard FROM nodes n WHERE n.tag IN ({names(clean.PHRASING_ONLY)})),
  softened AS MATERIALIZED (SELECT n.*, n.tag IN ('div', 'p') AND EXISTS (SELECT 1 FROM phrasing a WHERE {below('a', 'n')} AND (a.first_hard IS NULL OR a.first_hard > n.pos)) AS to_span,
    EXISTS (SELECT 1 FROM hard h WHERE {below('n', 'h')}) AS holds_hard FROM nodes n),
  decided AS (SELECT *, (to_span OR tag IN ({names(clean.PHRASING_ONLY)})) AND holds_hard AS opened,
    tag IN ('pre', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') OR (tag = 'p' AND NOT to_span) OR len(list_filter(attrs, lambda x: x.name = 'id')) > 0 AS block FROM softened)"""


@query(
    "d12_repair_nesting",
    f"""{RICH}, {NESTING_SQL} SELECT page_id, pos, kind, CASE WHEN opened THEN 'div' WHEN to_span THEN 'span' ELSE tag END AS tag FROM decided WHERE NOT (opened AND NOT block)""",
)
def d12(spark: SparkSession, folder: str) -> DataFrame:
    return rows(clean.repair_nesting(i.rich_nodes(spark, folder)))


@query(
    "d14_math_alttext",
    f"""{RICH} SELECT n.page_id, n.pos, string_agg(d.text, '' ORDER BY d.pos) AS alttext FROM nodes n JOIN nodes d ON {below('n', 'd')} AND d.kind = 'text' WHERE n.tag = 'math' GROUP BY ALL""",
)
def d14(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.math_alttext(i.rich_nodes(spark, folder)).filter("tag = 'math'")
    return made.select("page_id", pos().alias("pos"), t.attr("alttext").alias("alttext"))


@query(
    "d17_rewrite_images",
    f"""{RICH} SELECT n.page_id, n.pos, coalesce(nullif({attr_sql('alt', 'n')}, ''), 'Illustration') AS alt,
    CASE WHEN {attr_sql('src', 'n')} = 'j.webp' THEN '../images/j.png' ELSE {attr_sql('src', 'n')} END AS src,
    coalesce(p.tag, 'body') <> 'figure' AND coalesce(p.tag, 'body') IN ({names(clean.BLOCK_CONTAINERS)}) AS wrapped
    FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.pos = n.parent WHERE n.tag = 'img'""",
)
def d17(spark: SparkSession, folder: str) -> DataFrame:
    source = clean.keep_tags(i.rich_nodes(spark, folder, "site"), clean.ALLOWED_TAGS + ("article", "body", "html"))
    assets = (
        i.pages(spark, folder)
        .select("site").distinct()
        .select("site", F.lit("j.webp").alias("name"), F.lit("j.png").alias("output"))
    )
    made = clean.rewrite_images(source, assets)
    previous = F.lag("tag").over(W.partitionBy("page_id").orderBy("open_seq"))
    return (
        made.withColumn("wrapped", F.coalesce(previous == "figure", F.lit(False)))
        .filter("tag = 'img'")
        .select("page_id", pos().alias("pos"), t.attr("alt").alias("alt"), t.attr("src").alias("src"), "wrapped")
    )


@query(
    "j06_resolve_images",
    f"""{RICH_URL} SELECT n.page_id, n.pos, CASE WHEN split_part({attr_sql('src')}, '/', -1) = 'j.webp' THEN '../images/j.png' ELSE {attr_sql('src')} END AS new_src FROM nodes n WHERE n.tag = 'img'""",
)
def j06(spark: SparkSession, folder: str) -> DataFrame:
    images = i.rich_nodes(spark, folder, "site").filter("tag = 'img'").select(
        "page_id", "node_id", "site", t.attr("src").alias("src")
    )
    assets = (
        i.pages(spark, folder)
        .select("site").distinct()
        .select("site", F.lit("j.webp").alias("name"), F.lit("j.png").alias("output"))
    )
    return clean.resolve_images(images, assets).select("page_id", pos("node_id").alias("pos"), "new_src")


@query(
    "d18_promote_table_header",
    f"""{RICH}, headless AS (SELECT n.page_id, n.pos, (SELECT min(r.pos) FROM nodes r WHERE {below('n', 'r')} AND r.tag = 'tr') AS row FROM nodes n
      WHERE n.tag = 'table' AND NOT EXISTS (SELECT 1 FROM nodes h WHERE {below('n', 'h')} AND h.tag = 'th'))
    SELECT c.page_id, c.pos, CASE WHEN EXISTS (SELECT 1 FROM headless t WHERE t.page_id = c.page_id AND t.row = c.parent) THEN 'th' ELSE 'td' END AS tag FROM nodes c WHERE c.tag = 'td'
    UNION ALL SELECT page_id, pos, tag FROM nodes WHERE tag = 'th'""",
)
def d18(spark: SparkSession, folder: str) -> DataFrame:
    made = clean.promote_table_header(i.rich_nodes(spark, folder)).filter("tag IN ('td', 'th')")
    return made.select("page_id", pos().alias("pos"), "tag")


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


SERIALIZE_SQL = f"""full_nodes AS (SELECT n.*, EXISTS (SELECT 1 FROM nodes c WHERE c.page_id = n.page_id AND c.parent = n.pos) AS has_children FROM nodes n),
  events AS (SELECT page_id, pos AS seq, 0 AS depth, CASE kind WHEN 'text' THEN {_escaped('text')} WHEN 'comment' THEN '<!--' || text || '-->'
      ELSE '<' || tag || array_to_string(list_transform(attrs, lambda a: ' ' || a.name || '="' || replace({_escaped('a.value')}, '"', '&quot;') || '"'), '') || CASE WHEN has_children THEN '>' ELSE '/>' END END AS s FROM full_nodes
    UNION ALL SELECT page_id, closed_at - 0.5, -depth, '</' || tag || '>' FROM full_nodes WHERE has_children)"""


@query(
    "d20_serialize",
    f"{RICH}, {SERIALIZE_SQL} SELECT page_id, string_agg(s, '' ORDER BY seq, depth) AS html FROM events GROUP BY page_id",
)
def d20(spark: SparkSession, folder: str) -> DataFrame:
    return t.serialize(i.rich_nodes(spark, folder))


@query(
    "d21_inline_svg_to_image",
    f"""{RICH} SELECT page_id, pos, 'assets/' || left(sha256('<svg xmlns="http://www.w3.org/2000/svg" aria-label="Flow"><g><svg/></g></svg>'), 20) || '.png' AS src, 'Flow' AS alt
    FROM nodes n WHERE tag = 'svg' AND NOT EXISTS (SELECT 1 FROM nodes a WHERE {below('a', 'n')} AND a.tag = 'svg')""",
)
def d21(spark: SparkSession, folder: str) -> DataFrame:
    made = capture.inline_svg_to_image(i.rich_nodes(spark, folder))
    images = made.filter((F.col("tag") == "img") & F.coalesce(t.attr("src").startswith("assets/"), F.lit(False)))
    return images.select("page_id", pos().alias("pos"), t.attr("src").alias("src"), t.attr("alt").alias("alt"))


@query(
    "o04_pick_logo",
    f"""{RICH_URL}, images AS (SELECT n.page_id, n.pos, 3 + 2 AS score FROM nodes n WHERE n.tag = 'img' AND {attr_sql('id', 'n')} = 'site-logo')
    SELECT page_id, min(pos) AS pos, CAST(max(score) AS INT) AS score FROM images GROUP BY page_id""".replace(
        i.RICH_SQL, "(SELECT page_id, url, site, replace(html, '<nav>', '<a href=\"/\"><img id=\"site-logo\" src=\"l.png\"><img src=\"m.png\"></a><nav>') AS html FROM " + i.RICH_SQL + ")"
    ),
)
def o04(spark: SparkSession, folder: str) -> DataFrame:
    branded = i.rich_pages(spark, folder).withColumn(
        "html",
        F.replace("html", F.lit("<nav>"), F.lit('<a href="/"><img id="site-logo" src="l.png"><img src="m.png"></a><nav>')),
    )
    logos = capture.pick_logo(markup.parse_html(branded, "page_id", "html", "url"))
    return logos.select("page_id", pos("node_id").alias("pos"), "score")


ICONS = """concat('<link rel="icon" sizes="', page_id % 50, 'x1" href="/a.png"><link rel="shortcut icon" sizes="', page_id % 70, 'x', page_id % 70, '" href="/b.png">',
 CASE WHEN page_id % 4 = 0 THEN '<link rel="apple-touch-icon" href="/t.png">' ELSE '' END, '<meta name="theme-color" content=" #FFF "><meta name="Theme-Color" content="#', 100 + page_id % 800, '">',
 '<meta property="og:description" content="About &amp; more"><meta name="author" content=" A. Writer "><meta name="description" content="',
 CASE WHEN page_id % 2 = 0 THEN 'Plain' ELSE '' END, '">', '</head>')"""
HEADED_SQL = f"(SELECT page_id, url, site, replace(html, '</head>', {ICONS}) AS html FROM {i.PLAIN_SQL})"


def headed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    headed = i.pages(spark, folder).selectExpr("page_id", "url", "site", f"replace(html, '</head>', {ICONS}) AS html")
    return markup.parse_html(headed, "page_id", "html", "url", "site")


@query(
    "o05_pick_icon",
    f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/t.png' WHEN page_id % 70 > page_id % 50 THEN '/b.png' ELSE '/a.png' END AS icon FROM pages""",
)
def o05(spark: SparkSession, folder: str) -> DataFrame:
    icons = capture.pick_icon(headed_nodes(spark, folder))
    return icons.select("page_id", F.regexp_extract("icon", "(/[a-z]+.png)$", 1).alias("icon"))


@query(
    "m01_site_metadata",
    f"""SELECT page_id, (SELECT CASE WHEN s = '' THEN x ELSE trim(split_part(x, s, -1)) END FROM (SELECT x, regexp_extract(x, '\\s[|–—-]\\s') AS s FROM (SELECT trim({i.unescape("regexp_extract(html, '<title>([^<]*)', 1)")}, {o.WS}) AS x))) AS name,
    CASE WHEN page_id % 2 = 0 THEN 'Plain' ELSE 'About & more' END AS description, 'A. Writer' AS author, '#FFF #' || (100 + page_id % 800) AS theme_colors FROM pages""",
)
def m01(spark: SparkSession, folder: str) -> DataFrame:
    found = capture.site_metadata(headed_nodes(spark, folder))
    return found.withColumn("theme_colors", F.array_join("theme_colors", " "))


@query(
    "m02_site_title",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Given' WHEN page_id % 3 = 1 THEN regexp_extract(url, '//([^/]*)', 1) ELSE trim(regexp_extract(html, '<title>([^<]*)', 1)) END AS title FROM pages""",
)
def m02(spark: SparkSession, folder: str) -> DataFrame:
    given = F.when(F.col("page_id") % 3 == 0, "Given")
    name = F.when(F.col("page_id") % 3 == 1, F.regexp_extract("url", "//([^/]*)", 1)).otherwise("")
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)", 1))
    return i.pages(spark, folder).select("page_id", capture.site_title(given, name, title).alias("title"))


RESPONSES_SQL = f"""responses AS (SELECT DISTINCT image_url, CASE WHEN length(image_url) % 3 = 0 THEN 404 ELSE 200 END AS status, 'image/png' AS content_type FROM images WHERE NOT ends_with(image_url, 'b.png'))"""
IMAGES_SQL = f"images AS (SELECT page_id, pos, {o.join('url', attr_sql('src'))} AS image_url FROM nodes WHERE tag = 'img' AND coalesce({attr_sql('src')}, '') <> '')"


def _assets(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.url import url_join

    images = capture.fetchable_images(i.rich_nodes(spark, folder, "url"))
    answers = images.select(url_join("url", "src").alias("url")).distinct().filter(~F.col("url").endswith("b.png"))
    responses = answers.select(
        "url", F.when(F.length("url") % 3 == 0, 404).otherwise(200).alias("status"), F.lit("image/png").alias("content_type")
    )
    return capture.asset_table(images, responses)


@query(
    "j17_asset_table",
    f"""{RICH_URL}, {IMAGES_SQL}, {RESPONSES_SQL} SELECT page_id, pos, CASE WHEN status = 200 THEN left(sha256(image_url), 20) || '.png' END AS asset,
    CASE WHEN status IS NULL THEN 'Could not download image ' || image_url || ': no response' WHEN status <> 200 THEN 'Could not download image ' || image_url || ': HTTP 404' END AS warning
    FROM images LEFT JOIN responses USING (image_url)""",
)
def j17(spark: SparkSession, folder: str) -> DataFrame:
    return _assets(spark, folder).select("page_id", pos("node_id").alias("pos"), "asset", "warning")


@query(
    "v17_capture_warnings",
    f"""{RICH_URL}, {IMAGES_SQL}, {RESPONSES_SQL} SELECT page_id, pos, 'Could not download image ' || image_url || CASE WHEN status IS NULL THEN ': no response' ELSE ': HTTP 404' END AS warning
    FROM images LEFT JOIN responses USING (image_url) WHERE status IS NULL OR status <> 200""",
)
def v17(spark: SparkSession, folder: str) -> DataFrame:
    return capture.capture_warnings(_assets(spark, folder)).select("page_id", pos("node_id").alias("pos"), "warning")
