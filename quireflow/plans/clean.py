"""Document rewrites between capture and book, as node table to node table functions.

The page-local ones are windows within a page and run back to back without a
shuffle. Only link and image lookups leave the page; they work on link and
image rows and come back by (page_id, node_id).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.ids import xml_id
from ..functions.media import base_name
from ..functions.text import strip_ws
from ..functions.url import canonical_url, scheme, url_defrag, url_join
from ..operators import tree as t

# What a book chapter may contain, and where images are set as figures.
ALLOWED_TAGS = (
    "a", "abbr", "aside", "b", "bdi", "bdo", "blockquote", "br", "caption", "cite", "code", "dd", "del", "details",
    "dfn", "div", "dl", "dt", "em", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img",
    "kbd", "li", "mark", "ol", "p", "pre", "q", "rp", "rt", "ruby", "s", "samp", "section", "small", "span",
    "strong", "sub", "summary", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "time", "tr", "u", "ul",
    "var", "wbr",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup",
    "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "semantics", "annotation",
)
ALLOWED_ATTRIBUTES = (
    "id", "href", "src", "alt", "title", "colspan", "rowspan", "scope", "lang", "dir", "start", "reversed", "value",
    "datetime", "cite", "width", "height", "headers", "xmlns", "display", "alttext", "mathvariant", "encoding",
)
BLOCK_CONTAINERS = ("aside", "blockquote", "body", "dd", "div", "figure", "li", "section", "td", "th")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PHRASING_ONLY = (
    "abbr", "b", "bdi", "bdo", "cite", "code", "dfn", "em", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strong", "sub", "sup", "time", "u", "var", "p", "pre", *HEADINGS,
)
FLOW_ONLY = (
    "aside", "blockquote", "details", "div", "dl", "figure", "hr", "ol", "p", "pre", "section", "table", "ul",
    *HEADINGS,
)
SOFT_FLOW = ("div", "p")
HARD_FLOW = tuple(tag for tag in FLOW_ONLY if tag not in SOFT_FLOW)
KEPT_WHEN_EMPTY = ("img", "math", "br", "hr")
DROPPED_WHEN_EMPTY = ("a", "div", "span")
ZERO_WIDTH_SPACE = "\u200b"
DEFAULT_ALT = "Illustration"
TABLE_MIN_ROWS = 3
TABLE_MIN_COLUMNS = 3
TABLE_MIN_SHARE = 0.75
COLUMN_GAP = "[ \\t\\n\\x0b\\x0c\\r]{2,}"


def drop_title_heading(nodes: DataFrame, title: str = "title") -> DataFrame:
    """Drop the page's first heading when its text is the page title."""
    first = F.min(F.when(t.is_heading(), F.struct("open_seq", "close_seq"))).over(t.page())
    in_first = F.col("open_seq").between(F.col("_first.open_seq"), F.col("_first.close_seq"))
    piece = F.nullif(strip_ws("text"), F.lit(""))
    pieces = F.collect_list(
        F.when(in_first & t.is_text() & piece.isNotNull(), F.struct("open_seq", piece.alias("text")))
    ).over(t.page())
    return (
        nodes.withColumn("_first", first)
        .withColumn("_text", t.ordered_text(pieces, " "))
        .filter(~F.coalesce(in_first & (F.col("_text") == F.col(title)), F.lit(False)))
        .drop("_first", "_text")
    )


def tabs_with_panels(nodes: DataFrame) -> DataFrame:
    """Add ``is_tab`` and ``has_panel``: the element a tab controls exists on its page.

    Ids and references meet in a window on (page, id); no id list is collected.
    """
    controls = F.when(t.attr("role") == "tab", t.attr("aria-controls"))
    kind = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("key"))
    roles = F.filter(
        F.array(kind(0, F.lit(None).cast("string")), kind(1, t.attr("id")), kind(2, controls)),
        lambda r: (r["role"] == 0) | r["key"].isNotNull(),
    )
    met = F.max(F.col("_ref.role") == 1).over(W.partitionBy("page_id", "_ref.key"))
    return (
        nodes.select("*", F.explode(roles).alias("_ref"))
        .withColumn("_met", F.when(F.col("_ref.role") == 2, met))
        .withColumn("has_panel", F.coalesce(F.max("_met").over(W.partitionBy("page_id", "open_seq")), F.lit(False)))
        .filter(F.col("_ref.role") == 0)
        .withColumn("is_tab", F.coalesce(t.attr("role") == "tab", F.lit(False)))
        .drop("_ref", "_met")
    )


def drop_tab_strips(nodes: DataFrame) -> DataFrame:
    """Drop tab lists whose every tab has its panel on the page."""
    marked = tabs_with_panels(nodes)
    strip = (
        F.coalesce(t.attr("role") == "tablist", F.lit(False))
        & t.holds(F.col("is_tab"))
        & ~t.holds(F.col("is_tab") & ~F.col("has_panel"))
    )
    flagged = marked.withColumn("_strip", strip)
    return t.drop_subtrees(flagged, F.col("_strip")).drop("_strip", "is_tab", "has_panel")


def tabular_rows(text: Column) -> Column:
    """Lines of a preformatted block, each split into cells at gaps of two or more spaces."""
    lines = F.transform(F.split(text, "[\\n\\r]"), strip_ws)
    return F.transform(F.filter(lines, lambda line: line != ""), lambda line: F.split(line, COLUMN_GAP))


def tabular_width(rows: Column) -> Column:
    """The commonest number of cells when the block reads as a table, else null.

    Ties go to the smaller width. Counting sorted widths needs no pairs: a width's
    count is the distance between its first position and the next width's.
    """

    def best(widths: Column, distinct: Column) -> Column:
        def counted(w: Column, i: Column) -> Column:
            after = F.coalesce(F.array_position(widths, F.get(distinct, i + 1)), F.size(widths).cast("long") + 1)
            return F.struct((after - F.array_position(widths, w)).alias("n"), (-w).alias("minus_width"))

        return F.array_max(F.transform(distinct, counted))

    def accepted(widths: Column) -> Column:
        found = best(widths, F.array_distinct(widths))
        wide, often = -found["minus_width"], found["n"] / F.size(widths)
        table = (F.size(widths) >= TABLE_MIN_ROWS) & (wide >= TABLE_MIN_COLUMNS) & (often >= TABLE_MIN_SHARE)
        return F.when(table, wide)

    # bound once, so that the rows are not made again for each width
    return F.get(F.transform(F.array(F.array_sort(F.transform(rows, F.size))), accepted), F.lit(0))


def _table_nodes(columns: list[str], pre: Column, rows: Column, width: Column) -> Column:
    """Node structs of a table set into the interval of its ``pre`` element."""
    span = (width * 3 + 3).cast("long")
    none = F.array().cast(t.NO_ATTRS)
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))

    def part(opened: Column, closed: Column, tag: Column, attrs: Column = none, text: Column | None = None) -> Column:
        return F.struct(
            opened.alias("open_seq"),
            closed.alias("close_seq"),
            F.lit("element" if text is None else "text").alias("kind"),
            tag.alias("tag"),
            attrs.alias("attrs"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    def row_parts(cells: Column, i: Column) -> Column:
        opened = i.cast("long") * span + 2
        whole = F.size(cells) == width
        tag = F.when(whole & (i == 0), "th").otherwise("td")
        attrs = (
            F.when(~whole, one("colspan", width.cast("string")))
            .when(i == 0, one("scope", F.lit("col")))
            .otherwise(none)
        )
        cell_parts = F.transform(
            F.when(whole, cells).otherwise(F.array(F.array_join(cells, "  "))),
            lambda text, j: F.array(
                part(opened + 1 + j * 3, opened + 3 + j * 3, tag, attrs),
                part(opened + 2 + j * 3, opened + 2 + j * 3, F.lit(""), none, text),
            ),
        )
        return F.concat(F.array(part(opened, opened + span - 1, F.lit("tr"))), F.flatten(cell_parts))

    length = pre["close_seq"] - pre["open_seq"]
    head = F.array(
        part(F.lit(0).cast("long"), length, F.lit("table")), part(F.lit(1).cast("long"), length - 1, F.lit("tbody"))
    )

    def node(p: Column) -> Column:
        opened = pre["open_seq"] + p["open_seq"]
        own = {
            "open_seq": opened,
            "close_seq": pre["open_seq"] + p["close_seq"],
            "node_id": opened,
            **{name: p[name] for name in ("kind", "tag", "attrs", "text")},
        }
        return F.struct(*(own.get(name, pre[name]).alias(name) for name in columns))

    return F.transform(F.concat(head, F.flatten(F.transform(rows, row_parts))), node)


def tabular_pre_to_table(nodes: DataFrame) -> DataFrame:
    """Preformatted blocks whose lines align in columns become tables."""
    is_pre = F.col("tag") == "pre"
    keyed = enclosing_outermost(nodes, is_pre, "_pre")

    columns = t.grouped_columns(nodes)
    own = F.struct(*columns)
    here = F.col("open_seq") == F.col("_pre")
    split = keyed.withColumn("_text", t.island_text(F.col("_pre"), here))
    split = split.withColumn("_cells", F.when(F.col("_text").isNotNull(), tabular_rows(F.col("_text")))).drop("_text")
    split = split.withColumn("_width", tabular_width(F.col("_cells")))
    wide = F.max("_width").over(W.partitionBy("page_id", "_pre"))
    judged = split.withColumn("_table", F.when(F.col("_pre").isNotNull(), wide))
    kept = F.when(F.col("_table").isNull(), F.array(own))
    made = kept.when(here, _table_nodes(columns, own, F.col("_cells"), F.col("_width"))).otherwise(F.array().cast(_rows_of(nodes, columns)))
    return judged.select(F.inline(made)).select(*nodes.columns)


def _rows_of(nodes: DataFrame, columns: list[str]) -> ArrayType:
    return ArrayType(nodes.select(F.struct(*columns).alias("row")).schema["row"].dataType)


def enclosing_outermost(nodes: DataFrame, predicate: Column, name: str) -> DataFrame:
    """Add the ``open_seq`` of the outermost match around or at each node."""
    top = predicate & ~t.inside(predicate)
    marked = nodes.withColumn("_top", top)
    opened = F.last(F.when(F.col("_top"), F.struct("open_seq", "close_seq")), ignorenulls=True).over(t.up_to())
    return (
        marked.withColumn("_last", opened)
        .withColumn(
            name, F.when(F.col("_last.close_seq") >= F.col("open_seq"), F.col("_last.open_seq"))
        )
        .drop("_top", "_last")
    )


def drop_comments(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") != "comment")


def keep_tags(nodes: DataFrame, names: tuple[str, ...] = ALLOWED_TAGS) -> DataFrame:
    """Unwrap elements that are not listed; their text and children stay."""
    return t.unwrap(nodes, (F.col("kind") == "element") & ~F.col("tag").isin(*names))


def keep_attrs(nodes: DataFrame, names: tuple[str, ...] = ALLOWED_ATTRIBUTES) -> DataFrame:
    return nodes.withColumn("attrs", t.only_attrs("attrs", names))


def sanitize(nodes: DataFrame) -> DataFrame:
    return keep_attrs(keep_tags(drop_comments(nodes)))


def details_to_section(nodes: DataFrame) -> DataFrame:
    """``details`` becomes ``section``, and its first ``summary`` child an ``h3``."""
    parented = t.with_parent(nodes)
    first = F.row_number().over(W.partitionBy("page_id", "parent_id", "tag").orderBy("open_seq")) == 1
    tag = (
        F.when(F.col("tag") == "details", "section")
        .when((F.col("tag") == "summary") & (F.col("parent_tag") == "details") & first, "h3")
        .otherwise(F.col("tag"))
    )
    return parented.withColumn("tag", tag).drop("parent_tag")


def drop_empty_links(nodes: DataFrame) -> DataFrame:
    """Links and wrappers without id that hold nothing to see or hear and no link target."""
    content = t.is_text() & (F.replace(F.col("text"), F.lit(ZERO_WIDTH_SPACE), F.lit("")) != "")
    kept = F.col("tag").isin(*KEPT_WHEN_EMPTY) | t.has_attr("id")
    return t.drop_subtrees(
        nodes.withColumn("_full", t.holds(content | kept)),
        F.col("tag").isin(*DROPPED_WHEN_EMPTY) & ~t.has_attr("id") & ~F.col("_full"),
    ).drop("_full")


def repair_nesting(nodes: DataFrame) -> DataFrame:
    """No flow element inside phrasing-only elements.

    In document order a ``div`` or ``p`` there becomes a ``span``, and any other
    flow element opens up every phrasing element around it: headings, ``p``,
    ``pre`` and elements with an id become ``div``, the rest are unwrapped.
    A phrasing ancestor still stands at node s exactly when no such (hard)
    element opened between the two, so counting hard elements gives the state
    that an in-order walk would see.
    """
    tag = F.col("tag")
    phrasing, hard = tag.isin(*PHRASING_ONLY), tag.isin(*HARD_FLOW)
    marked = nodes.withColumn("_hard_so_far", F.count(F.when(hard, 1)).over(t.up_to())).withColumn(
        "_holds_hard", t.holds(hard)
    )
    since_hard = (
        W.partitionBy("page_id", "_hard_so_far").orderBy("open_seq").rowsBetween(W.unboundedPreceding, -1)
    )
    standing = F.max(F.when(phrasing, F.col("close_seq"))).over(since_hard) > F.col("open_seq")
    softened = marked.withColumn("_span", F.coalesce(tag.isin(*SOFT_FLOW) & standing, F.lit(False)))
    phrasing_now = phrasing | F.col("_span")
    stays_block = tag.isin(*HEADINGS, "pre") | ((tag == "p") & ~F.col("_span")) | t.has_attr("id")
    opened = phrasing_now & F.col("_holds_hard")
    return (
        softened.filter(~(opened & ~stays_block))
        .withColumn("tag", F.when(opened, "div").when(F.col("_span"), "span").otherwise(tag))
        .drop("_hard_so_far", "_holds_hard", "_span")
    )


def normalize_headings(nodes: DataFrame) -> DataFrame:
    """Levels start at 2 and never skip: the chapter title is the h1.

    level(i) = min(max(l, 2), level(i-1) + 1) has the closed form
    i + min(1, min over j <= i of (max(l(j), 2) - j)).
    """
    level = t.heading_level()
    counted = nodes.withColumn("_i", F.when(level.isNotNull(), F.count(level).over(t.up_to())))
    slack = F.min(F.greatest(level, F.lit(2)) - F.col("_i")).over(t.up_to())
    final = F.col("_i") + F.least(F.lit(1), slack)
    return counted.withColumn(
        "tag", F.when(F.col("_i").isNotNull(), F.concat(F.lit("h"), final.cast("string"))).otherwise(F.col("tag"))
    ).drop("_i")


def math_alttext(nodes: DataFrame) -> DataFrame:
    """Formulas without alternative text get their own text."""
    filled = t.with_text(nodes, F.col("tag") == "math", "_math")
    missing = (F.col("tag") == "math") & ~t.has_attr("alttext")
    return filled.withColumn(
        "attrs", F.when(missing, t.set_attr("attrs", "alttext", F.col("_math"))).otherwise(F.col("attrs"))
    ).drop("_math")


@F.pandas_udf(ArrayType(StringType()))
def numbered_names(pages: pd.Series) -> pd.Series:
    """First unused of base, base-2, base-3 for the bases of a page in order; null where the input is.

    A number once taken stays taken, so each base goes on from its last number.
    """

    def names(bases):
        used, last, out = set(), {}, []
        for base in bases:
            name, number = base, last.get(base, 1)
            while name in used:
                number += 1
                name = f"{base}-{number}"
            last[base] = number
            used.add(name)
            out.append(name)
        return out

    return pages.map(names, na_action="ignore")


def unique_ids(nodes: DataFrame) -> DataFrame:
    """XML-safe ids, made unique per page in document order as base, base-2, base-3, first unused.

    Numbering within a base is a window. Only pages where a numbered name meets
    another name send the ids of their rows, in order, through ``numbered_names``.
    """
    raw = t.attr("id")
    based = nodes.withColumn("_base", F.when(raw != "", xml_id(raw)))
    nth = F.row_number().over(W.partitionBy("page_id", "_base").orderBy("open_seq"))
    named = based.withColumn(
        "_name",
        F.when(
            F.col("_base").isNotNull(),
            F.when(nth == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), nth.cast("string"))),
        ),
    )
    uses = F.count("_name").over(W.partitionBy("page_id", "_name"))
    clashing = named.withColumn("_uses", uses).withColumn("_clash", F.max(F.col("_uses") > 1).over(t.page()))
    in_fold = F.col("_clash") & F.col("_base").isNotNull()

    def names(key: Column, rows: Column) -> Column:
        return numbered_names(F.when(key >= 0, F.transform(rows, lambda r: r["_base"])))

    def fill(key: Column, rows: Column) -> Column:
        return F.when(key >= 0, F.zip_with(rows, F.col("_names"), lambda r, name: r.withField("_name", name))).otherwise(rows)

    resolved = t.rewrite_groups(clashing, F.when(in_fold, F.lit(0)).otherwise(F.lit(t.REST)), fill, _names=names)
    return resolved.withColumn(
        "attrs",
        F.when(F.col("_name").isNotNull(), t.set_attr("attrs", "id", F.col("_name"))).otherwise(F.col("attrs")),
    ).drop("_base", "_name", "_uses", "_clash")


def link_policy(href: Column | str) -> Column:
    """What to do with a link: none, keep, unwrap, own (same page) or resolve."""
    href = F.col(href) if isinstance(href, str) else href
    kind = scheme(href)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "none")
        .when(kind.isin("mailto", "tel"), "keep")
        .when(~kind.isin("", "http", "https") | (href == "#"), "unwrap")
        .when(href.startswith("#"), "own")
        .otherwise("resolve")
    )


def link_targets(links: DataFrame, url: str = "url", href: str = "href") -> DataFrame:
    """Add ``policy``, ``absolute``, ``anchor`` and the canonical ``target`` of each link."""
    absolute = links.withColumn("policy", link_policy(href)).withColumn(
        "absolute", F.when(F.col("policy") == "resolve", url_join(url, href))
    )
    split = url_defrag("absolute")
    return absolute.withColumn("anchor", split["fragment"]).withColumn("target", canonical_url(split["url"]))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Rewrite link targets against ``files(site, url, file)``; adds ``new_href``, null to unwrap.

    A left join on (site, target). A page everyone links to makes one hot key on
    the link side, which the adaptive skew join splits; files has one row per key.
    """
    targets = link_targets(links)
    known = files.select("site", F.col("url").alias("target"), F.col("file").alias("target_file"))
    # Links without a target (mail, own fragments, unwrapped ones) would all meet at a null key, so each
    # has one of its own. A filter for them would have the whole resolution written into it again.
    key = F.coalesce("target", F.concat(F.lit("\x00"), F.xxhash64("url", "href")))
    joined = targets.withColumn("_key", key).join(known.withColumnRenamed("target", "_key"), ["site", "_key"], "left").drop("_key")
    safe_anchor = F.when(F.col("anchor") == "", "").otherwise(F.concat(F.lit("#"), xml_id("anchor")))
    href = F.col("href")
    return joined.withColumn(
        "new_href",
        F.when(F.col("policy").isin("none", "keep"), href)
        .when(F.col("policy") == "own", F.concat(F.lit("#"), xml_id(F.substr(href, F.lit(2)))))
        .when(F.col("target_file").isNotNull(), F.concat("target_file", safe_anchor))
        .when(F.col("policy") == "resolve", F.col("absolute")),
    )


def link_rows(nodes: DataFrame, *keep: str) -> DataFrame:
    return nodes.filter(F.col("tag") == "a").select(
        "page_id", "node_id", *keep, t.attr("href").alias("href")
    ).filter(F.col("href") != "")


def apply_links(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Write ``new_href`` back; links resolved to null are unwrapped."""
    found = resolved.select("page_id", "node_id", "new_href", F.lit(True).alias("_found"))
    joined = nodes.join(found, ["page_id", "node_id"], "left")
    is_link = (F.col("tag") == "a") & F.coalesce("_found", F.lit(False))
    return (
        joined.filter(~(is_link & F.col("new_href").isNull()))
        .withColumn(
            "attrs", F.when(is_link, t.set_attr("attrs", "href", F.col("new_href"))).otherwise(F.col("attrs"))
        )
        .drop("new_href", "_found")
    )


def rewrite_links(nodes: DataFrame, files: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``nodes`` carries ``site`` and the page ``url``; ``files`` is (site, url, file).

    Links may be read from ``source``, an earlier state of the same nodes: a
    rewrite never changes an href, and reading the parsed nodes keeps the long
    chain of rewrites from being planned twice.
    """
    links = link_rows(nodes if source is None else source, "site", "url")
    return apply_links(nodes, resolve_links(links, files))


def resolve_images(images: DataFrame, assets: DataFrame) -> DataFrame:
    """Look up ``src`` by base name in ``assets(site, name, output)``; adds ``new_src``."""
    named = images.withColumn("name", base_name(F.coalesce("src", F.lit(""))))
    return named.join(assets.select("site", "name", "output"), ["site", "name"], "left").withColumn(
        "new_src", F.when(F.col("output").isNotNull(), F.concat(F.lit("../images/"), "output")).otherwise(F.col("src"))
    )


def rewrite_images(
    nodes: DataFrame, assets: DataFrame | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Point images at book assets, give them alternative text, and set block images as figures."""
    is_image = F.col("tag") == "img"
    if assets is not None:
        origin = nodes if source is None else source
        images = origin.filter(is_image).select("page_id", "node_id", "site", t.attr("src").alias("src"))
        sources = resolve_images(images, assets).filter("output IS NOT NULL").select("page_id", "node_id", "new_src")
        nodes = nodes.join(sources, ["page_id", "node_id"], "left")
        nodes = nodes.withColumn(
            "attrs",
            F.when(F.col("new_src").isNotNull(), t.set_attr("attrs", "src", F.col("new_src"))).otherwise(F.col("attrs")),
        ).drop("new_src")
    alt = F.coalesce(F.nullif(t.attr("alt"), F.lit("")), F.lit(DEFAULT_ALT))
    described = t.with_parent(nodes).withColumn(
        "attrs", F.when(is_image, t.set_attr("attrs", "alt", alt)).otherwise(F.col("attrs"))
    )
    # A page is parsed as a body fragment: an image without parent sits in the body.
    parent = F.coalesce("parent_tag", F.lit("body"))
    wraps = is_image & (parent != "figure") & parent.isin(*BLOCK_CONTAINERS)
    figure = t.new_node(
        described,
        open_seq=F.col("open_seq") - 1,
        close_seq=F.col("close_seq") + 1,
        tag=F.lit("figure"),
        parent_id=F.col("parent_id"),
    )
    return t.append_rows(described, wraps, figure).drop("parent_tag")


def promote_table_header(nodes: DataFrame) -> DataFrame:
    """In a table without header cells, the cells of the first row become column headers."""
    headless = (F.col("tag") == "table") & ~t.holds(F.col("tag") == "th")
    is_row = F.col("tag") == "tr"
    marked = nodes.withColumn("_headless", headless).withColumn(
        "_rows_before", F.count(F.when(is_row, 1)).over(t.before())
    )
    since_row = W.partitionBy("page_id", "_rows_before").orderBy("open_seq").rowsBetween(W.unboundedPreceding, -1)
    first_row = is_row & (F.max(F.when(F.col("_headless"), F.col("close_seq"))).over(since_row) > F.col("open_seq"))
    flagged = marked.withColumn("_first_row", F.coalesce(first_row, F.lit(False))).drop("_headless", "_rows_before")
    parented = t.enclosing(flagged, F.col("kind") == "element", F.col("_first_row"), "_in_first_row")
    promoted = (F.col("tag") == "td") & F.coalesce("_in_first_row", F.lit(False))
    return (
        parented.withColumn(
            "attrs",
            F.when(promoted, t.set_attr("attrs", "scope", F.lit("col"))).otherwise(F.col("attrs")),
        )
        .withColumn("tag", F.when(promoted, "th").otherwise(F.col("tag")))
        .drop("_first_row", "_in_first_row")
    )


def clean_structure(nodes: DataFrame) -> DataFrame:
    """Every rewrite that needs nothing beyond the page itself, up to the link rewrite."""
    nodes = drop_title_heading(nodes)
    nodes = drop_tab_strips(nodes)
    nodes = tabular_pre_to_table(nodes)
    nodes = sanitize(nodes)
    nodes = details_to_section(nodes)
    nodes = drop_empty_links(nodes)
    nodes = repair_nesting(nodes)
    nodes = normalize_headings(nodes)
    nodes = math_alttext(nodes)
    return unique_ids(nodes)


def chapter_ids(nodes: DataFrame) -> DataFrame:
    """Distinct (site, file, id) link targets."""
    return nodes.select("site", "file", t.attr("id").alias("id")).filter("id IS NOT NULL").distinct()


def prune_fragments(links: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """Fragments that no chapter defines: drop them, or the link when it points into its own file.

    ``links(site, file, href)``; adds ``new_href``, null for links that become text.
    """
    href = F.coalesce("href", F.lit(""))
    has_fragment = href.contains("#") & (scheme(href) == "")
    before = F.substring_index(href, "#", 1)
    keyed = links.withColumn(
        "target_file", F.when(has_fragment, F.when(before == "", F.col("file")).otherwise(before))
    ).withColumn("fragment", F.when(has_fragment, url_defrag(href)["fragment"]))
    book = files.select("site", F.col("file").alias("target_file"), F.lit(True).alias("in_book")).distinct()
    targets = ids.select("site", F.col("file").alias("target_file"), F.col("id").alias("fragment"), F.lit(True).alias("defined"))
    # links without a fragment have keys of their own, as in `resolve_links`
    keyed = keyed.withColumn("_key", F.coalesce("target_file", F.concat(F.lit("\x00"), F.xxhash64("file", "href"))))
    joined = (
        keyed.join(book.withColumnRenamed("target_file", "_key"), ["site", "_key"], "left")
        .join(targets.withColumnRenamed("target_file", "_key"), ["site", "_key", "fragment"], "left")
        .drop("_key")
    )
    dangling = F.coalesce(F.col("in_book"), F.lit(False)) & F.col("defined").isNull()
    return joined.withColumn(
        "new_href",
        F.when(~dangling, F.col("href")).when(~F.col("href").startswith("#"), F.col("target_file")),
    ).drop("in_book", "defined")


def prune_dangling_fragments(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Second pass over all chapters of a site: needs every chapter's ids, so read ``nodes`` from a stored table."""
    fragment_links = link_rows(nodes, "site", "file").filter(F.col("href").contains("#"))
    return apply_links(nodes, prune_fragments(fragment_links, chapter_ids(nodes), files))


def clean_pages(nodes: DataFrame, files: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Captured nodes (with site, url, title, file) to chapter nodes, before fragment pruning."""
    cleaned = clean_structure(nodes)
    cleaned = rewrite_links(cleaned, files, source=nodes)
    cleaned = rewrite_images(cleaned, assets, source=nodes)
    return promote_table_header(cleaned)
