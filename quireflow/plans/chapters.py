"""The rewrites of capture and clean over whole pages, one row a page.

``rows`` holds the nodes of a page in document order. Each step does what the step of the same
name in :mod:`capture` or :mod:`clean` does to a node table (``test_build`` holds them against each other), but as one
pass over the page: predicates and rewrites are column expressions, and where a node stands
is asked of :mod:`quireflow.operators.places`. So a chain of rewrites sorts nothing and shuffles
nothing; only link and image lookups leave the page.

A column that a lambda names must be named twice in its projection, or be an argument beside the lambda: Spark writes the
definition of a column named once into the place of its name, and would compute it for every node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import sha256_hex, xml_id
from ..functions.text import strip_ws
from ..functions.url import url_join
from ..operators import places
from ..operators import tree as t
from ..operators.selectors import marked
from ..session import cut_lineage
from ..sources.markup import PAGE_FIELDS
from . import capture, clean

Store = Callable[[DataFrame], DataFrame]
ROWS, OPENED, CLOSED = "rows", "rows.open_seq", "rows.close_seq"
_ROWS_TYPE = f"array<struct<open_seq: bigint, close_seq: bigint, node_id: bigint, kind: string, tag: string, attrs: {t.NO_ATTRS}, text: string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def node(r: Column, **changed: Column) -> Column:
    return F.struct(*(changed.get(name, r[name]).alias(name) for name in PAGE_FIELDS))


def marks(*predicates: Callable[[Column], Column]) -> Column:
    """A number for each node: bit n says whether predicate n holds."""

    def number(r: Column) -> Column:
        bits = [F.when(predicate(r), 1 << n).otherwise(0) for n, predicate in enumerate(predicates)]
        return sum(bits[1:], bits[0])

    return F.transform(ROWS, number)


def has_bit(number: Column, n: int) -> Column:
    return number.bitwiseAND(F.lit(1 << n)) != 0


def tagged(*tags: str) -> Callable[[Column], Column]:
    return lambda r: r["tag"].isin(*tags)


def is_text(r: Column) -> Column:
    return r["kind"] == "text"


def is_element(r: Column) -> Column:
    return r["kind"] == "element"


def attr(r: Column, name: str) -> Column:
    return t.attr(name, r["attrs"])


def attr_is(r: Column, name: str, value: str) -> Column:
    return F.coalesce(attr(r, name) == value, F.lit(False))


def text_of(rows: Column) -> Column:
    return F.array_join(F.transform(F.filter(rows, is_text), lambda r: r["text"]), "")


def texts_if(predicate: Callable[[Column], Column]) -> Column:
    """The text of each text node, on pages where the predicate holds somewhere; else null."""
    return F.when(F.exists(ROWS, predicate), F.transform(ROWS, lambda r: F.when(is_text(r), r["text"])))


def markup(rows: Column) -> Column:
    """XML text of nodes in document order, as :func:`tree.serialize` writes it."""

    def escaped(value: Column, *pairs: tuple[str, str]) -> Column:
        for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *pairs):
            value = F.replace(value, F.lit(plain), F.lit(reference))
        return value

    def attribute(a: Column) -> Column:
        value = escaped(a["value"], ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;"))
        return F.concat(F.lit(" "), a["name"], F.lit('="'), value, F.lit('"'))

    def event(seq: Column, text: Column) -> Column:
        return F.struct(seq.alias("seq"), text.alias("text"))

    def events(page: Column) -> Column:
        def written(r: Column, i: Column) -> Column:
            start = F.concat(F.lit("<"), r["tag"], F.array_join(F.transform(r["attrs"], attribute), ""))
            full = F.coalesce(F.get(page, i + 1)["open_seq"] < r["close_seq"], F.lit(False))
            return (
                F.when(is_text(r), F.array(event(r["open_seq"], escaped(r["text"], ("\r", "&#13;")))))
                .when(r["kind"] == "comment", F.array(event(r["open_seq"], F.concat(F.lit("<!--"), r["text"], F.lit("-->")))))
                .when(
                    full,
                    F.array(
                        event(r["open_seq"], F.concat(start, F.lit(">"))),
                        event(r["close_seq"], F.concat(F.lit("</"), r["tag"], F.lit(">"))),
                    ),
                )
                .otherwise(F.array(event(r["open_seq"], F.concat(start, F.lit("/>")))))
            )

        return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(page, written))), lambda e: e["text"]), "")

    return bound(rows, events)


# ---- capture -----------------------------------------------------------------


def page_language(pages: DataFrame) -> DataFrame:
    first = F.get(F.filter(ROWS, tagged("html")), F.lit(0))
    return pages.withColumn(
        "language", F.coalesce(F.nullif(t.attr("lang", first["attrs"]), F.lit("")), F.lit(capture.DEFAULT_LANGUAGE))
    )


def label_tab_panels(pages: DataFrame) -> DataFrame:
    controls = lambda r: F.when(attr_is(r, "role", "tab"), attr(r, "aria-controls"))
    is_tab = lambda r: controls(r).isNotNull()
    on_tabs = lambda value: F.when(F.exists(ROWS, is_tab), F.transform(ROWS, value))
    labels = places.panel_labels(OPENED, CLOSED, on_tabs(controls), on_tabs(lambda r: attr(r, "id")), texts_if(is_tab))
    labelled = pages.withColumn("_labels", labels)

    def shown(r: Column, i: Column) -> Column:
        def heading(label: Column, k: Column) -> Column:
            opened = r["open_seq"] + 1 + k * 3
            new = lambda seq, close, kind, tag, text: node(
                r, open_seq=seq, close_seq=close, node_id=seq, kind=F.lit(kind), tag=F.lit(tag), attrs=F.array().cast(t.NO_ATTRS), text=text
            )
            return F.array(
                new(opened, opened + 2, "element", "h3", F.lit(None).cast("string")),
                new(opened + 1, opened + 1, "text", "", strip_ws(label)),
            )

        found = F.get("_labels", i)
        panel = node(r, attrs=t.without_attrs(r["attrs"], ("hidden", "aria-hidden", "style")))
        return F.when(found.isNotNull(), F.concat(F.array(panel), F.flatten(F.transform(found, heading)))).otherwise(F.array(node(r)))

    rows = F.when(F.col("_labels").isNull(), F.col(ROWS)).otherwise(F.flatten(F.transform(ROWS, shown)))
    return labelled.withColumn("rows", rows).drop("_labels")


def _own_roots(pages: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """(page_id, _root) where own selectors are asked: they are columns over node tables."""
    nodes, own, _ = marked(pages.select("page_id", F.inline("rows")), selectors)
    nodes = nodes.withColumn("_in_main", t.inside(F.col("tag") == "main")).withColumn("_rank", capture.content_rank(*own))
    root = F.struct(F.col("_rank").alias("rank"), "open_seq", "close_seq")
    return nodes.filter("_rank IS NOT NULL").groupBy("page_id").agg(F.min(root).alias("_root"))


def content_root(pages: DataFrame, *selectors: str) -> DataFrame:
    """Nodes inside the content root; none where a page has no root, which ``rooted`` tells."""
    if selectors:
        chosen = pages.join(_own_roots(pages, selectors), "page_id", "left")
    else:
        in_main = places.inside_marks(OPENED, CLOSED, marks(tagged("main")))["above"]

        def ranked(r: Column, above: Column) -> Column:
            main, article, within = r["tag"] == "main", r["tag"] == "article", above != 0
            classed = F.coalesce(F.contains(attr(r, "class"), F.lit("content")), F.lit(False))
            rank = F.when(article & within, 0).when(article, 1).when(within & classed, 2).when(main, 3).when(attr_is(r, "role", "main"), 4)
            return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), r["open_seq"].alias("open_seq"), r["close_seq"].alias("close_seq")))

        chosen = pages.withColumn("_root", F.array_min(F.zip_with(ROWS, in_main, ranked)))
    in_root = lambda r: (r["open_seq"] > F.col("_root.open_seq")) & (r["open_seq"] < F.col("_root.close_seq"))
    return chosen.withColumn("rows", F.filter(ROWS, in_root)).withColumn("rooted", F.col("_root").isNotNull()).drop("_root")


def visible_content(pages: DataFrame, url: str = "url") -> DataFrame:
    """Hidden parts and boilerplate dropped, drawings as images, frames as links, presentation attributes dropped."""
    hidden = lambda r: t.has_attr("hidden", r["attrs"]) | F.coalesce(attr(r, "style").rlike(capture.HIDDEN_STYLE), F.lit(False))
    # A drawing is an image before boilerplate is looked for, so its own attributes do not count.
    boilerplate = lambda r: (r["tag"] != "svg") & (
        r["tag"].isin(*capture.BOILERPLATE_TAGS) | attr_is(r, "role", "navigation") | attr_is(r, "aria-hidden", "true")
    )
    own = marks(hidden, tagged("svg"), boilerplate, tagged("iframe"))
    placed = pages.withColumn("_own", own).withColumn("_place", places.inside_marks(OPENED, CLOSED, F.col("_own")))
    around = lambda r, i: F.struct(
        node(r).alias("r"),
        F.get("_own", i).alias("own"),
        F.get(F.col("_place.above"), i).alias("above"),
        F.get(F.col("_place.below"), i).alias("below"),
    )
    seen = F.filter(F.transform(ROWS, around), lambda w: ~has_bit(w["own"].bitwiseOR(w["above"]), 0))
    pages = placed.withColumn("_seen", seen).drop("_own", "_place", "rows")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))

    def drawn(w: Column, i: Column) -> Column:
        r = w["r"]
        inner = F.transform(F.slice("_seen", i + 1, w["below"] + 1), lambda x: x["r"])
        full = bound(
            markup(inner),
            lambda m: F.when(m.contains("xmlns="), m).otherwise(
                F.concat(F.substring(m, 1, 4), F.lit(capture.SVG_NAMESPACE), F.substr(m, F.lit(5)))
            ),
        )
        asset = F.concat(F.lit("assets/"), F.substring(sha256_hex(full), 1, 20), F.lit(".png"))
        alt = F.coalesce(attr(r, "aria-label"), attr(r, "title"), F.lit(capture.DIAGRAM))
        return F.array(node(r, tag=F.lit("img"), attrs=F.array(pair("src", asset), pair("alt", alt)), close_seq=r["open_seq"]))

    def framed(r: Column) -> Column:
        target = bound(F.coalesce(attr(r, "src"), F.lit("")), lambda src: F.when(src == "", "").otherwise(url_join(url, src)))
        label = F.coalesce(F.nullif(attr(r, "title"), F.lit("")), F.lit(capture.EMBEDDED))
        at = r["open_seq"] + 1
        link = node(r, tag=F.lit("a"), attrs=F.array(pair("href", target)), close_seq=F.greatest(r["close_seq"], r["open_seq"] + 2))
        return F.array(link, node(r, open_seq=at, close_seq=at, node_id=at, kind=F.lit("text"), tag=F.lit(""), attrs=F.array().cast(t.NO_ATTRS), text=label))

    def rewritten(w: Column, i: Column) -> Column:
        r = w["r"]
        gone = has_bit(w["above"], 1) | has_bit(w["own"].bitwiseOR(w["above"]), 2) | has_bit(w["above"], 3)
        return (
            F.when(gone, F.array().cast(_ROWS_TYPE))
            .when(has_bit(w["own"], 1), drawn(w, i))
            .when(has_bit(w["own"], 3), framed(r))
            .otherwise(F.array(node(r, attrs=t.without_attrs(r["attrs"], capture.PRESENTATION_ATTRIBUTES))))
        )

    return pages.withColumn("rows", F.flatten(F.transform("_seen", rewritten))).drop("_seen")


def capture_content(pages: DataFrame, *selectors: str, store: Store = cut_lineage) -> DataFrame:
    labelled = store(label_tab_panels(pages))
    return visible_content(store(content_root(labelled, *selectors)))


# ---- clean -------------------------------------------------------------------


def drop_title_heading(pages: DataFrame, title: str = "title") -> DataFrame:
    first = F.get(F.filter(ROWS, lambda r: r["tag"].rlike(t.HEADING_PATTERN)), F.lit(0))
    marked_pages = pages.withColumn("_first", first)
    within = lambda r: r["open_seq"].between(F.col("_first.open_seq"), F.col("_first.close_seq"))
    pieces = F.transform(F.filter(ROWS, lambda r: within(r) & is_text(r)), lambda r: F.nullif(strip_ws(r["text"]), F.lit("")))
    same = F.col("_first").isNotNull() & (F.array_join(pieces, " ") == F.col(title))
    return marked_pages.withColumn("rows", F.when(same, F.filter(ROWS, lambda r: ~within(r))).otherwise(F.col(ROWS))).drop("_first")


def strips_and_tables(pages: DataFrame) -> DataFrame:
    """Tab lists whose every tab has its panel are dropped; preformatted blocks in columns become tables."""
    is_tab = lambda r: attr_is(r, "role", "tab")
    on_tabs = lambda value: F.when(F.exists(ROWS, is_tab), F.transform(ROWS, value))
    place = places.tab_strips(
        OPENED, CLOSED, marks(lambda r: attr_is(r, "role", "tablist"), is_tab, tagged("pre")),
        on_tabs(lambda r: attr(r, "id")), on_tabs(lambda r: F.when(is_tab(r), attr(r, "aria-controls"))),
    )
    around = lambda r, i: F.struct(
        node(r).alias("r"),
        F.get(F.col("_place.drop"), i).alias("drop"),
        F.get(F.col("_place.below"), i).alias("below"),
        F.get(F.col("_place.within"), i).alias("within"),
    )
    left = F.filter(F.transform(ROWS, around), lambda w: ~w["drop"])
    pages = pages.withColumn("_place", place).withColumn("_left", left).drop("rows", "_place")

    # the text of each outermost block, its cells, and their number in a row where it reads as a table
    below = lambda w, i: F.transform(F.slice("_left", i + 1, w["below"] + 1), lambda x: x["r"])
    texts = F.transform("_left", lambda w, i: F.when((w["r"]["tag"] == "pre") & ~w["within"], text_of(below(w, i))))
    pages = pages.withColumn("_texts", texts).withColumn("_cells", F.transform("_texts", clean.tabular_rows)).drop("_texts")
    pages = pages.withColumn("_width", F.transform("_cells", clean.tabular_width))

    def rewritten(w: Column, i: Column) -> Column:
        cells, width = F.get("_cells", i), F.get("_width", i)
        table = clean._table_nodes(list(PAGE_FIELDS), w["r"], cells, width)
        return (
            F.when(w["within"], F.array().cast(_ROWS_TYPE))
            .when(width.isNotNull(), table)
            .when(cells.isNotNull(), below(w, i))
            .otherwise(F.array(w["r"]))
        )

    return pages.withColumn("rows", F.flatten(F.transform("_left", rewritten))).drop("_left", "_cells", "_width")


def sanitize(pages: DataFrame) -> DataFrame:
    listed = lambda r: is_text(r) | (is_element(r) & r["tag"].isin(*clean.ALLOWED_TAGS))
    kept = lambda r: node(r, attrs=t.only_attrs(r["attrs"], clean.ALLOWED_ATTRIBUTES))
    return pages.withColumn("rows", F.transform(F.filter(ROWS, listed), kept))


def details_to_section(pages: DataFrame) -> DataFrame:
    placed = pages.withColumn("_place", places.parents(OPENED, CLOSED, marks(is_element, tagged("summary"))))

    def renamed(r: Column, i: Column) -> Column:
        parent = F.get(ROWS, F.get(F.col("_place.parent"), i))["tag"]
        first = (r["tag"] == "summary") & (parent == "details") & F.get(F.col("_place.first"), i)
        return node(r, tag=F.when(r["tag"] == "details", "section").when(first, "h3").otherwise(r["tag"]))

    return placed.withColumn("rows", F.transform(ROWS, renamed)).drop("_place")


def empty_links_and_nesting(pages: DataFrame) -> DataFrame:
    """Links and wrappers without anything to see are dropped; then no flow element is left inside phrasing-only ones."""
    named = lambda r: t.has_attr("id", r["attrs"])
    seen = lambda r: is_text(r) & (F.replace(r["text"], F.lit(clean.ZERO_WIDTH_SPACE), F.lit("")) != "")
    found = places.empty_and_nesting(
        OPENED,
        CLOSED,
        marks(
            lambda r: r["tag"].isin(*clean.DROPPED_WHEN_EMPTY) & ~named(r),
            lambda r: seen(r) | r["tag"].isin(*clean.KEPT_WHEN_EMPTY) | named(r),
            tagged(*clean.HARD_FLOW),
            tagged(*clean.PHRASING_ONLY),
        ),
    )

    def rewritten(r: Column, i: Column) -> Column:
        place = F.get("_place", i)
        span = r["tag"].isin(*clean.SOFT_FLOW) & has_bit(place, 2)
        opened = (r["tag"].isin(*clean.PHRASING_ONLY) | span) & has_bit(place, 1)
        block = r["tag"].isin(*clean.HEADINGS, "pre") | ((r["tag"] == "p") & ~span) | named(r)
        tag = F.when(opened, "div").when(span, "span").otherwise(r["tag"])
        return F.when(~has_bit(place, 0) & ~(opened & ~block), node(r, tag=tag))

    rows = F.filter(F.transform(ROWS, rewritten), lambda r: r.isNotNull())
    return pages.withColumn("_place", found).withColumn("rows", rows).drop("_place")


def headings_formulas_ids(pages: DataFrame) -> DataFrame:
    """Heading levels that never skip, alternative text of formulas, and XML-safe ids unique within the page."""
    is_math = tagged("math")
    raw_base = lambda raw: F.when(raw != "", xml_id(raw))
    base = lambda r: F.when(t.has_attr("id", r["attrs"]), bound(attr(r, "id"), raw_base))
    level = lambda r: F.coalesce(t.heading_level(r["tag"]), F.lit(0))
    found = (
        pages.withColumn("_level", places.heading_levels(F.transform(ROWS, level)))
        .withColumn("_math", places.joined_below(OPENED, CLOSED, marks(is_math), texts_if(is_math)))
        .withColumn("_name", places.unique_names(F.transform(ROWS, base)))
    )

    def rewritten(r: Column, i: Column) -> Column:
        level, name, text = F.get("_level", i), F.get("_name", i), F.get("_math", i)
        missing = text.isNotNull() & ~t.has_attr("alttext", r["attrs"])
        attrs = F.when(missing, t.set_attr(r["attrs"], "alttext", text)).otherwise(r["attrs"])
        attrs = F.when(name.isNotNull(), t.set_attr(attrs, "id", name)).otherwise(attrs)
        return node(r, tag=F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise(r["tag"]), attrs=attrs)

    return found.withColumn("rows", F.transform(ROWS, rewritten)).drop("_level", "_math", "_name")


def clean_structure(pages: DataFrame, store: Store = cut_lineage) -> DataFrame:
    """Every rewrite that needs nothing beyond the page itself, up to the link rewrite."""
    pages = store(drop_title_heading(pages))
    pages = store(sanitize(strips_and_tables(pages)))
    pages = store(details_to_section(pages))
    return headings_formulas_ids(store(empty_links_and_nesting(pages)))


# ---- links and images -----------------------------------------------------------


def attribute_rows(pages: DataFrame, tag: str, name: str, *keep: str) -> DataFrame:
    """(page_id, *keep, at, ``name``): an attribute of the elements of a tag, with their positions in the page."""
    found = F.transform(ROWS, lambda r, i: F.struct(i.alias("at"), F.when(r["tag"] == tag, attr(r, name)).alias(name)))
    return pages.select("page_id", *keep, F.inline(F.filter(found, lambda f: f[name] != "")))


def with_values(pages: DataFrame, found: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a list of the values found for the rows of a page (page_id, at), null elsewhere. The pages stay where they are."""
    pair = F.struct("at", value.alias("value"))
    listed = found.groupBy("page_id").agg(F.collect_list(pair).alias("_found"))
    joined = pages.join(listed, "page_id", "left")
    return joined.withColumn(name, places.at_positions(F.size("rows"), F.col("_found.at"), F.col("_found.value"))).drop("_found")


def new_href() -> Column:
    """A found link is "=" with its new target, or "-" where it is unwrapped."""
    return F.coalesce(F.concat(F.lit("="), F.col("new_href")), F.lit("-"))


def apply_links(pages: DataFrame, name: str = "_href") -> DataFrame:
    def linked(r: Column, i: Column) -> Column:
        found = F.get(name, i)
        attrs = F.when(found.isNotNull(), t.set_attr(r["attrs"], "href", F.substr(found, F.lit(2)))).otherwise(r["attrs"])
        return F.when(F.coalesce(found != "-", F.lit(True)), node(r, attrs=attrs))

    rows = F.filter(F.transform(ROWS, linked), lambda r: r.isNotNull())
    return pages.withColumn("rows", F.when(F.col(name).isNull(), F.col(ROWS)).otherwise(rows)).drop(name)


def rewrite_links_and_images(pages: DataFrame, files: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Links and image sources looked up in the tables of the book. Read ``pages`` from a stored table."""
    links = clean.resolve_links(attribute_rows(pages, "a", "href", "site", "url"), files)
    found = with_values(pages, links, new_href(), "_href")
    if assets is not None:
        images = clean.resolve_images(attribute_rows(pages, "img", "src", "site"), assets).filter("output IS NOT NULL")
        found = with_values(found, images, F.col("new_src"), "_src")

        def sourced(r: Column, i: Column) -> Column:
            new = F.get("_src", i)
            return node(r, attrs=F.when(new.isNotNull(), t.set_attr(r["attrs"], "src", new)).otherwise(r["attrs"]))

        found = found.withColumn("rows", F.transform(ROWS, sourced)).drop("_src")
    return apply_links(found)


def figures_and_headers(pages: DataFrame) -> DataFrame:
    """Images have alternative text and stand in figures where a block holds them; tables without header cells get some."""
    is_row = tagged("tr")
    place = places.parents_and_first_rows(OPENED, CLOSED, marks(is_element, is_row, tagged("table"), tagged("th")))
    placed = pages.withColumn("_place", place)

    def rewritten(r: Column, i: Column) -> Column:
        above = F.get(F.col("_place.parent"), i)
        parent = F.coalesce(F.get(ROWS, above)["tag"], F.lit("body"))
        alt = F.coalesce(F.nullif(attr(r, "alt"), F.lit("")), F.lit(clean.DEFAULT_ALT))
        image = node(r, attrs=t.set_attr(r["attrs"], "alt", alt))
        opened = r["open_seq"] - 1
        figure = node(
            r, open_seq=opened, close_seq=r["close_seq"] + 1, node_id=opened, kind=F.lit("element"),
            tag=F.lit("figure"), attrs=F.array().cast(t.NO_ATTRS), text=F.lit(None).cast("string"),
        )
        promoted = (r["tag"] == "td") & F.coalesce(F.get(F.col("_place.first_row"), above), F.lit(False))
        header = node(r, tag=F.lit("th"), attrs=t.set_attr(r["attrs"], "scope", F.lit("col")))
        is_image = r["tag"] == "img"
        return (
            F.when(is_image & (parent != "figure") & parent.isin(*clean.BLOCK_CONTAINERS), F.array(figure, image))
            .when(is_image, F.array(image))
            .when(promoted, F.array(header))
            .otherwise(F.array(node(r)))
        )

    return placed.withColumn("rows", F.flatten(F.transform(ROWS, rewritten))).drop("_place")


def prune_dangling_fragments(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Second pass over all chapters of a site: needs every chapter's ids, so read ``pages`` from a stored table."""
    links = attribute_rows(pages, "a", "href", "site", "file").filter(F.col("href").contains("#"))
    ids = F.filter(F.transform(ROWS, lambda r: attr(r, "id")), lambda name: name.isNotNull())
    named = pages.select("site", "file", F.explode(ids).alias("id")).distinct()
    return apply_links(with_values(pages, clean.prune_fragments(links, named, files), new_href(), "_href"))
