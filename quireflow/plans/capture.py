"""From captured pages to page records: content, titles, navigation, metadata, images.

Works on node tables of whole pages that carry the page ``url``. What the
markup states is used; nothing is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import asset_name, sha256_hex
from ..functions.text import site_name, strip_ws
from ..functions.url import url_join
from ..operators import tree as t
from ..operators.selectors import marked

# What is left out of page content, and how brand images are scored.
BOILERPLATE_TAGS = ("script", "style", "noscript", "button", "input", "textarea", "select", "nav")
PRESENTATION_ATTRIBUTES = ("style", "class", "onclick")
HIDDEN_STYLE = r"(?i)display\s*:\s*none"
DEFAULT_LANGUAGE = "en"
EMBEDDED = "Embedded content"
DIAGRAM = "Diagram"
SVG_NAMESPACE = ' xmlns="http://www.w3.org/2000/svg"'
LOGO_WORDS = "(?i)logo|brand"
LOGO_MIN_SCORE = 2


def _is(name: str, value: str) -> Column:
    return F.coalesce(t.attr(name) == value, F.lit(False))


def boilerplate() -> Column:
    return (
        F.col("tag").isin(*BOILERPLATE_TAGS) | _is("role", "navigation") | _is("aria-hidden", "true")
    )


def drop_boilerplate(nodes: DataFrame) -> DataFrame:
    return t.drop_subtrees(nodes, boilerplate())


def drop_attrs(nodes: DataFrame, names: tuple[str, ...] = PRESENTATION_ATTRIBUTES) -> DataFrame:
    return nodes.withColumn("attrs", t.without_attrs("attrs", names))


def drop_hidden(nodes: DataFrame) -> DataFrame:
    """Subtrees the markup itself hides, by attribute or inline style."""
    hidden = t.has_attr("hidden") | F.coalesce(t.attr("style").rlike(HIDDEN_STYLE), F.lit(False))
    return t.drop_subtrees(nodes, hidden)


def label_tab_panels(nodes: DataFrame) -> DataFrame:
    """Show every controlled tab panel and head it with its tab's text.

    Tabs and panels meet in a window on (page, id); the first element with an id
    is the panel. Where several tabs share a panel the last tab's label comes first.
    """
    is_tab = _is("role", "tab") & t.attr("aria-controls").isNotNull()
    labelled = t.with_text(nodes, is_tab, "_label")
    ref = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("key"))
    refs = F.filter(
        F.array(
            ref(0, F.lit(None).cast("string")),
            ref(1, t.attr("id")),
            ref(2, F.when(is_tab, t.attr("aria-controls"))),
        ),
        lambda r: (r["role"] == 0) | r["key"].isNotNull(),
    )
    label = F.struct((-F.col("open_seq")).alias("order"), strip_ws("_label").alias("text"))
    by_id = W.partitionBy("page_id", "_ref.key")
    first_id = F.min(F.when(F.col("_ref.role") == 1, F.col("open_seq"))).over(by_id)
    met = (
        labelled.select("*", F.explode(refs).alias("_ref"))
        .withColumn("_found", F.array_sort(F.collect_list(F.when(F.col("_ref.role") == 2, label)).over(by_id)))
        .withColumn("_is_panel", (F.col("_ref.role") == 1) & (F.col("open_seq") == first_id))
        .withColumn(
            "_labels",
            F.max(F.when(F.col("_is_panel") & (F.size("_found") > 0), F.col("_found"))).over(
                W.partitionBy("page_id", "open_seq")
            ),
        )
        .filter(F.col("_ref.role") == 0)
        .drop("_ref", "_found", "_is_panel", "_label")
    )
    is_panel = F.col("_labels").isNotNull()
    shown = met.withColumn(
        "attrs",
        F.when(is_panel, t.without_attrs("attrs", ("hidden", "aria-hidden", "style"))).otherwise(F.col("attrs")),
    )
    columns = nodes.columns
    none = F.array().cast(t.NO_ATTRS)

    def heading(found: Column, i: Column) -> Column:
        opened = F.col("open_seq") + 1 + i * 3
        fields = lambda seq, close, kind, tag, text: {
            "open_seq": seq, "close_seq": close, "node_id": seq, "parent_id": F.col("open_seq"),
            "kind": F.lit(kind), "tag": F.lit(tag), "attrs": none, "text": text,
        }
        parts = (
            fields(opened, opened + 2, "element", "h3", F.lit(None).cast("string")),
            fields(opened + 1, opened + 1, "text", "", found["text"]),
        )
        return F.array(*(F.struct(*(p.get(c, F.col(c)).alias(c) for c in columns)) for p in parts))

    own = F.array(F.struct(*columns))
    extra = F.flatten(F.transform("_labels", heading))
    return shown.select(F.inline(F.when(is_panel, F.concat(own, extra)).otherwise(own)))


def iframe_to_link(nodes: DataFrame, url: str = "url") -> DataFrame:
    """A frame becomes a link to what it shows."""
    is_frame = F.col("tag") == "iframe"
    emptied = nodes.withColumn("_in_frame", t.inside(is_frame)).filter(~F.col("_in_frame")).drop("_in_frame")
    source = F.coalesce(t.attr("src"), F.lit(""))
    target = F.when(source == "", "").otherwise(url_join(url, source))
    label = F.coalesce(F.nullif(t.attr("title"), F.lit("")), F.lit(EMBEDDED))
    text = t.new_node(
        emptied,
        open_seq=F.col("open_seq") + 1,
        close_seq=F.col("open_seq") + 1,
        kind=F.lit("text"),
        text=label,
        parent_id=F.col("open_seq"),
    )
    return (
        t.append_rows(emptied.withColumn("_target", target), is_frame, text.withField("_target", F.lit(None).cast("string")))
        .withColumn(
            "attrs",
            F.when(is_frame, F.array(F.struct(F.lit("href").alias("name"), F.col("_target").alias("value")))).otherwise(
                F.col("attrs")
            ),
        )
        .withColumn("close_seq", F.when(is_frame, F.greatest("close_seq", F.col("open_seq") + 2)).otherwise(F.col("close_seq")))
        .withColumn("tag", F.when(is_frame, "a").otherwise(F.col("tag")))
        .drop("_target")
    )


def content_rank(*selectors: Column) -> Column:
    """Rank of a node as content root: own selectors first, then the usual containers; null for none."""
    in_main = F.col("_in_main")
    is_article, is_main = F.col("tag") == "article", F.col("tag") == "main"
    classed = F.coalesce(F.contains(t.attr("class"), F.lit("content")), F.lit(False))
    ranked = [*selectors, is_article & in_main, is_article, in_main & classed, is_main, _is("role", "main")]
    rank = F.when(ranked[0], 0)
    for position, predicate in enumerate(ranked[1:], 1):
        rank = rank.when(predicate, position)
    return rank


def first_match(nodes: DataFrame, rank: Column, name: str) -> DataFrame:
    """Add the first node of the best rank on each page, as struct<rank, open_seq, close_seq>."""
    ranked = nodes.withColumn("_rank", rank)
    chosen = F.min(
        F.when(F.col("_rank").isNotNull(), F.struct(F.col("_rank").alias("rank"), "open_seq", "close_seq"))
    ).over(t.page())
    return ranked.withColumn(name, chosen).drop("_rank")


def content_root(nodes: DataFrame, *selectors: Column | str) -> DataFrame:
    """Nodes inside the content root. Pages without one give no rows.

    Own selectors, strings or predicates, win over the usual containers where they match.
    """
    nodes, own, added = marked(nodes, selectors)
    nodes = nodes.withColumn("_in_main", t.inside(F.col("tag") == "main"))
    chosen = first_match(nodes, content_rank(*own), "_root")
    return chosen.filter(
        (F.col("open_seq") > F.col("_root.open_seq")) & (F.col("open_seq") < F.col("_root.close_seq"))
    ).drop("_in_main", "_root", *added)


def rooted_pages(nodes: DataFrame, *selectors: Column | str) -> DataFrame:
    """(page_id) of pages that have a content root, empty or not."""
    nodes, own, _ = marked(nodes, selectors)
    nodes = nodes.withColumn("_in_main", t.inside(F.col("tag") == "main"))
    return nodes.filter(content_rank(*own).isNotNull()).select("page_id").distinct()


def nav_rank(*selectors: Column) -> Column:
    labelled = F.coalesce(F.lower(t.attr("aria-label")).contains("doc"), F.lit(False))
    ranked = [
        *selectors,
        _is("id", "sidebar-content"),
        (F.col("tag") == "nav") & labelled,
        (F.col("tag") == "nav") & F.col("_in_aside"),
        F.col("tag") == "aside",
    ]
    rank = F.when(ranked[0], 0)
    for position, predicate in enumerate(ranked[1:], 1):
        rank = rank.when(predicate, position)
    return rank


def nav_links(nodes: DataFrame, *selectors: Column | str) -> DataFrame:
    """(page_id, url, pos, title, href): links of the page's navigation, absolute, in order."""
    nodes, own, added = marked(nodes, selectors)
    nodes = nodes.withColumn("_in_aside", t.inside(F.col("tag") == "aside"))
    chosen = first_match(nodes, nav_rank(*own), "_nav")
    within = chosen.filter(
        (F.col("open_seq") > F.col("_nav.open_seq")) & (F.col("open_seq") < F.col("_nav.close_seq"))
    ).drop("_in_aside", "_nav", *added)
    is_link = (F.col("tag") == "a") & t.has_attr("href")
    texted = t.with_text(within, is_link, "_title").filter(is_link)
    return texted.select(
        "page_id",
        "url",
        F.col("open_seq").alias("pos"),
        strip_ws("_title").alias("title"),
        url_join("url", t.attr("href")).alias("href"),
    )


def page_titles(nodes: DataFrame) -> DataFrame:
    """(page_id, title, language): first h1, else the title element; html lang, else English."""

    def first(tag: str) -> Column:
        return F.min(F.when(F.col("tag") == tag, F.struct("open_seq", "close_seq"))).over(t.page())

    marked = nodes.withColumn("_h1", first("h1")).withColumn("_title", first("title"))

    def text_in(name: str) -> Column:
        within = t.is_text() & (F.col("open_seq") > F.col(f"{name}.open_seq")) & (F.col("open_seq") < F.col(f"{name}.close_seq"))
        return strip_ws(t.ordered_text(F.collect_list(F.when(within, F.struct("open_seq", "text")))))

    language = F.min_by(
        F.when(F.col("tag") == "html", t.attr("lang")), F.when(F.col("tag") == "html", F.col("open_seq"))
    )
    return marked.groupBy("page_id").agg(
        F.coalesce(F.nullif(text_in("_h1"), F.lit("")), text_in("_title")).alias("title"),
        F.coalesce(F.nullif(language, F.lit("")), F.lit(DEFAULT_LANGUAGE)).alias("language"),
    )


def inline_svg_to_image(nodes: DataFrame) -> DataFrame:
    """Outermost drawings become images named by their markup; the raster itself is not made here."""
    from .clean import enclosing_outermost

    keyed = enclosing_outermost(nodes, F.col("tag") == "svg", "_svg")
    drawings = keyed.filter("_svg IS NOT NULL")
    markup = t.serialize(drawings, "page_id", "_svg", name="_markup")
    namespaced = F.when(F.col("_markup").contains("xmlns="), F.col("_markup")).otherwise(
        F.concat(F.substring("_markup", 1, 4), F.lit(SVG_NAMESPACE), F.substr("_markup", F.lit(5)))
    )
    names = markup.select(
        "page_id",
        F.col("_svg").alias("open_seq"),
        F.concat(F.substring(sha256_hex(namespaced), 1, 20), F.lit(".png")).alias("_asset"),
    )
    kept = keyed.filter("_svg IS NULL OR _svg = open_seq").join(names, ["page_id", "open_seq"], "left")
    is_drawing = F.col("_svg").isNotNull()
    alt = F.coalesce(t.attr("aria-label"), t.attr("title"), F.lit(DIAGRAM))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    attrs = F.array(pair("src", F.concat(F.lit("assets/"), "_asset")), pair("alt", alt))
    return (
        kept.withColumn("attrs", F.when(is_drawing, attrs).otherwise(F.col("attrs")))
        .withColumn("close_seq", F.when(is_drawing, F.col("open_seq")).otherwise(F.col("close_seq")))
        .withColumn("tag", F.when(is_drawing, "img").otherwise(F.col("tag")))
        .select(*nodes.columns)
    )


def fetchable_images(nodes: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """(page_id, node_id, url, src): images with a source to download.

    ``generated(page_id, node_id)`` names images made here, from drawings; they have nothing to download.
    """
    if generated is not None:
        nodes = nodes.join(generated.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")
    source = t.attr("src")
    return nodes.filter(
        (F.col("tag") == "img") & (F.coalesce(source, F.lit("")) != "") & ~source.startswith("data:")
    ).select("page_id", "node_id", "url", source.alias("src"))


def asset_table(images: DataFrame, responses: DataFrame) -> DataFrame:
    """Each image with its asset name, or a warning where the download failed.

    ``responses(url, status, content_type)`` is one row per URL; a popular image
    makes a hot key on the image side only, which the adaptive skew join splits.
    """
    absolute = images.withColumn("image_url", url_join("url", "src"))
    answers = responses.select(F.col("url").alias("image_url"), "status", "content_type")
    joined = absolute.join(answers, "image_url", "left")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    problem = F.when(F.col("status").isNull(), F.lit("no response")).otherwise(
        F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    )
    return joined.select(
        "page_id",
        "node_id",
        "image_url",
        F.when(ok, asset_name("image_url", F.coalesce("content_type", F.lit("")))).alias("asset"),
        F.when(~ok, F.concat(F.lit("Could not download image "), "image_url", F.lit(": "), problem)).alias("warning"),
    )


def capture_warnings(assets: DataFrame) -> DataFrame:
    return assets.filter("warning IS NOT NULL").select("page_id", "node_id", "warning")


def response_outcome(responses: DataFrame) -> Column:
    """ok, status (answered with an error) or transport (no answer: ``error`` says why, or there is no status)."""
    failed = F.col("error").isNotNull() if "error" in responses.columns else F.lit(False)
    return (
        F.when(failed | F.col("status").isNull(), "transport").when(F.col("status").between(200, 299), "ok").otherwise("status")
    )


def ok_responses(responses: DataFrame) -> DataFrame:
    return responses.filter(response_outcome(responses) == "ok")


def response_findings(responses: DataFrame) -> DataFrame:
    """A finding for each of ``responses(site, url, status[, error])`` that is not ok; a failed transport is an error, a status a warning."""
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    outcome = response_outcome(responses)
    problem = F.when(outcome == "transport", F.coalesce(error, F.lit("no response"))).otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    empty = F.lit(None).cast("string")
    return responses.withColumn("_outcome", outcome).filter("_outcome <> 'ok'").select(
        "site",
        F.when(F.col("_outcome") == "transport", "RESPONSE_FAILED").otherwise("RESPONSE_STATUS").alias("code"),
        F.when(F.col("_outcome") == "transport", "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("Could not fetch "), "url", F.lit(": "), problem).alias("message"),
        F.lit("scrape").alias("stage"), "url", empty.alias("file"), empty.alias("hint"),
    )


def site_metadata(nodes: DataFrame) -> DataFrame:
    """(page_id, name, description, author, theme_colors) from the heads of entry pages."""
    by_name = F.lower(F.coalesce(t.attr("name"), F.lit("")))
    by_property = F.lower(F.coalesce(t.attr("property"), F.lit("")))
    value = strip_ws(F.coalesce(t.attr("content"), F.lit("")))
    is_meta = F.col("tag") == "meta"

    def first(wanted: str) -> Column:
        match = is_meta & ((by_name == wanted) | (by_property == wanted))
        return F.coalesce(F.min_by(F.when(match, value), F.when(match, F.col("open_seq"))), F.lit(""))

    title_span = F.min(F.when(F.col("tag") == "title", F.struct("open_seq", "close_seq"))).over(t.page())
    marked = nodes.withColumn("_title", title_span)
    in_title = t.is_text() & F.col("open_seq").between(F.col("_title.open_seq"), F.col("_title.close_seq"))
    title = t.ordered_text(F.collect_list(F.when(in_title, F.struct("open_seq", "text"))))
    color = is_meta & (by_name == "theme-color") & (value != "")
    colors = F.transform(
        F.array_sort(F.collect_list(F.when(color, F.struct("open_seq", value.alias("value"))))), lambda c: c["value"]
    )
    found = marked.groupBy("page_id").agg(
        first("og:site_name").alias("og"),
        first("application-name").alias("application"),
        first("description").alias("plain"),
        first("og:description").alias("og_description"),
        first("author").alias("author"),
        title.alias("title"),
        colors.alias("theme_colors"),
    )
    return found.select(
        "page_id",
        site_name("og", "application", "title").alias("name"),
        F.coalesce(F.nullif("plain", F.lit("")), F.col("og_description")).alias("description"),
        "author",
        "theme_colors",
    )


def site_title(override: Column, metadata_name: Column, page_title: Column) -> Column:
    return F.coalesce(override, F.nullif(metadata_name, F.lit("")), page_title)


def pick_logo(nodes: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, node_id, score, src) of the likeliest brand image of each page.

    Three points for a telling label, two for a home link around it, one for the
    header; at least two; ties go to document order.
    """
    content = F.col("tag").isin("main", "article") | _is("role", "main")
    home = url_join(url, F.lit("/"))
    href = F.coalesce(t.attr("href"), F.lit(""))
    is_home = (href == "/") | ((href != "") & (url_join(url, href) == home))
    marked = (
        t.enclosing(nodes, F.col("tag") == "a", is_home, "_home")
        .withColumn("_in_content", t.inside(content))
        .withColumn("_in_header", t.inside(F.col("tag") == "header"))
        .withColumn("_in_nav", t.inside(F.col("tag") == "nav"))
    )
    label = F.concat_ws(" ", *(F.coalesce(t.attr(name), F.lit("")) for name in ("class", "alt", "id", "src")))
    placed = F.col("_in_header") | (F.col("_in_nav") & (F.col("tag") == "img")) | F.col("_home").isNotNull()
    score = (
        F.when(label.rlike(LOGO_WORDS), 3).otherwise(0)
        + F.when(F.coalesce("_home", F.lit(False)), 2).otherwise(0)
        + F.when(F.col("_in_header"), 1).otherwise(0)
    )
    candidates = marked.filter(F.col("tag").isin("img", "svg") & placed & ~F.col("_in_content")).withColumn(
        "score", score
    )
    best = F.row_number().over(W.partitionBy("page_id").orderBy(F.col("score").desc(), "open_seq"))
    return (
        candidates.filter(F.col("score") >= LOGO_MIN_SCORE)
        .withColumn("_place", best)
        .filter("_place = 1")
        .select("page_id", "node_id", "score", t.attr("src").alias("src"))
    )


def pick_icon(nodes: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, node_id, icon): touch icons first, then the largest."""
    rel = F.split(F.lower(F.coalesce(t.attr("rel"), F.lit(""))), r"\s+")
    touch = F.array_contains(rel, "apple-touch-icon")
    size = F.coalesce(F.regexp_extract(F.coalesce(t.attr("sizes"), F.lit("0")), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0))
    best = F.row_number().over(
        W.partitionBy("page_id").orderBy(F.col("_touch").desc(), F.col("_size").desc(), "open_seq")
    )
    return (
        nodes.filter((F.col("tag") == "link") & (touch | F.array_contains(rel, "icon")) & t.has_attr("href"))
        .withColumn("_touch", touch)
        .withColumn("_size", size)
        .withColumn("_place", best)
        .filter("_place = 1")
        .select("page_id", "node_id", url_join(url, t.attr("href")).alias("icon"))
    )


def capture_content(nodes: DataFrame, *selectors: Column | str) -> DataFrame:
    """Whole-page nodes to content nodes, in capture order."""
    nodes = label_tab_panels(nodes)
    nodes = inline_svg_to_image(drop_hidden(content_root(nodes, *selectors)))
    nodes = drop_attrs(drop_boilerplate(nodes))
    return iframe_to_link(nodes)
