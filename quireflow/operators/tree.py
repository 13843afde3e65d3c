"""Set-oriented work on node tables.

All of it is windows and grouping within a page id. A page is one captured
document, so these groups are bounded by the single string they were parsed
from, and the node table keeps the partitioning of :func:`parse_html`: none of
these steps adds a shuffle, and none compares node pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADING_PATTERN = "^h([1-6])$"
REST = -1
NO_ATTRS = "array<struct<name: string, value: string>>"


def page() -> W:
    return W.partitionBy("page_id")


def in_order() -> W:
    return page().orderBy("open_seq")


def before() -> W:
    return in_order().rowsBetween(W.unboundedPreceding, -1)


def up_to() -> W:
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def after() -> W:
    """Everything later in document order, as a growing frame over the reverse order."""
    return page().orderBy(F.col("open_seq").desc()).rowsBetween(W.unboundedPreceding, -1)


def is_element(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def is_text() -> Column:
    return F.col("kind") == "text"


def heading_level(tag: Column | str = "tag") -> Column:
    """1..6 for h1..h6, else null."""
    return F.nullif(F.regexp_extract(tag, HEADING_PATTERN, 1), F.lit("")).cast("int")


def is_heading() -> Column:
    return F.col("tag").rlike(HEADING_PATTERN)


def attr(name: str, attrs: Column | str = "attrs") -> Column:
    """Attribute value; null when absent, empty when it has no value."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def has_attr(name: str, attrs: Column | str = "attrs") -> Column:
    return F.exists(attrs, lambda a: a["name"] == name)


def set_attr(attrs: Column | str, name: str, value: Column) -> Column:
    """Replace in place, or append."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.when(
        has_attr(name, attrs),
        F.transform(
            attrs,
            lambda a: F.struct(
                a["name"].alias("name"), F.when(a["name"] == name, value).otherwise(a["value"]).alias("value")
            ),
        ),
    ).otherwise(F.concat(attrs, F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def without_attrs(attrs: Column | str, names: tuple[str, ...]) -> Column:
    return F.filter(attrs, lambda a: ~a["name"].isin(*names))


def only_attrs(attrs: Column | str, names: tuple[str, ...]) -> Column:
    return F.filter(attrs, lambda a: a["name"].isin(*names))


def select_nodes(nodes: DataFrame, predicate: Column) -> DataFrame:
    return nodes.filter(predicate)


def inside(predicate: Column) -> Column:
    """Has an ancestor that matches: some earlier match is still open here."""
    reach = F.max(F.when(predicate, F.col("close_seq"))).over(before())
    return F.coalesce(reach > F.col("open_seq"), F.lit(False))


def next_match(predicate: Column) -> Column:
    """``open_seq`` of the next matching node in document order."""
    return F.min(F.when(predicate, F.col("open_seq"))).over(after())


def holds(predicate: Column) -> Column:
    """Has a descendant that matches: the next match opens before this node closes."""
    return F.coalesce(next_match(predicate) < F.col("close_seq"), F.lit(False))


def drop_subtrees(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Remove matching nodes with everything below them."""
    return (
        nodes.withColumn("_match", F.coalesce(predicate, F.lit(False)))
        .withColumn("_inside", inside(F.col("_match")))
        .filter(~F.col("_match") & ~F.col("_inside"))
        .drop("_match", "_inside")
    )


def unwrap(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Remove matching nodes and keep their children; intervals need no repair."""
    return nodes.filter(~F.coalesce(predicate, F.lit(False)))


def _events(nodes: DataFrame, predicate: Column) -> DataFrame:
    """Every node at its opening (role 0), and matches again as openers (1) and closers (2), with nesting levels."""
    marker = lambda seq, role, step: F.struct(
        seq.alias("seq"), F.lit(role).alias("role"), F.lit(step).alias("step")
    )
    here = marker(F.col("open_seq"), 0, 0)
    markers = F.when(
        F.coalesce(predicate, F.lit(False)),
        F.array(here, marker(F.col("open_seq"), 1, 1), marker(F.col("close_seq"), 2, -1)),
    ).otherwise(F.array(here))
    events = page().orderBy("_event.seq", "_event.role")
    return nodes.select("*", F.explode(markers).alias("_event")).withColumn(
        "_level", F.sum("_event.step").over(events.rowsBetween(W.unboundedPreceding, 0))
    )


def enclosing(nodes: DataFrame, predicate: Column, value: Column, name: str) -> DataFrame:
    """Add ``value`` of the nearest matching ancestor as column ``name``, null where there is none.

    At nesting level n the open match is the last one that opened to level n,
    so two running windows find it.
    """
    opener = F.col("_event.role") == 1
    by_level = W.partitionBy("page_id", "_level").orderBy("_event.seq", "_event.role")
    last_opened = F.last(F.when(opener, F.struct(value.alias("found"))), ignorenulls=True).over(
        by_level.rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        _events(nodes, predicate)
        .filter(F.col("_event.role") < 2)
        .withColumn(name, F.when(F.col("_level") > 0, last_opened["found"]))
        .filter(F.col("_event.role") == 0)
        .drop("_event", "_level")
    )


def with_parent(nodes: DataFrame) -> DataFrame:
    """Bring ``parent_id`` up to date and add ``parent_tag``."""
    parent = F.struct(F.col("open_seq").alias("id"), F.col("tag").alias("tag"))
    return (
        enclosing(nodes, F.col("kind") == "element", parent, "_parent")
        .withColumn("parent_id", F.col("_parent.id"))
        .withColumn("parent_tag", F.col("_parent.tag"))
        .drop("_parent")
    )


def containment(nodes: DataFrame, ancestor: Column, descendant: Column) -> DataFrame:
    """One row per (matching ancestor, matching descendant): descendant columns plus ``ancestor_id``.

    The output is as long as the true pairs; nothing else is compared.
    """
    opener = F.col("_event.role") == 1
    by_level = W.partitionBy("page_id", "_at").orderBy("_event.seq", "_event.role")
    levels = F.when(opener, F.array("_level")).when(
        F.col("_level") > 0, F.sequence(F.lit(1).cast("long"), F.col("_level"))
    )
    last_opened = F.last(F.when(opener, F.col("open_seq")), ignorenulls=True).over(
        by_level.rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        _events(nodes, ancestor)
        .filter((F.col("_event.role") == 1) | ((F.col("_event.role") == 0) & descendant))
        .select("*", F.explode(levels).alias("_at"))
        .withColumn("ancestor_id", last_opened)
        .filter(F.col("_event.role") == 0)
        .drop("_event", "_level", "_at")
    )


def descendants(nodes: DataFrame, ancestor: Column, descendant: Column) -> DataFrame:
    return containment(nodes, ancestor, descendant)


def children(nodes: DataFrame, parent: Column, child_tag: str) -> DataFrame:
    """Direct children by tag of matching parents, with ``parent_id`` up to date."""
    found = enclosing(
        nodes, F.col("kind") == "element", F.struct(F.col("open_seq").alias("id"), parent.alias("wanted")), "_parent"
    )
    return (
        found.filter((F.col("tag") == child_tag) & F.col("_parent.wanted"))
        .withColumn("parent_id", F.col("_parent.id"))
        .drop("_parent")
    )


def ordered_text(pieces: Column, separator: str = "") -> Column:
    """Join array<struct<open_seq, text>> in document order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["text"]), separator)


def _stripped_text() -> Column:
    from ..functions.text import strip_ws

    return F.nullif(strip_ws("text"), F.lit(""))


def _sliced_text(nodes: DataFrame, predicate: Column, piece: Column, separator: str) -> DataFrame:
    """(page_id, node_id, text): for each match, the pieces of the text nodes below it, joined; empty where there are none.

    Pieces are written one after the other into one text per page, and running byte counts
    tell each match where its part begins and ends. So nested matches cost their own
    text each, and no pairs of a match and a text node are made.
    """
    match, width = F.coalesce(predicate, F.lit(False)), len(separator.encode())
    used = nodes.select("page_id", "open_seq", "close_seq", match.alias("_match"), F.when(is_text(), piece).alias("_piece"))
    used = used.filter(F.col("_match") | F.col("_piece").isNotNull())
    size = F.coalesce(F.octet_length("_piece") + width, F.lit(0))
    here = F.struct(F.col("open_seq").alias("seq"), F.lit(0).alias("role"), size.alias("size"))
    end = F.struct(F.col("close_seq").alias("seq"), F.lit(1).alias("role"), F.lit(0).alias("size"))
    events = used.select("*", F.explode(F.when(F.col("_match"), F.array(here, end)).otherwise(F.array(here))).alias("_event"))
    running = page().orderBy("_event.seq", "_event.role").rowsBetween(W.unboundedPreceding, 0)
    counted = events.withColumn("_bytes", F.sum("_event.size").over(running))
    opened = F.col("_event.role") == 0
    spans = counted.groupBy("page_id", "open_seq").agg(
        F.first("_match").alias("_match"),
        F.max(F.when(opened, F.col("_piece"))).alias("_piece"),
        F.min("_bytes").alias("start"),
        F.max("_bytes").alias("stop"),
    )
    pages = spans.groupBy("page_id").agg(
        ordered_text(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("open_seq", F.concat("_piece", F.lit(separator)).alias("text"))))).cast("binary").alias("_all"),
        F.collect_list(F.when(F.col("_match"), F.struct(F.col("open_seq").alias("node_id"), "start", "stop"))).alias("_spans"),
    )
    length = lambda m: F.greatest(m["stop"] - m["start"] - width, F.lit(0)).cast("int")
    part = lambda m: F.substring(F.col("_all"), (m["start"] + 1).cast("int"), length(m)).cast("string")
    found = F.transform("_spans", lambda m: F.struct(m["node_id"].alias("node_id"), part(m).alias("text"), (m["stop"] > m["start"]).alias("any")))
    return pages.select("page_id", F.inline(found))


def subtree_text(nodes: DataFrame, predicate: Column) -> DataFrame:
    """(page_id, node_id, text): all text below each matching node, in document order."""
    return _sliced_text(nodes, predicate, F.col("text"), "").drop("any")


def page_text(nodes: DataFrame, separator: str | None = None) -> DataFrame:
    """(page_id, text) of whole pages: plain concatenation, or stripped pieces joined by a separator."""
    piece = F.col("text") if separator is None else _stripped_text()
    pieces = F.collect_list(
        F.when(is_text() & piece.isNotNull(), F.struct("open_seq", piece.alias("text")))
    )
    return nodes.groupBy("page_id").agg(ordered_text(pieces, separator or "").alias("text"))


def joined_text(nodes: DataFrame, predicate: Column, separator: str) -> DataFrame:
    """(page_id, node_id, text): stripped, non-empty text nodes below each match, joined."""
    return _sliced_text(nodes, predicate, _stripped_text(), separator).filter("any").drop("any")


def subtree_flags(nodes: DataFrame, predicate: Column, kept: Column) -> DataFrame:
    """Matching nodes with ``has_text`` and ``has_kept`` (a descendant that matches ``kept``)."""
    return (
        nodes.withColumn("has_text", holds(is_text() & (F.col("text") != "")))
        .withColumn("has_kept", holds(kept))
        .filter(predicate)
    )


def grouped_columns(nodes: DataFrame) -> list[str]:
    """Field order of the row structs in :func:`rewrite_groups`: ``open_seq`` first, to sort by."""
    return ["open_seq", *(name for name in nodes.columns if name != "open_seq")]


def rewrite_groups(nodes: DataFrame, key: Column, rewrite, **prepared) -> DataFrame:
    """Group rows of a page by ``key``, map each group's row array, and flatten again.

    ``rewrite`` and the ``prepared`` columns, computed in order before it, are
    functions of (key, rows).

    Rows that need no rewrite share the key ``REST``, so a page makes one group
    plus one per rewritten subtree.
    """
    rows = F.array_sort(F.collect_list(F.struct(*grouped_columns(nodes))))
    grouped = nodes.withColumn("_key", key).groupBy("page_id", "_key").agg(rows.alias("_rows"))
    for name, make in prepared.items():
        grouped = grouped.withColumn(name, make(F.col("_key"), F.col("_rows")))
    return grouped.select(F.inline(rewrite(F.col("_key"), F.col("_rows")))).select(*nodes.columns)


def island_text(key: Column, at: Column) -> Column:
    """Text of the island of rows that share a ``key``, at the rows where ``at`` holds, null elsewhere.

    Rows without a key are in no island: they pass through the window, but nothing of them is collected.
    """
    island = F.when(key.isNotNull() & is_text(), F.struct("open_seq", "text"))
    return F.when(at, ordered_text(F.collect_list(island).over(W.partitionBy("page_id", key))))


def with_text(nodes: DataFrame, predicate: Column, name: str = "inner_text") -> DataFrame:
    """Add the text below each matching node, up to matches inside it, as a column of that node, null elsewhere."""
    marked = nodes.withColumn("_self", F.coalesce(predicate, F.lit(False)))
    keyed = enclosing(marked, F.col("_self"), F.col("open_seq"), "_outer")
    keyed = keyed.withColumn("_island", F.when(F.col("_self"), F.col("open_seq")).otherwise(F.col("_outer")))
    return keyed.withColumn(name, island_text(F.col("_island"), F.col("_self"))).drop("_self", "_outer", "_island")


def append_rows(nodes: DataFrame, condition: Column, *rows: Column) -> DataFrame:
    """Where ``condition`` holds, emit the node and the given extra node structs."""
    columns = nodes.columns
    extras = F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(*columns), *rows)).otherwise(
        F.array(F.struct(*columns))
    )
    return nodes.select(F.inline(extras))


def new_node(nodes: DataFrame, **fields: Column) -> Column:
    """A struct shaped like a node row: page columns copied, node columns given or empty."""
    defaults = {
        "parent_id": F.lit(None).cast("long"),
        "kind": F.lit("element"),
        "tag": F.lit(""),
        "attrs": F.array().cast(NO_ATTRS),
        "text": F.lit(None).cast("string"),
        "close_seq": fields["open_seq"],
        "node_id": fields["open_seq"],
    }
    values = {**defaults, **fields}
    schema = {field.name: field.dataType for field in nodes.schema.fields}
    return F.struct(
        *(values.get(name, F.col(name)).cast(schema[name]).alias(name) for name in nodes.columns)
    )


def serialize(nodes: DataFrame, *keys: str, name: str = "html") -> DataFrame:
    """XML text per page (or per ``keys``): empty elements self-closed, empty attributes kept."""
    keys = keys or ("page_id",)

    def escaped(value: Column, *pairs: tuple[str, str]) -> Column:
        for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *pairs):
            value = F.replace(value, F.lit(plain), F.lit(reference))
        return value

    attributes = F.array_join(
        F.transform(
            "attrs",
            lambda a: F.concat(
                F.lit(" "),
                a["name"],
                F.lit('="'),
                escaped(a["value"], ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")),
                F.lit('"'),
            ),
        ),
        "",
    )
    following = F.lead("open_seq").over(W.partitionBy("page_id").orderBy("open_seq"))
    marked = nodes.withColumn("_full", F.coalesce(following < F.col("close_seq"), F.lit(False)))
    event = lambda seq, text: F.struct(seq.alias("seq"), text.alias("text"))
    start = F.concat(F.lit("<"), F.col("tag"), attributes)
    events = (
        F.when(is_text(), F.array(event(F.col("open_seq"), escaped(F.col("text"), ("\r", "&#13;")))))
        .when(
            F.col("kind") == "comment",
            F.array(event(F.col("open_seq"), F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))),
        )
        .when(
            F.col("_full"),
            F.array(
                event(F.col("open_seq"), F.concat(start, F.lit(">"))),
                event(F.col("close_seq"), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))),
            ),
        )
        .otherwise(F.array(event(F.col("open_seq"), F.concat(start, F.lit("/>")))))
    )
    return (
        marked.select(*keys, F.inline(events))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda e: e["text"]), "").alias(name))
    )
