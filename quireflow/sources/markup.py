"""HTML pages as token and node tables.

Splitting, attribute parsing and character references are built-in expressions.
Only the element structure (who closes whom) goes through Python: one short
Arrow function per page that sees tag names, never text.

Node table, one row per node:

    page_id, node_id, parent_id, open_seq, close_seq, depth, kind, tag, attrs, text

A node's id is the ``open_seq`` it was created with. ``open_seq``/``close_seq`` are pre/post interval numbers: d is inside a when
``a.open_seq < d.open_seq AND d.open_seq < a.close_seq``. Token n opens at
``n * SEQ_GAP``. Closings fall in the middle of the gap before their token,
deeper first, so rewrites have 2**31 free numbers on either side. That is
enough for any rewrite of one string value, which holds fewer characters.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable
from xml.parsers import expat

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_lower, unescape_html

SEQ_GAP = 1 << 32
SEQ_CLOSE = 1 << 31
#: Markup in one partition of a node table. Its rows take many times that in a sort, and a rewrite may hold several.
PARTITION_BYTES = 8 << 20

# Token and attribute patterns (in the common subset of Java and
# RE2), void elements, and the recovery rules of the HTML subset read here.
TOKEN_PATTERN = (
    r"(?i)<!--[\s\S]*?(?:-->|\z)"
    r"|<script\b[^>]*>[\s\S]*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>[\s\S]*?(?:</style\s*>|\z)"
    r"|<[!?][^>]*>"
    r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
    r"|[^<]+|<"
)
# XML has no raw text elements, but sections of character data.
XML_TOKEN_PATTERN = (
    r"<!--[\s\S]*?(?:-->|\z)"
    r"|<!\[CDATA\[[\s\S]*?(?:\]\]>|\z)"
    r"|<[!?][^>]*>"
    r"""|</?[A-Za-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
    r"|[^<]+|<"
)
CDATA_START = "<![CDATA["
NAME_PATTERN = r"^</?([A-Za-z][^\s/>]*)"
RAW_PATTERN = r"(?i)^<(?:script|style)[\s/>]"
ATTRIBUTE_PATTERN = r"""([^\s"'<>/=]+)(\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
VOID_TAGS = (
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex",
    "link", "meta", "param", "source", "track", "wbr",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_STARTS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "dir",
    "div", "dl", "dt", *HEADINGS, "hr", "li", "ol", "p", "pre", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
)
# A start tag first closes the innermost open element while it is listed here.
IMPLIED_END = {
    "p": BLOCK_STARTS,
    **{tag: ("p",) for tag in ("b", "big", "s", "small", "strike", "tt", "u")},
    **{tag: ("p", "table", "li", "form", "fieldset") for tag in HEADINGS},
    "a": ("a",),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "td": ("td", "th", "tr", "tbody", "tfoot"),
    "th": ("td", "th", "tr", "tbody", "tfoot"),
    "tr": ("tr", "tbody", "tfoot"),
    "thead": ("tbody", "tfoot"),
    "tbody": ("tbody", "tfoot"),
    "tfoot": ("tbody",),
    "option": ("option", "optgroup"),
    "head": ("body", "article", "main", "nav", *BLOCK_STARTS),
}
# An end tag cannot reach past an open element of higher rank; unlisted tags rank 100.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
DEFAULT_RANK = 100

OPEN, CLOSE, VOID, TEXT, COMMENT, OTHER = "<", "/", "-", "t", "c", "o"


def _raw_list(html: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def token_kind(token: Column) -> Column:
    return (
        F.when(token.startswith("<!--"), "comment")
        .when(token.rlike(RAW_PATTERN), "raw")
        .when(token.rlike("^<[!?]"), "declaration")
        .when(token.rlike("^</[A-Za-z]"), "close")
        .when(token.rlike("^<[A-Za-z]"), "open")
        .otherwise("text")
    )


def token_tag(token: Column) -> Column:
    return ascii_lower(F.regexp_extract(token, NAME_PATTERN, 1))


def tokens(df: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Flat token stream (id, pos, token, kind, tag); every input character is in one token."""
    return df.select(
        id_column, F.posexplode(_raw_list(F.col(html_column))).alias("pos", "token")
    ).select(
        id_column,
        F.col("pos").cast("long").alias("pos"),
        "token",
        token_kind(F.col("token")).alias("kind"),
        token_tag(F.col("token")).alias("tag"),
    )


def _split_raw(token: Column) -> Column:
    """A script or style token as its start tag, its text and its end tag."""
    start = F.regexp_extract(token, r"^<[^>]*>", 0)
    end = F.regexp_extract(token, r"(?i)</(?:script|style)\s*>\z", 0)
    inner = F.substr(token, F.length(start) + 1, F.length(token) - F.length(start) - F.length(end))
    piece = lambda code, source: F.struct(code.alias("code"), source.alias("source"))
    tag = token_tag(token)
    pieces = F.array(
        piece(F.concat(F.lit(OPEN), tag), start),
        piece(F.lit("r"), inner),
        piece(F.concat(F.lit(CLOSE), tag), end),
    )
    return F.filter(pieces, lambda p: (p["code"] != "r") | (p["source"] != ""))


def _xml_piece(token: Column) -> Column:
    """A section of character data is text as it stands; an empty one is no text."""
    inner = F.regexp_replace(token, r"^<!\[CDATA\[|\]\]>\z", "")
    section = F.struct(F.lit("r").alias("code"), inner.alias("source"))
    return F.when(token.startswith(CDATA_START), F.filter(F.array(section), lambda p: p["source"] != "")).otherwise(
        _piece(token, xml=True)
    )


def _piece(token: Column, xml: bool = False) -> Column:
    tag = token_tag(token)
    empty = F.endswith(token, F.lit("/>"))
    if not xml:
        empty = empty | tag.isin(*VOID_TAGS)
    code = (
        F.when(token.startswith("<!--"), COMMENT)
        .when(token.rlike("^<[!?]"), OTHER)
        .when(token.rlike("^</[A-Za-z]"), F.concat(F.lit(CLOSE), tag))
        .when(token.rlike("^<[A-Za-z]"), F.concat(F.when(empty, VOID).otherwise(OPEN), tag))
        .otherwise(TEXT)
    )
    return F.array(F.struct(code.alias("code"), token.alias("source")))


def page_shape(codes: Iterable[str], implied_ends: bool = True) -> tuple[list[int], list[int], list[int]]:
    """Parent token, closing token and depth of every token of one page; -1 where none."""
    codes = list(codes)
    parent, closed_at, depth = [-1] * len(codes), [-1] * len(codes), [0] * len(codes)
    stack: list[tuple[str, int]] = []
    for at, code in enumerate(codes):
        kind, tag = code[:1], code[1:]
        if kind in (OPEN, VOID):
            while implied_ends and stack and tag in IMPLIED_END.get(stack[-1][0], ()):
                closed_at[stack.pop()[1]] = at
        elif kind == CLOSE:
            rank = END_RANK.get(tag, DEFAULT_RANK)
            for level in range(len(stack) - 1, -1, -1):
                if stack[level][0] == tag:
                    for _, opened in stack[level:]:
                        closed_at[opened] = at
                    del stack[level:]
                    break
                if implied_ends and END_RANK.get(stack[level][0], DEFAULT_RANK) > rank:
                    break
            continue
        if stack:
            parent[at] = stack[-1][1]
        depth[at] = len(stack) + 1
        if kind == OPEN:
            stack.append((tag, at))
    for _, opened in stack:
        closed_at[opened] = len(codes)
    return parent, closed_at, depth


_SHAPE_FIELDS = ("parent", "closed_at", "depth")
_SHAPE = pa.struct([(name, pa.list_(pa.int32())) for name in _SHAPE_FIELDS])
# Sent by value, so that executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


_SHAPE_TYPE = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in _SHAPE_FIELDS])


def _shape_batch(codes: pa.Array, implied_ends: bool) -> pa.Array:
    """The shapes of a batch. Only one page at a time is Python objects; results are kept as 32-bit numbers."""
    ends, columns = array("i", [0]), [array("i") for _ in _SHAPE_FIELDS]
    for page in codes:
        for column, values in zip(columns, page_shape(page.as_py() or [], implied_ends)):
            column.extend(values)
        ends.append(len(columns[0]))
    whole = lambda numbers: pa.Array.from_buffers(pa.int32(), len(numbers), [None, pa.py_buffer(numbers)])
    lists = [pa.ListArray.from_arrays(whole(ends), whole(column)) for column in columns]
    return pa.StructArray.from_arrays(lists, fields=list(_SHAPE))


@F.arrow_udf(_SHAPE_TYPE)
def _html_shapes(codes: pa.Array) -> pa.Array:
    return _shape_batch(codes, True)


@F.arrow_udf(_SHAPE_TYPE)
def _xml_shapes(codes: pa.Array) -> pa.Array:
    return _shape_batch(codes, False)


@F.arrow_udf(T.StringType())
def xml_error(documents: pa.Array) -> pa.Array:
    """The parser's message for each document that is not well-formed XML, else null."""
    messages = []
    for document in documents.to_pylist():
        try:
            expat.ParserCreate().Parse(document if document is not None else b"", True)
            messages.append(None)
        except expat.ExpatError as error:
            messages.append(str(error))
    return pa.array(messages, type=pa.string())


def parse_attributes(source: Column) -> Column:
    """Ordered array<struct<name, value>>; of a repeated name the first wins."""
    body = F.regexp_replace(F.regexp_replace(source, NAME_PATTERN, ""), r"/?>\z", "")
    names = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE_PATTERN), F.lit(1)), ascii_lower)
    values = F.transform(
        F.regexp_extract_all(body, F.lit(ATTRIBUTE_PATTERN), F.lit(3)),
        lambda v: unescape_html(F.regexp_replace(v, r"""^["']|["']\z""", "")),
    )
    pairs = F.transform(
        names, lambda n, i: F.struct(n.alias("name"), F.get(values, i).alias("value"))
    )
    return F.filter(pairs, lambda pair, i: F.array_position(names, pair["name"]) == i + 1)


def _partitions(df: DataFrame, html_column: str) -> int:
    """As many as the markup needs, so that the memory of one task does not follow the table; at least one for each core."""
    size = df.agg(F.sum(F.octet_length(F.col(html_column)).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))


def _shaped(df: DataFrame, id_column: str, html_column: str, keep: tuple[str, ...], xml: bool) -> tuple[DataFrame, Column]:
    """Pages dealt to their partitions, and the column of their tokens with their places."""
    if xml:
        pieces = F.flatten(F.transform(_raw_list(F.col(html_column), XML_TOKEN_PATTERN), _xml_piece))
    else:
        pieces = F.flatten(
            F.transform(
                _raw_list(F.col(html_column)),
                lambda t: F.when(t.rlike(RAW_PATTERN), _split_raw(t)).otherwise(_piece(t)),
            )
        )
    shaped = (
        df.select(id_column, *keep, pieces.alias("pieces"))
        .withColumn("shape", (_xml_shapes if xml else _html_shapes)(F.col("pieces.code")))
        .repartition(_partitions(df, html_column), id_column)
    )
    zipped = F.arrays_zip(
        F.col("pieces.code").alias("code"),
        F.col("pieces.source").alias("source"),
        F.col("shape.parent").alias("parent"),
        F.col("shape.closed_at").alias("closed_at"),
        F.col("shape.depth").alias("depth"),
    )
    return shaped, zipped


def _node_fields(pos: Column, code: Column, source: Column, parent: Column, closed_at: Column, depth: Column) -> dict[str, Column]:
    kind = F.substring(code, 1, 1)
    element = kind.isin(OPEN, VOID)
    return {
        "node_id": pos * SEQ_GAP,
        "parent_id": F.when(parent >= 0, parent * F.lit(SEQ_GAP)),
        "open_seq": pos * SEQ_GAP,
        "close_seq": F.when(closed_at >= 0, closed_at * F.lit(SEQ_GAP) - SEQ_CLOSE - depth).otherwise(pos * SEQ_GAP),
        "depth": depth,
        "kind": F.when(element, "element").when(kind == COMMENT, "comment").otherwise("text"),
        "tag": F.when(element, F.substr(code, F.lit(2))).otherwise(""),
        "attrs": F.when(element, parse_attributes(source)).otherwise(
            F.array().cast("array<struct<name: string, value: string>>")
        ),
        "text": F.when(kind == "r", source)
        .when(kind == TEXT, unescape_html(source))
        .when(kind == COMMENT, F.regexp_replace(source, r"^<!--|-->\z", "")),
    }


def _is_node(code: Column) -> Column:
    return F.substring(code, 1, 1).isin(OPEN, VOID, TEXT, "r", COMMENT)


def parse_html(
    df: DataFrame, id_column: str = "page_id", html_column: str = "html", *keep: str, xml: bool = False
) -> DataFrame:
    """Node table of every page. ``keep`` names page columns to carry along.

    ``xml`` reads well-formed XHTML: only end tags close elements, only ``/>``
    marks empty ones, scripts hold markup like others, and CDATA is text.

    Pages are shuffled once, as one compact row each, before they are exploded;
    the explode keeps that partitioning, so every later per-page window and
    join on the page id finds its rows in place. The markup is measured first, by
    a job of its own, and dealt to partitions of about ``PARTITION_BYTES``.
    """
    shaped, zipped = _shaped(df, id_column, html_column, keep, xml)
    parts = ("code", "source", "parent", "closed_at", "depth")
    rows = shaped.select(id_column, *keep, F.posexplode(zipped).alias("pos", "piece")).select(
        id_column, *keep, F.col("pos").cast("long").alias("pos"), *(F.col(f"piece.{name}").alias(name) for name in parts)
    )
    fields = _node_fields(F.col("pos"), *(F.col(name) for name in parts))
    return rows.filter(_is_node(F.col("code"))).select(
        F.col(id_column).alias("page_id"), *keep, *(value.alias(name) for name, value in fields.items())
    )


#: The node columns a rewrite of whole pages needs, in their order there.
PAGE_FIELDS = ("open_seq", "close_seq", "node_id", "kind", "tag", "attrs", "text")


def parse_pages(df: DataFrame, id_column: str = "page_id", html_column: str = "html", *keep: str) -> DataFrame:
    """(page_id, *keep, rows): the nodes of :func:`parse_html`, one row a page, its nodes in document order."""
    shaped, zipped = _shaped(df, id_column, html_column, keep, False)

    def node(piece: Column, at: Column) -> Column:
        fields = _node_fields(at.cast("long"), *(piece[name] for name in ("code", "source", "parent", "closed_at", "depth")))
        return F.when(_is_node(piece["code"]), F.struct(*(fields[name].alias(name) for name in PAGE_FIELDS)))

    rows = F.filter(F.transform(zipped, node), lambda r: r.isNotNull())
    return shaped.select(F.col(id_column).alias("page_id"), *keep, rows.alias("rows"))
