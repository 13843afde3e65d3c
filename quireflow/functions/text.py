"""Text columns. Character classes are ASCII, as in the data model."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trimmed white space, folded punctuation, dropped characters,
# Markdown patterns, and the markers of charset and title rules.
WHITESPACE = " \t\n\u000b\u000c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDED_CHARACTERS = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u202f"
FOLDED_TO = "''\"\"--  "
ELLIPSIS = "\u2026"
DROPPED_CHARACTERS = "*_`\\"
UNEVEN_SPACE = "[\\t\\n\\x0b\\x0c\\r]|  "
SPACE_RUN = "[ \\t\\n\\x0b\\x0c\\r]+"
BULLET_PATTERN = "^(?:>[ \\t\\n\\x0b\\x0c\\r]*)*(?:[*+\\-]|[0-9]+[.)])[ \\t\\n\\x0b\\x0c\\r]+|^(?:>[ \\t\\n\\x0b\\x0c\\r]*)+"
LINK_PATTERN = r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])"
TAG_PATTERN = r"</?[A-Za-z][^<>]*>"
TITLE_SEPARATOR = "[ \\t\\n\\x0b\\x0c\\r]([|\u2013\u2014\\-])[ \\t\\n\\x0b\\x0c\\r]"
CHARSET_META = r"(?i)<meta[^>]*charset"
CHARSET_WINDOW = 1024
MESSAGE_LIMIT = 4000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_chars(value: Column | str, characters: str) -> Column:
    return F.trim(_column(value), F.lit(characters))


def strip_ws(value: Column | str) -> Column:
    """Trim the six ASCII white-space characters only."""
    return strip_chars(value, WHITESPACE)


def ascii_lower(value: Column | str) -> Column:
    return F.translate(_column(value), ASCII_UPPER, ASCII_UPPER.lower())


def starts_with_any(value: Column | str, prefixes: tuple[str, ...]) -> Column:
    value = _column(value)
    matched = F.lit(False)
    for prefix in prefixes:
        matched = matched | value.startswith(prefix)
    return matched


def escape_html(value: Column | str) -> Column:
    escaped = _column(value)
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(reference))
    return escaped


# Character references.
ONLY_COMMON_REFERENCES = r"^[^&]*+(?:&(?:amp|lt|gt|quot);[^&]*+)*+\z"
ENTITY_OR_TEXT = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"


def _character(code: Column) -> Column:
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(legal, wide).when(code.isNotNull(), F.lit(""))


def unescape_html(value: Column | str) -> Column:
    """Replace character references; the names are those of HTML 4 plus ``apos``.

    Text without an ampersand, or with the four commonest references only,
    never reaches the token fold.
    """
    value = _column(value)
    names = dict(html.entities.name2codepoint, apos=0x27)
    named = F.expr("map(" + ", ".join(f"'{name}', {code}L" for name, code in names.items()) + ")")

    def decode(token: Column) -> Column:
        digits = F.regexp_extract(token, r"^&#0*([0-9]+)", 1)
        hexadecimal = F.regexp_extract(token, r"^&#[xX]0*([0-9A-Fa-f]+)", 1)
        return (
            F.when(~token.startswith("&"), token)
            .when(F.length(F.greatest(digits, hexadecimal)) > 7, F.lit(""))
            .when(digits != "", _character(digits.cast("long")))
            .when(hexadecimal != "", _character(F.conv(hexadecimal, 16, 10).cast("long")))
            .otherwise(
                F.coalesce(
                    _character(F.try_element_at(named, F.regexp_extract(token, "^&([A-Za-z0-9]+);", 1))),
                    token,
                )
            )
        )

    parts = F.regexp_extract_all(value, F.lit(ENTITY_OR_TEXT), F.lit(0))
    common = value
    for reference, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        common = F.replace(common, F.lit(reference), F.lit(plain))
    return (
        F.when(~value.contains("&"), value)
        .when(value.rlike(ONLY_COMMON_REFERENCES), common)
        .otherwise(F.array_join(F.transform(parts, decode), ""))
    )


def base64_encode(value: Column | str) -> Column:
    return F.regexp_replace(F.base64(_column(value)), r"\r?\n", "")


def base64_decode(value: Column | str) -> Column:
    """Binary value; characters outside the alphabet and missing padding are tolerated."""
    clean = F.regexp_replace(_column(value), "[^A-Za-z0-9+/]+", "")
    tail = F.length(clean) % 4
    whole = F.when(tail == 1, F.substr(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)
    padding = F.when(tail == 2, "==").when(tail == 3, "=").otherwise("")
    return F.unbase64(F.concat(whole, padding))


def valid_utf8(body: Column | str) -> Column:
    return F.is_valid_utf8(_column(body))


def declares_charset(html_bytes: Column | str) -> Column:
    """A meta tag naming a charset within the first 1024 bytes, read bytewise."""
    head = F.decode(F.substring(_column(html_bytes).cast("binary"), 1, CHARSET_WINDOW), "ISO-8859-1")
    return head.rlike(CHARSET_META)


def decide_charset(status: Column | str, content_type: Column | str, body: Column | str) -> Column:
    """``utf-8`` where it may be asserted, else null: header, meta or legacy rules decide.

    Asserted only for a 2xx page other than 204 that is served as HTML without a
    charset, declares none itself, and is valid UTF-8.
    """
    status, body = _column(status), _column(body)
    kind = ascii_lower(F.coalesce(_column(content_type), F.lit("")))
    asserted = (
        status.between(200, 299)
        & (status != 204)
        & kind.startswith("text/html")
        & ~kind.contains("charset=")
        & ~declares_charset(body)
        & valid_utf8(body)
    )
    return F.when(asserted, F.lit("utf-8"))


def normalize_words(value: Column | str) -> Column:
    """Fold typographic characters, drop Markdown marks, collapse white space, lower A to Z.

    One ``translate`` does the single-character folds and drops together, and
    evenly spaced text skips the replacement.
    """
    dots = F.replace(_column(value), F.lit(ELLIPSIS), F.lit("..."))
    folded = F.translate(dots, FOLDED_CHARACTERS + DROPPED_CHARACTERS, FOLDED_TO)
    single = F.when(folded.rlike(UNEVEN_SPACE), F.regexp_replace(folded, SPACE_RUN, " ")).otherwise(folded)
    return ascii_lower(F.trim(single))


def strip_bullet(line: Column | str) -> Column:
    return F.regexp_replace(_column(line), BULLET_PATTERN, "")


def strip_markdown(line: Column | str) -> Column:
    """Remove tags outside code spans; replace links and images by their label everywhere."""
    line = _column(line)
    spans = F.split(line, "`")
    cleaned = F.transform(
        spans, lambda part, i: F.when(i % 2 == 1, part).otherwise(F.regexp_replace(part, TAG_PATTERN, ""))
    )
    untagged = F.when(line.contains("<"), F.array_join(cleaned, "`")).otherwise(line)
    return F.when(line.contains("["), F.regexp_replace(untagged, LINK_PATTERN, "$1")).otherwise(untagged)


def site_name(og_site_name: Column | str, application_name: Column | str, title: Column | str) -> Column:
    """The name a site gives itself, else what follows its title's last separator, else the title."""
    title = strip_ws(title)
    separator = F.regexp_extract(title, TITLE_SEPARATOR, 0)
    after = strip_ws(F.call_function("substring_index", title, separator, F.lit(-1)))
    by_title = F.when(separator == "", title).otherwise(after)

    def given(value: Column | str) -> Column:
        return F.nullif(strip_ws(value), F.lit(""))

    return F.coalesce(given(og_site_name), given(application_name), by_title)


def truncate_tail(value: Column | str, limit: int = MESSAGE_LIMIT) -> Column:
    """The last ``limit`` characters of a message."""
    value = _column(value)
    return F.when(F.length(value) > limit, F.right(value, F.lit(limit))).otherwise(value)


def format_message(template: str, *arguments: Column) -> Column:
    return F.format_string(template, *arguments)


def utc_timestamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture_date(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd")


def json_text(document: Column | str, field: str) -> Column:
    """A string field of a JSON document; missing and non-string values read as empty."""
    found = F.try_variant_get(F.try_parse_json(_column(document)), f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_column(document)), f"$.{field}", "variant"))
    return F.coalesce(F.when(kind == "STRING", found), F.lit(""))
