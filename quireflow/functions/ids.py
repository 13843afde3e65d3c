"""Hashes, identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import extension_for_media_type, file_extension
from .text import strip_chars, strip_ws
from .url import _column, url_parts

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def sha256_hex(value: Column | str) -> Column:
    return F.sha2(_column(value), 256)


def content_hash(html: Column | str) -> Column:
    return sha256_hex(html)


def page_key(url: Column | str) -> Column:
    return F.substring(sha256_hex(url), 1, 16)


def uuid5_url(name: Column | str) -> Column:
    """Name-based UUID, version 5, in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(_column(name), "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        F.element_at(F.array(*(F.lit(c) for c in "89ab")), variant + 1),
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def _dashed(value: Column) -> Column:
    return strip_chars(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "-"), "-")


def route_name(route: Column | str) -> Column:
    named = _dashed(strip_chars(_column(route), "/"))
    return F.when(named.isin("", ".", ".."), F.lit("index")).otherwise(named)


def xml_id(value: Column | str) -> Column:
    named = _dashed(strip_ws(_column(value)))
    return (
        F.when(named == "", F.lit("id"))
        .when(named.rlike("^[A-Za-z_]"), named)
        .otherwise(F.concat(F.lit("id-"), named))
    )


def chapter_name(route: Column | str, url: Column | str) -> Column:
    return F.concat(route_name(route), F.lit("-"), F.substring(sha256_hex(url), 1, 8), F.lit(".xhtml"))


def workspace_name(url: Column | str) -> Column:
    """Folder-safe name of a site; the site key of every multi-site table."""
    parts = url_parts(url)
    name = F.translate(strip_chars(parts["path"], "/"), "/", "-")
    return F.concat(parts["netloc"], F.lit("-"), F.when(name == "", F.lit("root")).otherwise(name))


def asset_name(url: Column | str, media_type: Column | str) -> Column:
    by_type = extension_for_media_type(media_type)
    by_path = file_extension(url_parts(url)["path"])
    extension = F.when(by_type != "", by_type).when(by_path != "", by_path).otherwise(F.lit(".bin"))
    return F.concat(F.substring(sha256_hex(url), 1, 20), extension)
