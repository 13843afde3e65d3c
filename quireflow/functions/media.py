"""Media types and file-name extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, strip_ws

# Extension by media type, and media type by extension.
EXTENSION_BY_MEDIA_TYPE = {
    "image/avif": ".avif",
    "image/bmp": ".bmp",
    "image/gif": ".gif",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/svg+xml": ".svg",
    "image/tiff": ".tiff",
    "image/webp": ".webp",
    "image/x-icon": ".ico",
    "image/vnd.microsoft.icon": ".ico",
}
MEDIA_TYPE_BY_EXTENSION = {
    ".avif": "image/avif",
    ".css": "text/css",
    ".gif": "image/gif",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".png": "image/png",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".xhtml": "application/xhtml+xml",
}
CONVERTED_FORMATS = ("webp", "heif", "tiff", "magick")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    literal = F.create_map(*(F.lit(item) for pair in table.items() for item in pair))
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_column(path), "/", -1)


def file_extension(path: Column | str) -> Column:
    """Extension with its dot, or an empty string; a leading dot alone starts a hidden name."""
    return F.regexp_extract(base_name(path), r"^[\s\S]*[^\n](\.[^.]*)\z", 1)


def file_stem(path: Column | str) -> Column:
    name = base_name(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(file_extension(name)))


def extension_for_media_type(media_type: Column | str) -> Column:
    plain = ascii_lower(strip_ws(F.substring_index(_column(media_type), ";", 1)))
    return _lookup(EXTENSION_BY_MEDIA_TYPE, plain, "")


def media_type_for_file(name: Column | str) -> Column:
    return _lookup(MEDIA_TYPE_BY_EXTENSION, ascii_lower(file_extension(name)), "application/octet-stream")


def accept_icon(content_type: Column | str, status: Column | str) -> Column:
    extension = extension_for_media_type(content_type)
    return _column(status).between(200, 299) & ~extension.isin("", ".ico")


def normalized_image_name(name: Column | str, image_format: Column | str) -> Column:
    """Output name after conversion: vector and rarely supported formats become PNG."""
    name, image_format = base_name(name), ascii_lower(_column(image_format))
    converts = ascii_lower(file_extension(name)) == ".svg"
    for prefix in CONVERTED_FORMATS:
        converts = converts | image_format.startswith(prefix)
    return F.when(converts, F.concat(file_stem(name), F.lit(".png"))).otherwise(name)
