"""Column functions: URLs, identifiers, text, media types and colours."""

from . import color, ids, media, text, url  # noqa: F401
