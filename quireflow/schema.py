"""Fixed, versioned table schemas. Nothing is inferred."""

from pyspark.sql import types as T

IR_VERSION = 1
REPORT_FORMAT_VERSION = 1
DEFAULT_MAX_PAGES = 500


def _text(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


def _texts(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StringType()), nullable)


PAGE = T.StructType(
    [
        _text("url"),
        _text("route"),
        _text("title"),
        _text("language"),
        _text("html"),
        _text("content_hash"),
        _texts("discovered_from"),
        _texts("assets", True),
        _texts("warnings", True),
    ]
)

SITE_METADATA = T.StructType(
    [
        _text("name", True),
        _text("description", True),
        _text("author", True),
        _text("captured_on", True),
        _texts("theme_colors", True),
        _text("logo", True),
        _text("icon", True),
    ]
)

NAV_ENTRY = T.StructType([_text("title", True), _text("url", True)])

SITE = T.StructType(
    [
        _text("base_url"),
        _text("title"),
        _text("language"),
        _text("adapter"),
        T.StructField("ir_version", T.IntegerType(), False),
        _texts("sitemap_urls"),
        T.StructField("nav", T.ArrayType(NAV_ENTRY), False),
        _texts("pages"),
        T.StructField("metadata", SITE_METADATA, True),
    ]
)

#: A site record in parts: one row of facts, and its lists as rows with positions.
SITE_LISTS = ("sitemap_urls", "nav", "pages")
SITE_FACTS = T.StructType([field for field in SITE if field.name not in SITE_LISTS])
SITE_LINE = T.StructType([_text("site"), T.StructField("pos", T.LongType(), False), _text("title", True), _text("url")])

RESPONSE = T.StructType(
    [
        _text("url"),
        T.StructField("status", T.IntegerType(), True),
        _text("content_type", True),
        T.StructField("body", T.BinaryType(), True),
        _text("error", True),
    ]
)

FINDING = T.StructType(
    [
        _text("site"),
        _text("code"),
        _text("severity"),
        _text("message"),
        _text("stage"),
        _text("url", True),
        _text("file", True),
        _text("hint", True),
    ]
)

ENTRY = T.StructType(
    [
        _text("book"),
        T.StructField("ordinal", T.IntegerType(), False),
        _text("name"),
        _text("method"),
        T.StructField("size", T.LongType(), False),
        T.StructField("data", T.BinaryType(), True),
    ]
)
