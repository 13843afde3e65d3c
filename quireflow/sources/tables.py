"""Readers of stored captures: page and site records, sitemaps, source text, responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import page_key
from ..functions.text import strip_ws
from ..schema import IR_VERSION, PAGE, RESPONSE, SITE, SITE_FACTS, SITE_LINE, SITE_LISTS
from .markup import xml_error


def _required(df: DataFrame, *names: str) -> DataFrame:
    """Fail on rows that lack a required list or key, as a strict reader would."""
    for name in names:
        message = F.lit(f"A stored record has no {name}.")
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name)))
    return df


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _version_message(version: Column) -> Column:
    told = F.coalesce(version.cast("string"), F.lit("none"))
    return F.concat(F.lit("Unsupported record version "), told, F.lit(f"; expected {IR_VERSION}."))


def read_pages(spark: SparkSession, path: str, file_format: str = "json", multi_line: bool = False) -> DataFrame:
    """Page records with ``page_key``, the order in which stored pages are listed.

    ``multi_line`` is for JSON files of one record each, printed over several lines.
    """
    pages = spark.read.schema(PAGE).format(file_format).option("multiLine", multi_line).load(path)
    checked = _required(pages, "url", "discovered_from")
    return checked.withColumns(
        {"assets": _or_empty("assets"), "warnings": _or_empty("warnings"), "page_key": page_key("url")}
    )


def read_sites(spark: SparkSession, path: str, file_format: str = "json", multi_line: bool = False) -> DataFrame:
    """Site records; a record of another format version is an error that names both versions.

    The version is tested in a filter, which no choice of columns prunes.
    """
    stored = spark.read.schema(SITE).format(file_format).option("multiLine", multi_line).load(path)
    sites = _required(stored, "sitemap_urls", "nav", "pages")
    return _of_this_version(sites)


def _of_this_version(sites: DataFrame) -> DataFrame:
    message = _version_message(F.col("ir_version"))
    return sites.filter(F.col("ir_version").eqNullSafe(F.lit(IR_VERSION)) | F.raise_error(message).cast("boolean"))


def read_site_parts(spark: SparkSession, path: str, sites: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What ``write_site_parts`` stored: facts of this format version, and the lists by name; of the named sites only, if given."""

    def stored(name: str, schema: T.StructType, key: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/{name}")
        return rows if sites is None else rows.filter(F.col(key).isin(sites))

    return _of_this_version(stored("facts", SITE_FACTS, "base_url")), {name: stored(name, SITE_LINE, "site") for name in SITE_LISTS}


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...], name: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Sound JSON records, and a finding for each other one; one bad record leaves the rest.

    A record is damaged if it cannot be parsed by the schema, and incomplete without one of
    the required fields or in another format version. ``name`` is the field that names it in findings.
    """
    lines = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_name").alias("_file"))
    damaged = T.StructField("_damaged", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": damaged.name}
    # as a row of its own, so that no filter has the parse written into it again
    record = F.from_json("value", T.StructType([*schema, damaged]), options)
    parsed = lines.filter(strip_ws("value") != "").select("_file", F.explode(F.array(record)).alias("r"))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"r.{field}").isNull(), F.lit(field)) for field in required]))
    code = F.when(F.col("r").isNull() | F.col("r._damaged").isNotNull(), "RECORD_DAMAGED").when(F.size(lacks) > 0, "RECORD_INCOMPLETE")
    message = F.when(F.size(lacks) > 0, F.concat(F.lit("A stored record has no "), F.array_join(lacks, ", "), F.lit(".")))
    if "ir_version" in schema.names:
        other = ~F.col("r.ir_version").eqNullSafe(F.lit(IR_VERSION))
        code, message = code.when(other, "RECORD_VERSION"), message.when(other, _version_message(F.col("r.ir_version")))
    judged = parsed.withColumn("code", code).withColumn("message", message)
    sound = judged.filter("code IS NULL").select(*[F.col(f"r.{field}").alias(field) for field in schema.names])
    unread = F.col("code") == "RECORD_DAMAGED"
    findings = judged.filter("code IS NOT NULL").select(
        F.when(unread, "").otherwise(F.coalesce(f"r.{name}", F.lit(""))).alias("site"),
        "code",
        F.lit("error").alias("severity"),
        F.when(unread, "A stored record cannot be read.").otherwise(F.col("message")).alias("message"),
        F.lit("scrape").alias("stage"),
        F.lit(None).cast("string").alias("url"),
        F.col("_file").alias("file"),
        F.lit(None).cast("string").alias("hint"),
    )
    return sound, findings


def read_pages_checked(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """``read_pages`` of the sound records, and findings for the others."""
    sound, findings = read_records(spark, path, PAGE, ("url", "discovered_from"), "url", multi_line)
    listed = sound.withColumns({"assets": _or_empty("assets"), "warnings": _or_empty("warnings"), "page_key": page_key("url")})
    return listed, findings


def read_sites_checked(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """``read_sites`` of the sound records of this format version, and findings for the others."""
    return read_records(spark, path, SITE, ("base_url", "sitemap_urls", "nav", "pages"), "base_url", multi_line)


def site_nav(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("base_url").alias("site"), F.posexplode("nav").alias("pos", "entry")).select(
        "site", F.col("pos").cast("long").alias("pos"), "entry.title", "entry.url"
    )


def site_sitemap(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("base_url").alias("site"), F.posexplode("sitemap_urls").alias("pos", "url")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def sitemap_locations(documents: DataFrame, key: str = "site", body: str = "body") -> DataFrame:
    """(key, ord, loc): every ``loc`` element by local name; broken documents give no rows."""
    sound = documents.withColumn("_error", xml_error(F.encode(body, "UTF-8"))).filter("_error IS NULL")
    located = sound.select(
        key, F.posexplode(F.xpath(body, F.lit("//*[local-name()='loc']/text()"))).alias("ord", "loc")
    )
    return located.select(key, F.col("ord").cast("long").alias("ord"), strip_ws("loc").alias("loc"))


def sitemap_files(spark: SparkSession, path: str, tags: tuple[str, ...] = ("loc",)) -> DataFrame:
    """(file, tag, n, loc): locations of sitemaps that are too large to be one value.

    Spark's XML source streams a file element by element, so a task holds one location
    and never a document. Tags are compared with their prefix; ``n`` rises within a file and tag.
    """
    parts = [
        spark.read.format("xml").option("rowTag", tag).schema("_VALUE string").load(path).select(
            F.col("_metadata.file_name").alias("file"), F.lit(tag).alias("tag"), F.monotonically_increasing_id().alias("n"), strip_ws("_VALUE").alias("loc")
        )
        for tag in tags
    ]
    return reduce(DataFrame.unionByName, parts).filter("loc <> ''")


def first_source_text(candidates: DataFrame) -> DataFrame:
    """(site, text): of ``candidates(site, rank, status, body)`` the first that answered and is not blank."""
    usable = candidates.filter(F.col("status").between(200, 299) & (strip_ws("body") != ""))
    return usable.groupBy("site").agg(F.min_by("body", "rank").alias("text"))


def read_responses(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(RESPONSE).format(file_format).load(path)


def list_files(entries: DataFrame, extension: str, folder: str = "", recursive: bool = True) -> DataFrame:
    """Entries with an extension below a folder, or directly in it, in path order."""
    rest = F.substr(F.col("name"), F.lit(len(folder) + 1))
    kept = entries.filter(F.col("name").startswith(folder) & F.col("name").endswith(extension))
    return path_order(kept if recursive else kept.filter(~rest.contains("/")), "book", "name")


def path_order(df: DataFrame, *paths: str) -> DataFrame:
    """Bytewise path order over the whole table."""
    return df.orderBy(*paths)
