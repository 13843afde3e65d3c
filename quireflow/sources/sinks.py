"""Writers. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REPORT_FORMAT_VERSION, SITE_FACTS, SITE_LINE, SITE_LISTS


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_pages(pages: DataFrame, path: str, file_format: str = "json") -> None:
    """Page records; by site folders when the table has a site column."""
    writer = pages.write.mode("overwrite").format(file_format)
    (writer.partitionBy("site") if "site" in pages.columns else writer).save(path)


def write_sites(sites: DataFrame, path: str, file_format: str = "json") -> None:
    sites.write.mode("overwrite").format(file_format).save(path)


def write_site_parts(facts: DataFrame, lists: dict[str, DataFrame], path: str) -> None:
    """Site records in parts: ``facts`` without lists, and each list as rows ``(site, pos[, title], url)``.

    Lists are written by ranges of (site, pos), so a long list is many rows in several files
    and never one value, and a reader of one site opens the files that have it.
    """
    facts.select(*SITE_FACTS.names).write.mode("overwrite").parquet(f"{path}/facts")
    for name in SITE_LISTS:
        rows = lists[name]
        if "title" not in rows.columns:
            rows = rows.withColumn("title", F.lit(None).cast("string"))
        ranged = rows.select(*SITE_LINE.names).repartitionByRange("site", "pos").sortWithinPartitions("site", "pos")
        ranged.write.mode("overwrite").parquet(f"{path}/{name}")


def report_documents(stages: DataFrame, command: str = "run") -> DataFrame:
    """(site, document): one JSON report per site from ``stages(site, stage, status, errors, warnings)``."""
    stage = F.struct("stage", "status", F.struct("errors", "warnings").alias("counts"))
    grouped = stages.groupBy("site").agg(
        F.array_sort(F.collect_list(stage)).alias("stages"), F.every(F.col("status") == "passed").alias("_passed")
    )
    document = F.struct(
        F.lit(command).alias("command"),
        F.when(F.col("_passed"), "passed").otherwise("failed").alias("status"),
        F.col("site").alias("workspace"),
        "stages",
        F.lit(REPORT_FORMAT_VERSION).alias("format_version"),
    )
    return grouped.select("site", F.to_json(document).alias("document"))


def write_report(stages: DataFrame, path: str, command: str = "run") -> None:
    report_documents(stages, command).select("document").write.mode("overwrite").text(path)


def coverage_documents(coverage: DataFrame, missing: DataFrame) -> DataFrame:
    """(document): the figures of each site, and a row of its own for each line that was not found."""
    figures = coverage.select(F.to_json(F.struct("site", "checked", "missing", "coverage")).alias("document"))
    return figures.unionByName(missing.select(F.to_json(F.struct("site", "line")).alias("document")))


def write_coverage(coverage: DataFrame, missing: DataFrame, path: str) -> None:
    coverage_documents(coverage, missing).write.mode("overwrite").text(path)


def inspect(spark: SparkSession, subject: str, path: str) -> DataFrame:
    """The stored ``site``, ``pages`` or ``report`` rows as JSON text."""
    from .tables import read_pages, read_sites

    if subject == "site":
        stored = read_sites(spark, f"{path}/site")
    elif subject == "pages":
        stored = read_pages(spark, f"{path}/pages").drop("page_key")
    elif subject == "report":
        return spark.read.text(f"{path}/report").withColumnRenamed("value", "document")
    else:
        raise ValueError(f"Unknown subject {subject!r}; use site, pages or report.")
    return stored.select(F.to_json(F.struct("*")).alias("document"))
