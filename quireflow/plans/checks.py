"""Checks; each gives findings rows (site, code, severity, message, stage, url, file, hint).

Content checks read node tables that carry ``site`` and ``file``; archive
checks read entry tables (book, ordinal, name, method, size, data).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import starts_with_any
from ..functions.url import remove_dot_segments
from ..operators import tree as t
from ..operators.discovery import missing_pages
from ..schema import FINDING
from ..session import cut_lineage

# Link kinds that are not checked, name rules, nesting sets.
UNCHECKED_LINKS = ("http://", "https://", "mailto:", "tel:", "#")
RESERVED_NAME = r'["*:<>?\\|\x00-\x1f\x7f ]'
MAX_NAME_BYTES = 255
PHRASING_PARENTS = ("span", "p", "h1", "h2", "h3", "h4", "h5", "h6", "code", "em", "strong", "b", "i")
BLOCK_CHILDREN = ("div", "p", "ul", "ol", "table", "pre", "section", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6")
PACKAGE_FILES = ("mimetype", "EPUB/package.opf")
REQUIRED_PROPERTIES = ("schema:accessMode", "schema:accessibilityFeature", "schema:accessibilityHazard", "schema:accessibilitySummary")
MODIFIED_FORM = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"


def finding(code: str, message: Column | str, **given: Column) -> list[Column]:
    """Columns of a findings row after ``site``."""
    empty = F.lit(None).cast("string")
    return [
        F.lit(code).alias("code"),
        F.lit("error").alias("severity"),
        (message if isinstance(message, Column) else F.lit(message)).alias("message"),
        F.lit("validate").alias("stage"),
        *(given.get(name, empty).alias(name) for name in ("url", "file", "hint")),
    ]


def _in_file(rows: DataFrame, code: str, message: Column | str) -> DataFrame:
    return rows.select("site", *finding(code, message, file=F.col("file")))


def heading_jumps(nodes: DataFrame) -> DataFrame:
    """Headings more than one level below the one before, with ``previous`` and ``level``."""
    headings = nodes.filter(t.is_heading()).withColumn("level", t.heading_level())
    previous = F.lag("level").over(t.in_order())
    return headings.withColumn("previous", previous).filter(F.col("level") > F.col("previous") + 1)


def check_mimetype_order(entries: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Archives whose first entry is not ``mimetype``; with ``books(book)`` also those without entries."""
    first = entries.filter("ordinal = 0").select("book", "name")
    bad = first.filter("name <> 'mimetype'").select("book")
    if books is not None:
        bad = bad.unionByName(books.select("book").join(first, "book", "left_anti"))
    return bad.select(
        F.col("book").alias("site"), *finding("EPUB_MIMETYPE_ORDER", "mimetype is not the first ZIP entry.")
    )


def check_mimetype_stored(entries: DataFrame) -> DataFrame:
    packed = entries.filter("ordinal = 0 AND name = 'mimetype' AND method <> 'stored'")
    return packed.select(
        F.col("book").alias("site"),
        *finding("EPUB_MIMETYPE_COMPRESSED", "mimetype must be stored without compression."),
    )


def check_entry_paths(entries: DataFrame) -> DataFrame:
    """Entries that would land outside the archive's folder: some prefix has more ``..`` than names."""
    steps = F.transform(
        F.filter(F.split("name", "/"), lambda s: ~s.isin("", ".")), lambda s: F.when(s == "..", -1).otherwise(1)
    )
    lowest = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, step: F.struct(
            (acc["depth"] + step).alias("depth"), F.least(acc["lowest"], acc["depth"] + step).alias("lowest")
        ),
    )["lowest"]
    escaping = entries.filter(F.col("name").startswith("/") | (lowest < 0))
    message = F.concat(F.lit("EPUB entry escapes the extraction directory: "), "name")
    return escaping.select(F.col("book").alias("site"), *finding("EPUB_ENTRY_UNSAFE", message, file=F.col("name")))


def check_well_formed(documents: DataFrame) -> DataFrame:
    """``documents(site, file, error)`` with the parser's message where parsing failed."""
    return _in_file(documents.filter("error IS NOT NULL"), "XHTML_INVALID", F.col("error"))


def check_language(nodes: DataFrame) -> DataFrame:
    """Documents whose root is not html or has no language."""
    language = F.coalesce(F.nullif(t.attr("lang"), F.lit("")), F.nullif(t.attr("xml:lang"), F.lit("")))
    root = F.min_by(
        F.struct("tag", language.alias("language")), F.when(F.col("kind") == "element", F.col("open_seq"))
    )
    roots = nodes.groupBy("page_id", "site", "file").agg(root.alias("root"))
    bad = roots.filter(~F.coalesce(F.col("root.tag") == "html", F.lit(False)) | F.col("root.language").isNull())
    return _in_file(bad, "A11Y_LANGUAGE", "The XHTML document has no language.")


def check_image_alt(nodes: DataFrame) -> DataFrame:
    bad = nodes.filter((F.col("tag") == "img") & (F.coalesce(t.attr("alt"), F.lit("")) == ""))
    return _in_file(bad, "A11Y_IMAGE_ALT", "An image has no alt text.")


def check_table_header(nodes: DataFrame) -> DataFrame:
    marked = nodes.withColumn("_header", t.holds(F.col("tag") == "th"))
    return _in_file(
        marked.filter((F.col("tag") == "table") & ~F.col("_header")), "A11Y_TABLE_HEADER", "A table has no header cells."
    )


def check_heading_order(nodes: DataFrame) -> DataFrame:
    message = F.format_string("Heading level jumps from h%d to h%d.", "previous", "level")
    return _in_file(heading_jumps(nodes), "A11Y_HEADING_ORDER", message)


def file_links(nodes: DataFrame) -> DataFrame:
    """Links between files: (site, file, href, target) with the target path resolved against the file."""
    href = t.attr("href")
    links = nodes.filter((F.col("tag") == "a") & href.isNotNull()).select("site", "file", href.alias("href"))
    relative = links.filter(~starts_with_any("href", UNCHECKED_LINKS))
    folder = F.regexp_extract("file", r"^([\s\S]*/)[^/]*\z", 1)
    target = F.substring_index("href", "#", 1)
    return relative.withColumn(
        "target", remove_dot_segments(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)))
    )


def broken_links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Links to ``.xhtml`` files that ``files(site, file)`` does not have."""
    links = file_links(nodes).filter(F.col("target").endswith(".xhtml"))
    known = files.select("site", F.col("file").alias("target")).distinct()
    return links.join(known, ["site", "target"], "left_anti")


def check_links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Internal link target does not exist: "), "href")
    return _in_file(broken_links(nodes, files), "LINK_BROKEN_INTERNAL", message)


def check_page_coverage(expected: DataFrame, pages: DataFrame) -> DataFrame:
    absent = missing_pages(expected, pages)
    return absent.select(
        "site", *finding("COVERAGE_MISSING_PAGE", "A discovered page was not captured.", url=F.col("url"))
    )


def manifest_diff(listed: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, name, side): listed but absent, or present but unlisted, package files aside."""
    present = entries.filter(
        ~F.col("name").isin(*PACKAGE_FILES) & ~F.col("name").startswith("META-INF/") & ~F.col("name").endswith("/")
    ).select("book", "name", F.lit(True).alias("_present"))
    wanted = listed.select("book", "name", F.lit(True).alias("_listed"))
    joined = wanted.join(present, ["book", "name"], "full_outer")
    side = F.when(F.col("_present").isNull(), "absent").when(F.col("_listed").isNull(), "unlisted")
    return joined.withColumn("side", side).filter("side IS NOT NULL").select("book", "name", "side")


def nav_not_in_spine(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Contents targets ``(site, file)`` that are no spine document ``(site, file)``."""
    return toc.select("site", "file").join(spine.select("site", "file"), ["site", "file"], "left_anti")


def dangling_targets(links: DataFrame, ids: DataFrame) -> DataFrame:
    """``links(site, file, fragment)`` with no element of that id in ``ids(site, file, id)``."""
    return links.join(ids.select("site", "file", F.col("id").alias("fragment")), ["site", "file", "fragment"], "left_anti")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(page_id, id, n) of ids used more than once on a page."""
    ids = nodes.select("page_id", t.attr("id").alias("id")).filter("id IS NOT NULL")
    return ids.groupBy("page_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def check_package(nodes: DataFrame) -> DataFrame:
    """Surviving script, event handlers, script or data links, and one finding per repeated id."""
    href = F.lower(F.coalesce(t.attr("href"), F.lit("")))
    rules = {
        "PACKAGE_SCRIPT": F.col("tag") == "script",
        "PACKAGE_HANDLER": F.exists("attrs", lambda a: a["name"].startswith("on")),
        "PACKAGE_SCRIPT_LINK": href.startswith("javascript:"),
        "PACKAGE_DATA_LINK": (F.col("tag") == "a") & href.startswith("data:"),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())))
    rows = nodes.select("site", "file", F.explode(broken).alias("rule"))
    message = F.concat(F.lit("Content breaks rule "), "rule")
    ids = nodes.select("site", "file", "page_id", t.attr("id").alias("id")).filter("id IS NOT NULL")
    repeated = ids.groupBy("site", "file", "page_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.unionByName(repeated.select("site", "file", F.lit("PACKAGE_REPEATED_ID").alias("rule")))
    kept = rows.select("site", *finding("", message, file=F.col("file")), "rule")
    return kept.withColumn("code", F.col("rule")).drop("rule")


def package_values(packages: DataFrame) -> DataFrame:
    """``packages(site, document)`` of well-formed package documents to the values the metadata check reads."""

    def values(path: str) -> Column:
        return F.xpath("document", F.lit(path))

    return packages.select(
        "site",
        values("//*[local-name()='identifier']/text()").alias("identifiers"),
        values("//*[local-name()='metadata']/*[local-name()='title']/text()").alias("titles"),
        values("//*[local-name()='language']/text()").alias("languages"),
        values("//*[local-name()='meta'][@property='dcterms:modified']/text()").alias("modified"),
        values("//*[local-name()='meta']/@property").alias("properties"),
    )


def check_metadata(packages: DataFrame) -> DataFrame:
    """One identifier, title, language and UTC modified date, and the accessibility statement."""
    values = package_values(packages)
    rules = {
        "METADATA_IDENTIFIER": F.size("identifiers") == 1,
        "METADATA_TITLE": F.size("titles") == 1,
        "METADATA_LANGUAGE": F.size("languages") == 1,
        "METADATA_MODIFIED": (F.size("modified") == 1) & F.coalesce(F.get("modified", F.lit(0)).rlike(MODIFIED_FORM), F.lit(False)),
        "METADATA_ACCESSIBILITY": F.size(F.array_except(F.array(*map(F.lit, REQUIRED_PROPERTIES)), "properties")) == 0,
    }
    failed = F.array_compact(F.array(*(F.when(~rule, F.lit(code)) for code, rule in rules.items())))
    rows = values.select("site", F.explode(failed).alias("rule"))
    found = rows.select("site", *finding("", F.concat(F.lit("Package metadata breaks rule "), "rule")), "rule")
    return found.withColumn("code", F.col("rule")).drop("rule")


def check_file_names(entries: DataFrame) -> DataFrame:
    """Names no reading system can be trusted with: too long, reserved characters, trailing dot."""
    last = F.substring_index("name", "/", -1)
    bad = (F.octet_length(last) > MAX_NAME_BYTES) | last.rlike(RESERVED_NAME) | last.endswith(".")
    message = F.concat(F.lit("File name is not portable: "), "name")
    return entries.filter(bad).select(
        F.col("book").alias("site"), *finding("FILE_NAME_UNPORTABLE", message, file=F.col("name"))
    )


def check_nesting(nodes: DataFrame) -> DataFrame:
    """Block elements anywhere inside phrasing-only elements."""
    marked = nodes.withColumn("_phrasing", t.inside(F.col("tag").isin(*PHRASING_PARENTS)))
    bad = marked.filter(F.col("tag").isin(*BLOCK_CHILDREN) & F.col("_phrasing"))
    return _in_file(bad, "CONTENT_NESTING", F.concat(F.lit("Block element in phrasing content: "), "tag"))


def check_page_cap(over: DataFrame) -> DataFrame:
    """Sites over the page cap, whose capture stops: ``over(site, message)`` of the cap."""
    return over.select("site", *finding("COMMAND_FAILED", F.col("message"))).withColumn("stage", F.lit("scrape"))


def union_findings(*findings: DataFrame) -> DataFrame:
    """All findings with ``check_ord``, the order in which the checks are listed."""
    first, *rest = (part.withColumn("check_ord", F.lit(n)) for n, part in enumerate(findings))
    for part in rest:
        first = first.unionByName(part)
    return first


def finding_counts(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, errors, warnings, status) for every site, with or without findings."""
    counted = findings.groupBy("site").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    joined = sites.select("site").distinct().join(counted, "site", "left").fillna(0, ["errors", "warnings"])
    return joined.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("passed"))


def report_status(stages: DataFrame) -> DataFrame:
    """(site, status): passed when every stage passed."""
    passed = F.every(F.col("status") == "passed")
    return stages.groupBy("site").agg(F.when(passed, "passed").otherwise("failed").alias("status"))


def stage_counts(pages: DataFrame, chapters: DataFrame, assets: DataFrame) -> DataFrame:
    """(site, stage, count): captured pages, chapters, assets."""
    parts = (("pages", pages), ("chapters", chapters), ("assets", assets))
    counted = [df.groupBy("site").agg(F.count("*").alias("count")).withColumn("stage", F.lit(name)) for name, df in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def run_stage(spark: SparkSession, stage: str, site: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Run one stage; an exception becomes a failed stage's finding instead of ending the job.

    The stage's rows are stored here, so what fails only when the job runs is caught too.
    """
    try:
        return cut_lineage(work())
    except Exception as error:  # noqa: BLE001 - the point is to report any failure
        row = [(site, "COMMAND_FAILED", "error", str(error), stage, None, None, None)]
        return spark.createDataFrame(row, FINDING)


@dataclass
class StageRun:
    """What became of one stage: its stored rows, and what was counted while they were stored."""

    stage: str
    status: str
    rows: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)
    message: str | None = None


def run_stages(
    stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], counted: dict[str, tuple[str, Column]] | None = None
) -> list[StageRun]:
    """Run stages in order; each is given the stored rows of those before.

    Rows, and the sums in ``counted`` (label: column it needs, expression) of stages that have the column,
    are observed while a stage is stored, so no second job counts them. A stage that fails is recorded with its
    message, the stages after it as skipped, and the counts so far are kept.
    """
    done: list[StageRun] = []
    stored: dict[str, DataFrame] = {}
    for name, work in stages:
        if done and done[-1].status != "passed":
            done.append(StageRun(name, "skipped"))
            continue
        seen = Observation()
        try:
            made = work(stored)
            sums = {label: column for label, (needed, column) in (counted or {}).items() if needed in made.columns}
            observed = made.observe(seen, F.count("*").alias("rows"), *[F.sum(column).alias(label) for label, column in sums.items()])
            stored[name] = cut_lineage(observed)
            counts = {label: int(n or 0) for label, n in seen.get.items()}
        except Exception as error:  # noqa: BLE001 - the point is to report any failure
            done.append(StageRun(name, "failed", message=str(error)))
            continue
        done.append(StageRun(name, "passed", stored[name], counts))
    return done


def stage_report(spark: SparkSession, site: str, runs: list[StageRun]) -> DataFrame:
    """(site, n, stage, status, counted, count, message): one row for each count of each stage, or one without a count."""
    rows = []
    for n, run in enumerate(runs):
        for label, count in sorted(run.counts.items()) or [(None, None)]:
            rows.append((site, n, run.stage, run.status, label, count, run.message))
    return spark.createDataFrame(rows, "site string, n int, stage string, status string, counted string, count long, message string")


def content_findings(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """All checks of chapter content in listed order."""
    return union_findings(
        check_language(nodes),
        check_image_alt(nodes),
        check_table_header(nodes),
        check_heading_order(nodes),
        check_links(nodes, files),
    )
