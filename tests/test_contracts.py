"""Promises of readers, stages and reports."""

import json

import pytest
from pyspark.sql import functions as F

from quireflow.operators import discovery
from quireflow.plans import build, capture, checks, coverage
from quireflow.sources.markup import parse_html
from quireflow.sources.sinks import write_coverage
from quireflow.sources.tables import first_source_text, read_pages, read_sites, site_nav


def test_another_record_version_is_an_error_through_any_columns(spark, tmp_path):
    record = {"base_url": "http://a", "ir_version": 99, "sitemap_urls": [], "pages": [], "nav": [{"title": "t", "url": "u"}]}
    (tmp_path / "site.json").write_text(json.dumps(record))
    with pytest.raises(Exception, match="version 99"):
        site_nav(read_sites(spark, str(tmp_path))).collect()


def test_a_record_printed_over_several_lines(spark, tmp_path):
    record = {"url": "http://a/x", "route": "x", "title": "T", "language": "en", "html": "<p>", "content_hash": "h", "discovered_from": ["nav"]}
    (tmp_path / "page.json").write_text(json.dumps(record, indent=2))
    assert [r.url for r in read_pages(spark, str(tmp_path), multi_line=True).collect()] == ["http://a/x"]


def test_a_stage_that_fails_when_it_runs_is_a_finding(spark):
    long = "x" * 5000
    [row] = checks.run_stage(spark, "build", "a", lambda: spark.range(1).select(F.raise_error(F.lit(long)))).collect()
    assert row.code == "COMMAND_FAILED" and long in row.message


def test_coverage_findings_join_the_others(spark):
    lines = spark.createDataFrame([("a", "x"), ("a", "y")], "site string, line string")
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    ratio = coverage.coverage_ratio(lines, lines.limit(1), sites)
    assert {(r.site, r.coverage) for r in ratio.collect()} == {("a", 0.5), ("b", 1.0)}
    found = coverage.check_text_coverage(ratio)
    assert checks.union_findings(found, found).count() == 2


def test_images_below_assets_are_fetched_unless_made_here(spark):
    page = spark.createDataFrame([(1, '<article><img src="assets/a.png"><img src="data:x"></article>', "http://a/")], "page_id long, html string, url string")
    nodes = parse_html(page, "page_id", "html", "url")
    found = capture.fetchable_images(nodes)
    assert [r.src for r in found.collect()] == ["assets/a.png"]
    assert capture.fetchable_images(nodes, found).count() == 0


def test_whole_build(spark):
    rows = [
        (1, "s", "http://a/x?q=1", '<html lang="ja"><body><article><p>One</p><svg><g></g></svg></article></body></html>', "One"),
        (2, "s", "http://a/x#again", "<html><body><article><p>Two</p></article></body></html>", "Two"),
        (3, "s", "http://a/empty", "<html><body><article></article></body></html>", "Empty"),
        (4, "s", "http://a/none", "<html><body><p>No root</p></body></html>", "None"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, html string, title string")
    from quireflow.functions.url import canonical_url

    files = pages.select("site", canonical_url("url").alias("url"), F.lit("f").alias("file")).distinct()
    expected = {r.c: r.p for r in pages.groupBy(canonical_url("url").alias("c")).agg(F.min("page_id").alias("p")).collect()}
    got = {r.page_id: r.html for r in build.build_chapters(pages, files).collect()}
    assert set(got) == set(expected.values()) - {4}
    assert 'lang="ja"' in got[1] and "<img" in got[1] and "<svg" not in got[1]


def test_xhtml_scripts_are_elements_and_character_data_is_text(spark):
    html = '<html><head><script src="a.js"/><title>T</title></head><body><p>x<![CDATA[a > b & <i>]]></p><![CDATA[]]><br></br><link>l</link></body></html>'
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    nodes = parse_html(page, xml=True).orderBy("open_seq").collect()
    assert [(n.tag, n.depth) for n in nodes if n.kind == "element"] == [
        ("html", 1), ("head", 2), ("script", 3), ("title", 3), ("body", 2), ("p", 3), ("br", 3), ("link", 3)
    ]
    assert [n.text for n in nodes if n.kind == "text"] == ["T", "x", "a > b & <i>", "l"]


def test_package_check_names_repeated_ids_once_each(spark):
    page = spark.createDataFrame([(1, "s", "f", '<p id="a"></p><p id="a"></p><p id="a"></p><p id="b"></p><script>x</script>')], "page_id long, site string, file string, html string")
    found = checks.check_package(parse_html(page, "page_id", "html", "site", "file"))
    assert sorted(r.code for r in found.collect()) == ["PACKAGE_REPEATED_ID", "PACKAGE_SCRIPT"]


def test_the_page_cap_stops_a_site_and_is_a_finding(spark):
    rows = [(n, site, f"http://{site}/{n}?q={k}", f"T{n}") for site, pages in (("a", 3), ("b", 2)) for n in range(pages) for k in (1, 2)]
    pages = spark.createDataFrame([(n, *row[1:]) for n, row in enumerate(rows)], "page_id long, site string, url string, title string")
    pages = pages.withColumn("html", F.lit("<html><body><article><p>x</p></article></body></html>"))
    from quireflow.functions.url import canonical_url

    over = discovery.enforce_page_cap(pages.select("site", canonical_url("url").alias("url")), 2)
    [row] = checks.union_findings(checks.check_page_cap(over)).collect()
    assert (row.site, row.stage, row.code) == ("a", "scrape", "COMMAND_FAILED") and "Discovered 3 pages" in row.message
    files = pages.select("site", canonical_url("url").alias("url"), F.lit("f").alias("file")).distinct()
    built = build.build_chapters(pages, files, max_pages=2)
    assert [r.site for r in built.select("site").collect()] == ["b", "b"]


def test_the_first_usable_source_text_wins(spark):
    rows = [("a", 0, 404, "none"), ("a", 1, 200, " \n"), ("a", 2, 200, "full"), ("a", 3, 200, "later"), ("b", 0, 200, "own"), ("c", 0, 500, "x")]
    found = first_source_text(spark.createDataFrame(rows, "site string, rank int, status int, body string"))
    assert {(r.site, r.text) for r in found.collect()} == {("a", "full"), ("b", "own")}


def test_the_coverage_report_lists_missing_lines(spark, tmp_path):
    lines = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "site string, line string")
    missing = lines.filter("line = 'y'")
    path = str(tmp_path / "coverage")
    write_coverage(coverage.coverage_ratio(lines, missing), missing, path)
    stored = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(stored) == 3 and stored.count({"site": "a", "line": "y"}) == 2
    [figures] = [r for r in stored if "checked" in r]
    assert (figures["checked"], figures["missing"]) == (3, 2) and abs(figures["coverage"] - 1 / 3) < 1e-9
