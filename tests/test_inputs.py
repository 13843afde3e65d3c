"""Damaged records, unanswered requests, large sitemaps and failing stages."""

import json

from pyspark.sql import functions as F

from quireflow.plans import capture, checks
from quireflow.sources import tables

PAGE = {"url": "http://e.org/a", "route": "/a", "title": "A", "language": "en", "html": "<p>", "content_hash": "x", "discovered_from": ["sitemap"]}
SITE = {"base_url": "http://e.org/", "title": "T", "language": "en", "adapter": "g", "ir_version": 1, "sitemap_urls": [], "nav": [], "pages": ["http://e.org/a"]}


def test_one_bad_record_among_many(spark, tmp_path):
    good = [PAGE | {"url": f"http://e.org/{n}"} for n in range(200)]
    lines = [json.dumps(r) for r in good]
    lines.insert(100, lines[7][:40])
    lines += ["", json.dumps(PAGE | {"discovered_from": None, "url": "http://e.org/x"}), json.dumps({"title": 3}), "[1, 2]", json.dumps(PAGE | {"assets": "text"})]
    (tmp_path / "p.json").write_text("\n".join(lines))
    sound, findings = tables.read_pages_checked(spark, str(tmp_path))
    assert sorted(r.url for r in sound.select("url").collect()) == sorted(r["url"] for r in good)
    assert {r.assets == [] for r in sound.select("assets").collect()} == {True}
    got = sorted((r.code, r.site, r.message, r.file, r.stage) for r in findings.collect())
    read = "A stored record cannot be read."
    assert [g[:3] for g in got] == [
        ("RECORD_DAMAGED", "", read), ("RECORD_DAMAGED", "", read), ("RECORD_DAMAGED", "", read),
        ("RECORD_INCOMPLETE", "", "A stored record has no url, discovered_from."),
        ("RECORD_INCOMPLETE", "http://e.org/x", "A stored record has no discovered_from."),
    ]
    assert {g[3:] for g in got} == {("p.json", "scrape")}


def test_sites_of_other_versions_and_files_over_lines(spark, tmp_path):
    for n, record in enumerate([SITE, SITE | {"ir_version": 2}, SITE | {"nav": None}]):
        (tmp_path / f"{n}.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "3.json").write_text(json.dumps(SITE, indent=2)[:50])
    sound, findings = tables.read_sites_checked(spark, str(tmp_path), multi_line=True)
    assert [r.base_url for r in sound.collect()] == ["http://e.org/"]
    assert {(r.file, r.code, r.message) for r in findings.collect()} == {
        ("1.json", "RECORD_VERSION", "Unsupported record version 2; expected 1."),
        ("2.json", "RECORD_INCOMPLETE", "A stored record has no nav."),
        ("3.json", "RECORD_DAMAGED", "A stored record cannot be read."),
    }


def test_transport_failures_are_apart_from_statuses(spark):
    rows = [("s", "u1", 200, None), ("s", "u2", 404, None), ("s", "u3", None, "timeout"), ("s", "u4", None, None), ("s", "u5", 200, "reset while reading")]
    responses = spark.createDataFrame(rows, "site string, url string, status int, error string")
    assert [r.url for r in capture.ok_responses(responses).collect()] == ["u1"]
    got = {r.url: (r.code, r.severity, r.message) for r in capture.response_findings(responses).collect()}
    assert got == {
        "u2": ("RESPONSE_STATUS", "warning", "Could not fetch u2: HTTP 404"),
        "u3": ("RESPONSE_FAILED", "error", "Could not fetch u3: timeout"),
        "u4": ("RESPONSE_FAILED", "error", "Could not fetch u4: no response"),
        "u5": ("RESPONSE_FAILED", "error", "Could not fetch u5: reset while reading"),
    }
    assert [r.url for r in capture.ok_responses(responses.drop("error")).collect()] == ["u1", "u5"]


def test_a_sitemap_file_gives_the_locations_of_its_value(spark, tmp_path):
    body = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i">' + "".join(
        f"<url><loc>\n http://e.org/{n}?a=1&amp;b={n} </loc><i:image><i:loc>http://i.org/{n}</i:loc></i:image></url>" for n in range(3000)
    ) + "<!-- <loc>no</loc> --><url><loc> </loc></url></urlset>"
    (tmp_path / "map.xml").write_text(body)
    files = tables.sitemap_files(spark, str(tmp_path), ("loc", "i:loc"))
    value = tables.sitemap_locations(spark.createDataFrame([("s", body)], "site string, body string"))
    assert sorted(r.loc for r in files.collect()) == sorted(r.loc for r in value.collect() if r.loc)
    ordered = [r.loc for r in files.filter("tag = 'loc'").orderBy("n").collect()]
    assert ordered == [f"http://e.org/{n}?a=1&b={n}" for n in range(3000)]


def test_a_failing_stage_keeps_the_counts_so_far(spark):
    stages = [
        ("one", lambda done: spark.range(10).withColumn("w", F.lit(2))),
        ("two", lambda done: done["one"].filter("id < 4").select("id")),
        ("three", lambda done: done["two"].select(F.raise_error(F.lit("late")).alias("x"))),
        ("four", lambda done: done["three"]),
    ]
    runs = checks.run_stages(stages, {"weight": ("w", F.col("w"))})
    assert [(r.stage, r.status, r.counts) for r in runs] == [
        ("one", "passed", {"rows": 10, "weight": 20}), ("two", "passed", {"rows": 4}), ("three", "failed", {}), ("four", "skipped", {}),
    ]
    assert "late" in runs[2].message and runs[1].rows.count() == 4
    empty = checks.run_stages([("none", lambda done: spark.range(0))])
    assert (empty[0].status, empty[0].counts) == ("passed", {"rows": 0})
    report = checks.stage_report(spark, "s", runs).collect()
    assert [(r.n, r.counted, r["count"]) for r in report] == [(0, "rows", 10), (0, "weight", 20), (1, "rows", 4), (2, None, None), (3, None, None)]


def test_counts_need_no_second_job(spark):
    group = "counts-of-a-stage"
    spark.sparkContext.setJobGroup(group, group)
    try:
        checks.run_stages([("one", lambda done: spark.range(100))])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # the rows, and their checkpoint


def test_site_lists_are_rows(spark, tmp_path):
    from quireflow.sources import sinks

    facts = spark.createDataFrame([(f"http://{s}.org/", "T", "en", "g", 1) for s in "abc"], "base_url string, title string, language string, adapter string, ir_version int")
    facts = facts.withColumn("metadata", F.struct(F.lit("N").alias("name")))
    nav = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "http://b.org/").otherwise("http://a.org/").alias("site"), F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("title"), F.lit("u").alias("url"))
    lists = {"nav": nav, "sitemap_urls": nav.drop("title"), "pages": nav.filter("false")}
    whole_facts = facts.select("*").withColumn("metadata", F.from_json(F.to_json("metadata"), tables.SITE_FACTS["metadata"].dataType))
    sinks.write_site_parts(whole_facts, lists, str(tmp_path))
    stored, read = tables.read_site_parts(spark, str(tmp_path))
    assert sorted(r.base_url for r in stored.collect()) == [f"http://{s}.org/" for s in "abc"]
    assert sorted(map(tuple, read["nav"].collect())) == sorted(map(tuple, nav.collect()))
    assert read["sitemap_urls"].filter("title IS NOT NULL").count() == 0 and read["pages"].count() == 0
    one, lines = tables.read_site_parts(spark, str(tmp_path), ["http://b.org/"])
    assert [r.base_url for r in one.collect()] == ["http://b.org/"] and lines["nav"].count() == 500
    assert "PushedFilters: [In(site" in lines["nav"]._jdf.queryExecution().executedPlan().toString() or "EqualTo(site" in lines["nav"]._jdf.queryExecution().executedPlan().toString()
    sinks.write_site_parts(whole_facts.withColumn("ir_version", F.lit(2)), lists, f"{tmp_path}/new")
    try:
        tables.read_site_parts(spark, f"{tmp_path}/new")[0].count()
    except Exception as error:  # noqa: BLE001 - the message matters, not Spark's class of it
        assert "Unsupported record version 2; expected 1." in str(error)
    else:
        raise AssertionError("another version must not be read")
