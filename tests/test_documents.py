"""Document rewrites: one small page per rule, and properties of the rewrites on random trees."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quireflow.operators import tree as t
from quireflow.plans import capture, clean
from quireflow.session import cut_lineage
from quireflow.sources.markup import parse_html

MATH = "http://www.w3.org/1998/Math/MathML"
#: rule: (title, captured content, chapter content)
RULES = {
    "title heading goes": ("Ferries", "<h3>Ferries</h3><p>Daily.</p>", "<p>Daily.</p>"),
    "other first heading stays": ("Ferries", "<h2>Fares</h2><p>Low.</p>", "<h2>Fares</h2><p>Low.</p>"),
    "levels do not skip": ("T", "<h5>One</h5><h6>Two</h6><h1>Three</h1>", "<h2>One</h2><h3>Two</h3><h2>Three</h2>"),
    "unknown elements open up": ("T", "<tide-chart><p>High <blink>now</blink></p></tide-chart>", "<p>High now</p>"),
    "unknown attributes go": ("T", "<p data-n='4' onfocus='f()' title='hint'>x</p>", '<p title="hint">x</p>'),
    "known page": ("T", "<a href='/harbour#East Quay'>Quay</a>", '<a href="port-2.xhtml#East-Quay">Quay</a>'),
    "other site": ("T", "<a href='https://sea.example/z'>Z</a>", '<a href="https://sea.example/z">Z</a>'),
    "script link opens up": ("T", "<p><a href='javascript:go()'>Go</a></p>", "<p>Go</p>"),
    "mail link stays": ("T", "<p><a href='mailto:pier@sea.example'>Mail</a></p>", '<p><a href="mailto:pier@sea.example">Mail</a></p>'),
    "repeated ids": ("T", "<p id='n'>1</p><p id='n'>2</p>", '<p id="n">1</p><p id="n-2">2</p>'),
    "first row heads": (
        "T",
        "<table><tr><td>Hour</td><td>Depth</td></tr><tr><td>6</td><td>2 m</td></tr></table>",
        '<table><tr><th scope="col">Hour</th><th scope="col">Depth</th></tr><tr><td>6</td><td>2 m</td></tr></table>',
    ),
    "columns in plain text": (
        "T",
        "<pre>boat    crew  berth\nHeron   4     north\nPetrel  11    south</pre>",
        '<table><tbody><tr><th scope="col">boat</th><th scope="col">crew</th><th scope="col">berth</th></tr><tr><td>Heron</td>'
        "<td>4</td><td>north</td></tr><tr><td>Petrel</td><td>11</td><td>south</td></tr></tbody></table>",
    ),
    "prose in plain text": ("T", "<pre>one line\nand another</pre>", "<pre>one line\nand another</pre>"),
    "picture in a sentence": ("T", "<p>Steer <img src='k.png' alt='left'> there.</p>", '<p>Steer <img src="k.png" alt="left"/> there.</p>'),
    "picture of its own": ("T", "<img src='m.png' alt='map'>", '<figure><img src="m.png" alt="map"/></figure>'),
    "stored picture": ("T", "<img src='assets/sea.webp'>", '<figure><img src="../images/sea.png" alt="Illustration"/></figure>'),
    "list numbers": ("T", "<ol start='7'><li value='12'>n</li></ol>", '<ol start="7"><li value="12">n</li></ol>'),
    "formula text": (
        "T",
        f"<math xmlns='{MATH}'><mfrac><mi>a</mi><mn>3</mn></mfrac></math>",
        f'<math xmlns="{MATH}" alttext="a3"><mfrac><mi>a</mi><mn>3</mn></mfrac></math>',
    ),
}


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(n, "s", "https://sea.example/here", title, html) for n, (title, html, _) in enumerate(RULES.values())]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, title string, html string")
    files = spark.createDataFrame([("s", "https://sea.example/harbour", "port-2.xhtml")], "site string, url string, file string")
    assets = spark.createDataFrame([("s", "sea.webp", "sea.png")], "site string, name string, output string")
    nodes = cut_lineage(parse_html(pages, "page_id", "html", "site", "url", "title"))
    return dict(t.serialize(clean.clean_pages(nodes, files, assets)).collect())


@pytest.mark.parametrize("rule", RULES)
def test_chapter_content(cleaned, rule):
    assert cleaned[list(RULES).index(rule)] == RULES[rule][2]


def test_links_to_nowhere_lose_their_fragment(spark):
    quay = (
        '<p id="east">E</p><ul><li><a href="pier.xhtml#deck">deck</a></li><li><a href="pier.xhtml#hull">hull</a></li></ul>'
        '<a href="#west">west</a> <a href="#east">east</a> <a href="https://sea.example/z#q">out</a>'
    )
    rows = [(1, "s", "quay.xhtml", quay), (2, "s", "pier.xhtml", '<h2 id="deck">Deck</h2>')]
    pages = spark.createDataFrame(rows, "page_id long, site string, file string, html string")
    nodes = cut_lineage(parse_html(pages, "page_id", "html", "site", "file"))
    found = dict(t.serialize(clean.prune_dangling_fragments(nodes, pages.select("site", "file"))).collect())
    assert found[1] == quay.replace("#hull", "").replace('<a href="#west">west</a>', "west")
    assert found[2] == rows[1][3]


def test_capture_content(spark):
    html = (
        "<html lang='nl'><head><title>Port</title></head><body><nav aria-label='The docs'><a href='/fares'> Fares </a></nav><main>"
        "<article><h1>Boats</h1><div role='tablist'><span role='tab' aria-controls='t7'> Sail </span></div><div id='t7' hidden class='q'>"
        "canvas</div><p style='display: none'>unseen</p><button>press</button><iframe src='/live' title='Camera'>in</iframe></article></main></body></html>"
    )
    pages = spark.createDataFrame([(1, "https://sea.example/a", html)], "page_id long, url string, html string")
    nodes = parse_html(pages, "page_id", "html", "url")
    assert t.serialize(capture.capture_content(nodes)).first()["html"] == (
        '<h1>Boats</h1><div role="tablist"><span role="tab" aria-controls="t7"> Sail </span></div>'
        '<div id="t7"><h3>Sail</h3>canvas</div><a href="https://sea.example/live">Camera</a>'
    )
    link = capture.nav_links(nodes).first()
    assert (link["title"], link["href"]) == ("Fares", "https://sea.example/fares")
    titles = capture.page_titles(nodes).first()
    assert (titles["title"], titles["language"]) == ("Boats", "nl")


NODE = (
    "page_id long, open_seq long, node_id long, close_seq long, kind string, tag string, "
    "attrs array<struct<name: string, value: string>>, text string"
)


def _random_page(rng, page):
    """Interval rows of a random page, made without the parser so that none of its rules interferes."""
    rows, open_tags, clock = [], [], 0
    for _ in range(rng.randint(1, 40)):
        clock += 10
        if open_tags and (len(open_tags) > 5 or rng.random() < 0.4):
            rows[open_tags.pop()][3] = clock
            continue
        tag = rng.choice(["div", "p", "span", "b", "ul", "h2", "pre", "a", "em"])
        attrs = [("id", f"i{clock}")] if rng.random() < 0.2 else []
        rows.append([page, clock, clock, None, "element", tag, attrs, None])
        open_tags.append(len(rows) - 1)
    while open_tags:
        clock += 10
        rows[open_tags.pop()][3] = clock
    return [tuple(row) for row in rows]


def _misplaced(elements):
    """(inner, outer) starts of flow elements inside phrasing-only ones; elements are (start, end, tag)."""
    return [
        (inner[0], outer[0])
        for inner in elements for outer in elements
        if outer[0] < inner[0] < outer[1] and inner[2] in clean.FLOW_ONLY and outer[2] in clean.PHRASING_ONLY
    ]


def test_repaired_nesting_is_valid_and_minimal(spark):
    """What must hold of the result, whatever way it was reached."""
    rng = random.Random(3)
    pages = [_random_page(rng, page) for page in range(400)]
    repaired = clean.repair_nesting(spark.createDataFrame([row for page in pages for row in page], NODE))
    after = {}
    for row in repaired.select("page_id", "open_seq", "close_seq", "tag").collect():
        after.setdefault(row.page_id, {})[row.open_seq] = (row.close_seq, row.tag)
    touched = 0
    for page, rows in enumerate(pages):
        before = {row[1]: (row[3], row[5]) for row in rows}
        kept = after.get(page, {})
        assert not _misplaced([(start, end, tag) for start, (end, tag) in kept.items()])
        assert all(end == before[start][0] for start, (end, _) in kept.items())
        assert {row[1] for row in rows if row[6]} <= set(kept)
        assert all(before[start][1] in clean.PHRASING_ONLY + clean.SOFT_FLOW for start in set(before) - set(kept))
        assert {tag for start, (_, tag) in kept.items() if tag != before[start][1]} <= {"div", "span"}
        faults = _misplaced([(start, end, tag) for start, (end, tag) in before.items()])
        involved = {start for pair in faults for start in pair}
        touched += bool(faults)
        assert {start: kept.get(start) for start in before if start not in involved} == {
            start: value for start, value in before.items() if start not in involved
        }
    assert 50 < touched < 400


def _ids(spark, pages):
    rows = [(n, "".join(f"<i id='{name}'></i>" for name in page)) for n, page in enumerate(pages)]
    nodes = parse_html(spark.createDataFrame(rows, "page_id long, html string"))
    made = clean.unique_ids(nodes).select("page_id", "open_seq", t.attr("id").alias("id")).orderBy("page_id", "open_seq")
    found = {}
    for row in made.collect():
        found.setdefault(row.page_id, []).append(row.id)
    return found


def test_unique_ids_take_the_first_unused_number(spark):
    rng = random.Random(5)
    pages = [[rng.choice(["a", "a-2", "a-3", "b", "b-2", "a-2-2"]) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    found = _ids(spark, pages)
    for n, page in enumerate(pages):
        for at, (base, name) in enumerate(zip(page, found[n], strict=True)):
            earlier = found[n][:at]
            tried = [base, *(f"{base}-{k}" for k in range(2, at + 3))]
            assert name == next(one for one in tried if one not in earlier)


def test_unique_ids_of_a_page_with_thousands(spark):
    many = ["x", "x-2", "x", *(f"n{k}" for k in range(2500)), *["y"] * 2500, "y-9"]
    begun = time.monotonic()
    found = _ids(spark, [many])[0]
    assert time.monotonic() - begun < 60
    assert len(set(found)) == len(many)
    assert found[:3] == ["x", "x-2", "x-3"] and found[-2:] == ["y-2500", "y-9-2"]


def test_ancestry_steps_add_no_shuffle(spark):
    """One exchange in the plan: the one that brings a page's tokens together."""
    pages = spark.createDataFrame([(1, "<p>a<b>c</b></p>")], "page_id long, html string")
    nodes = clean.normalize_headings(clean.repair_nesting(clean.drop_empty_links(clean.sanitize(parse_html(pages)))))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_shapes_of_a_batch_are_not_python_objects():
    """Of a batch of many pages only one at a time is Python objects, so a worker's memory follows its longest page."""
    import tracemalloc

    import pyarrow as pa

    from quireflow.sources import markup

    page = ["<p", "t", "<b", "t", "/b", "/p"] * 100
    codes = pa.array([page, None, []] + [page] * 500)
    tracemalloc.start()
    shapes = markup._shape_batch(codes, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000
    parent, closed_at, depth = markup.page_shape(page)
    assert shapes[0].as_py() == shapes[502].as_py() == {"parent": parent, "closed_at": closed_at, "depth": depth}
    assert shapes[1].as_py() == shapes[2].as_py() == {"parent": [], "closed_at": [], "depth": []}


def test_partitions_of_a_node_table_follow_its_markup(spark, monkeypatch):
    """A larger table makes more partitions, not larger ones, whatever the session's number; pages stay whole."""
    from quireflow.sources import markup

    rows = [(i, f"<p>{'a' * 1000}<b>c</b></p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    monkeypatch.setattr(markup, "PARTITION_BYTES", 2000, raising=False)
    many = markup.parse_html(pages).withColumn("part", F.spark_partition_id())
    assert many.rdd.getNumPartitions() >= 20
    found = many.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).collect()
    assert len(found) == 40 and {(r.n, r.parts) for r in found} == {(4, 1)}
    assert markup.parse_html(pages.limit(0)).count() == 0
