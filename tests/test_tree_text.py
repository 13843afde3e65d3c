"""Texts of nested elements against a plain walk, and their cost."""

import random

from pyspark.sql import functions as F

from quireflow.operators import tree as t
from quireflow.sources import markup


def _nested(rng, depth):
    parts = []
    for _ in range(rng.randint(0, 4)):
        parts.append(rng.choice(["é text ", " ", "\n", "a", "<br>", "<!-- c -->"]))
        if depth and rng.random() < 0.7:
            tag = rng.choice(["div", "b", "section"])
            parts.append(f"<{tag}>{_nested(rng, depth - 1)}</{tag}>")
    return "".join(parts)


def test_texts_equal_a_walk(spark):
    rng = random.Random(3)
    pages = [(n, _nested(rng, 6)) for n in range(60)]
    nodes = markup.parse_html(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").cache()
    rows = nodes.orderBy("page_id", "open_seq").collect()
    match = F.col("tag").isin("div", "b", "br")
    plain, joined = {}, {}
    for a in rows:
        if a.tag in ("div", "b", "br"):
            below = [r.text for r in rows if r.page_id == a.page_id and r.kind == "text" and a.open_seq < r.open_seq < a.close_seq]
            plain[a.page_id, a.node_id] = "".join(below)
            kept = [x.strip() for x in below if x.strip()]
            if kept:
                joined[a.page_id, a.node_id] = " | ".join(kept)
    assert len(plain) > 100 and len(joined) > 50
    assert {(r.page_id, r.node_id): r.text for r in t.subtree_text(nodes, match).collect()} == plain
    assert {(r.page_id, r.node_id): r.text for r in t.joined_text(nodes, match, " | ").collect()} == joined
    texts = t.subtree_text(nodes, F.col("kind") == "text").collect()
    assert texts and {r.text for r in texts} == {""}
    assert t.subtree_text(nodes.filter("false"), match).count() == 0


def test_no_pairs_of_ancestors_and_texts(spark):
    """400 elements in one another around 400 texts: 160,000 pairs, but rows in proportion to the nodes."""
    html = "<div>x" * 400 + "</div>" * 400
    nodes = markup.parse_html(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id", "html")
    found = t.subtree_text(nodes, F.col("tag") == "div")
    assert sorted(len(r.text) for r in found.collect()) == list(range(1, 401))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    events = t._sliced_text(nodes, F.col("tag") == "div", F.col("text"), "")
    assert events.count() == 400


def test_rows_outside_islands_are_not_collected(spark):
    """The text of marked elements and tables from preformatted blocks leave other rows where they are."""
    from quireflow.plans import capture, clean

    html = "<p>before</p><math><mi>x</mi><mn>2</mn></math><pre>a  b  c\n1  2  3\n4  5  6</pre><pre>plain <b>text</b></pre><p>after <math alttext=y>z</math></p>"
    pages = spark.createDataFrame([(1, html), (2, "<p>nothing</p>")], "page_id long, html string")
    nodes = markup.parse_html(pages, "page_id", "html")
    texts = t.with_text(nodes, F.col("tag") == "math", "_t")
    assert sorted(r._t for r in texts.filter("_t IS NOT NULL").collect()) == ["x2", "z"]
    made = clean.tabular_pre_to_table(nodes)
    tags = [r.tag for r in made.filter("page_id = 1 AND kind = 'element'").orderBy("open_seq").collect()]
    assert tags == ["p", "math", "mi", "mn", "table", "tbody", *["tr", "th", "th", "th"], *["tr", "td", "td", "td"] * 2, "pre", "b", "p", "math"]
    assert set(made.columns) == set(nodes.columns)
    nested = "<span role=tab aria-controls=a>one <span role=tab aria-controls=b>two</span> end</span><div id=a hidden>x</div><div id=b hidden>y</div>"
    tabs = markup.parse_html(spark.createDataFrame([(1, nested)], "page_id long, html string"), "page_id", "html")
    shown = t.joined_text(capture.label_tab_panels(tabs), F.col("tag") == "div", "|").collect()
    assert sorted(r.text for r in shown) == ["one  end|x", "two|y"]
    for frame in (texts, made):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        groups = [line for line in plan.splitlines() if "Aggregate" in line and "collect_list" in line]
        assert not [line for line in groups if "attrs" in line], groups
