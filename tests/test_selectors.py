"""Selector strings against a plain tree walk."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import selectors
from quireflow.plans import capture
from quireflow.sources import markup

TAGS = ["div", "section", "span", "b"]
CLASSES = ["one", "two words", "One", "a-one", None]
SELECTORS = [
    "div", "*", "#x1", ".one", ".words", "div.one", "div div", "section .one span", "div *", "[title]", "[title=en]", "[title='EN' i]",
    "[title|=en]", "[title^=e]", "[title$='us']", "[title*='-']", "[class~=words]", "[title*='']", "b, section > span", "span[title][id]", " div ,b\tb ", "DIV.one#x3",
]


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def above(self):
        node = self.parent
        while node is not None and node.tag:
            yield node
            node = node.parent


def _tree(rng):
    root = Node("", {}, None)
    nodes = [root]
    for n in range(rng.randint(1, 25)):
        attrs = {"id": f"x{n % 7}"} if rng.random() < 0.4 else {}
        if (c := rng.choice(CLASSES)) is not None:
            attrs["class"] = c
        if rng.random() < 0.4:
            attrs["title"] = rng.choice(["en", "en-us", "EN", "", "x"])
        node = Node(rng.choice(TAGS), attrs, rng.choice(nodes))
        node.parent.children.append(node)
        nodes.append(node)
    return root


def _html(node):
    inner = "".join(map(_html, node.children))
    attrs = "".join(f' {k}="{v}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>" if node.tag else inner


def _walk(node):
    for child in node.children:
        yield child
        yield from _walk(child)


def _holds(node, test):
    if test.kind == "tag":
        return node.tag == test.name
    have = node.attrs.get(test.name)
    if have is None or test.kind == "":
        return have is not None
    want = test.value
    if test.fold:
        have, want = have.lower(), want.lower()
    if test.kind == "=":
        return have == want
    if test.kind == "|=":
        return have == want or have.startswith(want + "-")
    if want == "":
        return False
    return {"~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have}[test.kind]


def _matches(node, steps):
    if not all(_holds(node, test) for test in steps[-1]):
        return False
    return len(steps) == 1 or any(_matches(a, steps[:-1]) for a in node.above())


def test_selectors_equal_a_tree_walk(spark):
    rng = random.Random(5)
    trees = [_tree(rng) for _ in range(40)]
    pages = spark.createDataFrame([(n, _html(tree)) for n, tree in enumerate(trees)], "page_id long, html string")
    nodes = markup.parse_html(pages, "page_id", "html")
    usable = [s for s in SELECTORS if ">" not in s]
    for n, selector in enumerate(usable):
        nodes = selectors.mark(nodes, selector, f"m{n}")
    rows = nodes.filter("kind = 'element'").orderBy("page_id", "open_seq").collect()
    got = {}
    for row in rows:
        got.setdefault(row.page_id, []).append(row)
    seen = set()
    for n, tree in enumerate(trees):
        plain = list(_walk(tree))
        assert [r.tag for r in got[n]] == [p.tag for p in plain]
        for k, selector in enumerate(usable):
            alternatives = selectors.parse(selector)
            expected = [any(_matches(p, steps) for steps in alternatives) for p in plain]
            assert [r[f"m{k}"] for r in got[n]] == expected, selector
            seen |= {selector} if any(expected) else set()
    assert set(usable) - seen == {"[title*='']"}


@pytest.mark.parametrize(
    ("text", "named"),
    [
        ("a > b", "child combinator"), ("a:hover", "pseudo"), ("a + b", "next-sibling"), ("a ~ b", "sibling"), ("", "end of the string"),
        ("a,", "end of the string"), ("[x", "attribute test"), ("a[x=1 2]", "attribute test"), (".#", "a class"), ("#", "an id"), ("*|a", "namespace"),
        (".a b.c d!", "'!'"), ("#x div.a::before", "pseudo"), (".a*", "tag must come first"),
    ],
)
def test_odd_selectors_are_rejected_by_name(text, named):
    with pytest.raises(selectors.SelectorError, match=named):
        selectors.parse(text)


def test_steps_add_no_shuffle_and_no_join(spark):
    pages = spark.createDataFrame([(1, "<div><p class=a>x</p></div>")], "page_id long, html string")
    parsed = markup.parse_html(pages, "page_id", "html")
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (parsed, selectors.select(parsed, "div p.a, body div p *"))]
    assert "Join" not in plans[1]
    assert plans[1].count("Exchange ") <= max(plans[0].count("Exchange "), 1)


def test_own_selectors_win_and_fall_back(spark):
    html = "<article>usual</article><div id=documentation><nav class=menu><a href='x'>X</a></nav>own</div>"
    pages = spark.createDataFrame([(1, "http://e.org/", html), (2, "http://e.org/", "<article>usual</article>")], "page_id long, url string, html string")
    nodes = markup.parse_html(pages, "page_id", "html", "url")
    texts = capture.content_root(nodes, "main, #documentation").filter("kind = 'text'").groupBy("page_id").agg(F.array_join(F.collect_list("text"), "").alias("t"))
    assert dict(texts.collect()) == {1: "Xown", 2: "usual"}
    assert set(capture.content_root(nodes, "#documentation").columns) == set(nodes.columns)
    assert [r.href for r in capture.nav_links(nodes, ".menu").collect()] == ["http://e.org/x"]
    assert {r.page_id for r in capture.rooted_pages(nodes, "#documentation").collect()} == {1, 2}
