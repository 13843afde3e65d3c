"""Wrappers on long, deep and broken pages, and their alignment against brute force."""

from __future__ import annotations

import functools
import json
import random
import time

import pytest

from quireflow.llm import wrappers


def _decided(pages):
    total = functools.reduce(wrappers.align, (wrappers.page_wrapper(list(wrappers.blocks(p))) for p in pages))
    return wrappers.decide(json.loads(json.dumps(total)))


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<div>x" * 20_000, 20_000), ("<h2>x<details>" * 10_000, 10_000), ("<div>x" * 20_000 + "</section>" * 20_000, 20_000),
        ("<body>" + "<h2>a</h2><p>b</p>" * 10_000, 20_000), ("<a " * 100_000, 1), ('<a "' * 100_000, 1),
        ("<div class=a>" * 3000 + "<p>one<p>two", 2), ("<ul><li>" * 5000 + "deep", 1),
    ],
)
def test_long_and_deep_pages(spark, page, texts):
    start = time.perf_counter()
    found = list(wrappers.blocks(page))
    decision = _decided([page, page[: len(page) // 2]])
    assert len(found) == texts and time.perf_counter() - start < 40
    assert wrappers.main_text(page, decision)
    assert all(len(labels) <= 2 * wrappers.DEPTH for labels, _ in found)


def test_a_deep_page_does_not_end_the_job(spark):
    rows = [(1, "http://e.org/1", "<div>x" * 3000), (2, "http://e.org/2", "<p>plain"), (3, None, None)]
    got = {r.page_id: r.n_chars for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: 3000 + 2 * 2999, 2: 5, 3: 0}


def test_deep_menus_are_still_menus():
    page = "<div>" * 300 + "<nav>menu</nav><p>text</p><footer>end</footer><div class='cookie x'>notice</div>"
    assert wrappers.main_text(page, {"content": False, "constant": []}) == "text"
    deep = "<div>" * 300 + "<article><p>body</p></article>rest"
    assert wrappers.main_text(deep, _decided([deep])) == "body"


def test_pairs_equal_the_longest_common_subsequence(monkeypatch):
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))

        @functools.cache
        def longest(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return longest(i + 1, j + 1) + 1 if a[i] == b[j] else max(longest(i + 1, j), longest(i, j + 1))

        for cells in (wrappers.TABLE_CELLS, 0):
            with monkeypatch.context() as patch:
                patch.setattr(wrappers, "TABLE_CELLS", cells)
                pairs = list(wrappers._pairs(a, b))
            assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
            assert [j for _, j in pairs if j is not None] == list(range(len(b)))
            met = [(i, j) for i, j in pairs if i is not None and j is not None]
            assert all(a[i] == b[j] for i, j in met)
            assert len(met) == longest(0, 0) or not cells


def test_the_wrapper_decides_on_pages_without_a_content_element():
    draw = random.Random(2)
    own = [" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(4)]
    pages = [f"<body><p>The same line on all pages</p><div><h1>{t[:20]}</h1><p>{t}</p></div>" for t in own]
    decision = _decided(pages)
    for text, page in zip(own, pages, strict=True):
        assert wrappers.main_text(page, decision) == f"{text[:20].strip()}\n\n{text}"
        assert wrappers.main_text(page, {"content": False, "constant": []}).startswith("The same line")
