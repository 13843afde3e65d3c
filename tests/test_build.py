"""The whole build over pages as rows against the chain of node-table rewrites it stands for."""

from pyspark.sql import functions as F

from quireflow.functions.ids import chapter_name
from quireflow.functions.url import canonical_url, path
from quireflow.operators import tree as t
from quireflow.plans import build, capture, clean
from quireflow.plans.book import chapter_document
from quireflow.sources.markup import parse_html

ODD = [
    '<article><h1>T0</h1><h3 id="a">x</h3><h6 id="a">y</h6><p id="a-2">z</p><p id="">e</p><h2>w</h2></article>',
    '<main><div class="content"><p>in main</p><pre>A  B  C\n1  2  3\n4  5  6\n<b>7</b>  8  9</pre></div></main><article></article>',
    '<article><div role="tablist"><b role="tab" aria-controls="p">One<i role="tab" aria-controls="p">Two</i></b></div>'
    '<div id="p" hidden>first</div><div id="p">second</div><img id="q"></article>',
    '<article><div role="tablist"><b role="tab" aria-controls="gone">One</b></div><div role="tablist"></div><b role="tab">no key</b></article>',
    '<article><svg title="t"><g hidden></g><svg aria-hidden="true"><path d="&amp;"/></svg></svg><svg aria-hidden="true"/>'
    '<iframe src="f" title=""><p>in</p></iframe><iframe></iframe><nav><svg></svg></nav></article>',
    '<article><details><summary>S</summary><summary>U</summary><custom><summary>V</summary></custom></details><summary>W</summary></article>',
    '<article><a href="#x"><span></span></a><span><div>d<b>e<ul><li>f</ul>g</b></div></span><h2>h<p>i</p></h2><a id="k"></a><b><pre>j</pre></b></article>',
    '<article><math><mi>e</mi><math><mn>2</mn></math></math><math alttext="own"><mi>f</mi></math></article>',
    '<article><table><tr><td>a<table><tr><td>b</td></tr></table></td></tr><tr><td>c</td></tr></table><table><tr><th>h<tr><td>i</table></article>',
    '<article><p><img src="a" alt=""></p><div><img src="b" alt="own"></div><figure><img></figure></article><img>',
    '<article><a href="/p0#a">to</a><a href="/p0#none">lost</a><a href="#none">own</a><a href="javascript:x">js</a><a href="">e</a><a href="mailto:a@b">m</a></article>',
    '<div hidden><article><p>shown</p><p style="display: none">no</p><!-- c --></article></div>',
    "<p>no root</p>",
    '<html lang=""><article></article></html>',
    "<div role='main'>role &lt;root&gt; <pre></pre></div>",
]


def as_node_tables(pages, files):
    """The build as a chain of node-table rewrites."""
    canonical = canonical_url("url")
    parsed = parse_html(pages, "page_id", "html", "site", "url", "title").localCheckpoint()
    nodes = capture.capture_content(parsed).localCheckpoint()
    linked = clean.rewrite_links(clean.clean_structure(nodes).localCheckpoint(), files, source=nodes)
    illustrated = clean.promote_table_header(clean.rewrite_images(linked, source=nodes))
    named = illustrated.withColumn("file", chapter_name(path(canonical), canonical)).localCheckpoint()
    content = t.serialize(clean.prune_dangling_fragments(named, files), "page_id")
    known = capture.page_titles(parsed).select("page_id", "language").join(capture.rooted_pages(parsed), "page_id")
    joined = pages.drop("html").join(known, "page_id").join(content, "page_id", "left").fillna("", ["html"])
    return joined.select("page_id", chapter_document(F.col("title"), F.col("url"), F.col("language"), F.col("html")).alias("html"))


def build_input(spark, htmls):
    rows = [(n, "s", f"http://s.example/p{n}", f"T{n}", html) for n, html in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, site string, url string, title string, html string")
    address = canonical_url("url")
    return pages, pages.select("site", address.alias("url"), chapter_name(path(address), address).alias("file"))


def test_pages_as_rows_give_the_chapters_of_the_node_tables(spark):
    pages, files = build_input(spark, ODD)
    wanted = {r.page_id: r.html for r in as_node_tables(pages, files).collect()}
    assert {r.page_id: r.html for r in build.build_chapters(pages, files).collect()} == wanted
    assert len(wanted) == len(ODD) - 1


def test_the_rewrites_of_the_build_sort_no_nodes(spark):
    """Windows over node tables sorted every node for each question."""
    from quireflow.plans import chapters
    from quireflow.sources.markup import parse_pages

    pages, _ = build_input(spark, ODD)
    made = chapters.empty_links_and_nesting(parse_pages(pages, "page_id", "html", "title"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") <= 1


def test_an_own_selector_names_the_root(spark):
    pages, files = build_input(spark, ['<article>a</article><div id="own"><p>b</p></div>', "<article>c</article>"])
    got = {r.page_id: r.html for r in build.build_chapters(pages, files, content_selector="#own").collect()}
    assert "<p>b</p>" in got[0] and ">a<" not in got[0] and "c\n" in got[1]


def test_images_found_among_the_assets_are_renamed(spark):
    pages, files = build_input(spark, ['<article><p><img src="/x/a.png"><img src="b.png"></p></article>'])
    assets = spark.createDataFrame([("s", "a.png", "out.png")], "site string, name string, output string")
    [row] = build.build_chapters(pages, files, assets).collect()
    assert 'src="../images/out.png"' in row.html and 'src="b.png"' in row.html


def test_a_stored_stage_of_the_build_replaces_the_one_before(spark, monkeypatch, tmp_path):
    """Each stage was a checkpoint that stayed, so all pages stood on disk ten times."""
    from quireflow import session

    pages, files = build_input(spark, ODD)
    kept = []
    checkpoint = type(pages).checkpoint
    monkeypatch.setattr(type(pages), "checkpoint", lambda df, *a, **b: kept.append(df.columns) or checkpoint(df, *a, **b))
    monkeypatch.setattr(session, "scratch_folder", lambda spark, name: f"{tmp_path}/{name}", raising=False)
    as_set = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    built = build.build_chapters(pages, files)
    assert kept == [] and len(list((tmp_path / "chapters").iterdir())) == 1
    assert built.count() == len(built.collect()) == len(ODD) - 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == as_set
