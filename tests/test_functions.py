"""Known values of the column functions, and properties on random input."""

import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import ids, media, text, url


def values(spark, column, rows):
    """Apply ``column`` (a function of input columns a and b) to every row."""
    frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n int, a string, b string")
    return [row.v for row in frame.select("n", column().alias("v")).orderBy("n").collect()]


def one(spark, column, inputs):
    return values(spark, column, [(value, "") for value in inputs])


_SAFE = "ABCabc_"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=_SAFE + "09.- /é&\t", max_size=12), min_size=1, max_size=20))
def test_xml_id_rules(spark, names):
    """An id is made of safe characters, begins with a letter or underscore, and is its own id."""
    found = one(spark, lambda: ids.xml_id("a"), names)
    assert all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9._-]*", f) for f in found)
    assert one(spark, lambda: ids.xml_id("a"), found) == found
    assert all(f == n for f, n in zip(found, names, strict=True) if n and set(n) <= set(_SAFE))


def test_scope_is_the_path_and_what_lies_below(spark):
    base = "http://handbook.test:8080/v2/en"
    inside = ["http://handbook.test:8080/v2/en", "http://handbook.test:8080/v2/en/", "http://handbook.test:8080/v2/en/a/b?x#y"]
    outside = [
        "http://handbook.test:8080/v2/english", "http://handbook.test:8080/v2", "http://handbook.test/v2/en/a",
        "gopher://handbook.test:8080/v2/en/a", "http://www.handbook.test:8080/v2/en/a", "",
    ]
    found = values(spark, lambda: url.in_scope("a", "b"), [(u, base) for u in inside + outside])
    assert found == [True] * len(inside) + [False] * len(outside)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "/", "/k", "/k/", "/k/l//m/", "/K.html"]), st.sampled_from(["", "?n=2", "#top", "?n=2#top"])), min_size=1, max_size=12))
def test_canonical_url_rules(spark, parts):
    """Query and fragment go, a path has no slash at its end but the root's, and the form is its own."""
    given_urls = [f"http://wiki.test{path}{tail}" for path, tail in parts]
    found = one(spark, lambda: url.canonical_url("a"), given_urls)
    for (path, _), f in zip(parts, found, strict=True):
        assert f == "http://wiki.test" + (re.sub("/+", "/", path).rstrip("/") or "/")
    assert one(spark, lambda: url.canonical_url("a"), found) == found


def test_route_name_is_a_plain_file_name(spark):
    routes = ["/", "./..", "/Chapter 1/Über uns/", "//a//b//", "/x/../y", "...", "/api/v1.2/"]
    found = one(spark, lambda: ids.route_name("a"), routes)
    assert all(f and "/" not in f and f not in {".", ".."} for f in found)
    assert found[0] == "index" and len(set(found)) > 3


def test_url_join_known(spark):
    base = "http://a/b/c/d;p?q"
    refs = ["g", "./g/", "../../g", "//g", "#s", "?y", "https://x/y", "", "../../../../g", "g/../h"]
    expected = [
        "http://a/b/c/g", "http://a/b/c/g/", "http://a/g", "http://g", "http://a/b/c/d;p?q#s",
        "http://a/b/c/d;p?y", "https://x/y", base, "http://a/g", "http://a/b/c/h",
    ]
    assert values(spark, lambda: url.url_join("b", "a"), [(ref, base) for ref in refs]) == expected


def test_hashes(spark):
    assert one(spark, lambda: ids.sha256_hex("a"), ["abc"]) == [hashlib.sha256(b"abc").hexdigest()]
    names = ["http://python.org/", "https://docs.example/", "ü"]
    assert one(spark, lambda: ids.uuid5_url("a"), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_base64_vectors(spark):
    plain = ["", "f", "fo", "foo", "foob", "fooba", "foobar"]
    encoded = ["", "Zg==", "Zm8=", "Zm9v", "Zm9vYg==", "Zm9vYmE=", "Zm9vYmFy"]
    assert one(spark, lambda: text.base64_encode(F.encode("a", "UTF-8")), plain) == encoded
    loose = ["", "Zg", "Zm8", "Zm\n9v", "Z m9vYg", "-Zm9vYmE", "Zm9vYmFy"]
    assert one(spark, lambda: F.decode(text.base64_decode("a"), "UTF-8"), loose) == plain


def test_utf8_and_charset(spark):
    hexes = ["436166C3A920F09F9398", "436166E9", "C0AF", "EDA080", "E282"]
    assert one(spark, lambda: text.valid_utf8(F.unhex("a")), hexes) == [True, False, False, False, False]
    pages = [
        '<html><head><META CHARSET="iso-8859-1">',
        '<meta http-equiv="Content-Type" content="text/html; charset=utf-8">',
        '<html><head><meta name="viewport" content="width=device-width"><title>x</title>',
        " " * 1100 + '<meta charset="utf-8">',
    ]
    assert one(spark, lambda: text.declares_charset("a"), pages) == [True, True, False, False]


def test_site_name(spark):
    titles = ["Intro | Docs | Site", "Plain", "a-b", "Guide – Tool"]
    found = one(spark, lambda: text.site_name(F.lit(""), F.lit(" "), "a"), titles)
    assert found == ["Site", "Plain", "a-b", "Tool"]


def test_media_names(spark):
    assert one(spark, lambda: media.extension_for_media_type("a"), [" Image/PNG ; q=1", "text/html"]) == [".png", ""]
    assert one(spark, lambda: media.file_extension("a"), ["a/b.tar.gz", ".hidden", "x.d/y"]) == [".gz", "", ""]


segments = st.text(alphabet="abcXYZ019._-~%", min_size=0, max_size=8)
urls = st.builds(
    lambda host, path, tail: f"https://{host}.example/{'/'.join(path)}{tail}",
    st.text(alphabet="abc019", min_size=1, max_size=6),
    st.lists(segments, max_size=5),
    st.sampled_from(["", "/", "#f", "?q=1", "?q#f", "//"]),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(urls, min_size=200, max_size=200))
def test_canonical_url_properties(spark, many):
    once = one(spark, lambda: url.canonical_url("a"), many)
    assert one(spark, lambda: url.canonical_url("a"), once) == once
    for result in once:
        path = result.split(".example", 1)[1]
        assert path.startswith("/") and "//" not in path and "#" not in path and "?" not in path
        assert path == "/" or not path.endswith("/")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "c d"]), min_size=1, max_size=6), min_size=150, max_size=150))
def test_url_join_agrees_with_the_standard_rules(spark, many):
    base = "http://h/a/b/c"
    refs = ["/".join(parts) for parts in many]
    assert values(spark, lambda: url.url_join("b", "a"), [(r, base) for r in refs]) == [urljoin(base, r) for r in refs]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00\r"), max_size=30), min_size=150, max_size=150))
def test_names_are_portable_and_escapes_reverse(spark, many):
    named = one(spark, lambda: ids.xml_id("a"), many)
    assert one(spark, lambda: ids.xml_id("a"), named) == named
    assert all(n and set(n) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-") for n in named)
    escaped = one(spark, lambda: text.escape_html("a"), many)
    assert escaped == [html.escape(v) for v in many]
    assert one(spark, lambda: text.unescape_html(text.escape_html("a")), many) == many


def test_unescape_known(spark):
    found = one(spark, lambda: text.unescape_html("a"), ["&copy;&nbsp;&bogus;&#65;&#x1F4D8; & &amp;lt;", "&#0;&#xD800;x"])
    assert found == ["© &bogus;A\U0001f4d8 & &lt;", "x"]
