"""URL columns. All of them stay inside built-in expressions.

Absent parts are empty strings, never null, and nothing is percent-decoded.
``parse_url`` is not used: it gives null for a path with a space or a bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

# The generic URL split and the schemes written with an authority.
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
AUTHORITY_SCHEMES = ("http", "https", "file", "ftp", "ws", "wss")
DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|\z)"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def url_parts(url: Column | str) -> Column:
    """struct<scheme, netloc, path, query, fragment>; unused fields are pruned by the optimizer."""
    url = _column(url)
    return F.struct(
        ascii_lower(F.regexp_extract(url, URL_PATTERN, 1)).alias("scheme"),
        F.regexp_extract(url, URL_PATTERN, 2).alias("netloc"),
        F.regexp_extract(url, URL_PATTERN, 3).alias("path"),
        F.regexp_extract(url, URL_PATTERN, 4).alias("query"),
        F.regexp_extract(url, URL_PATTERN, 5).alias("fragment"),
    )


def scheme(url: Column | str) -> Column:
    return url_parts(url)["scheme"]


def host(url: Column | str) -> Column:
    """The authority part, port and case kept."""
    return url_parts(url)["netloc"]


def path(url: Column | str) -> Column:
    return url_parts(url)["path"]


def _assemble(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    with_authority = (netloc != "") | (
        scheme.isin(*AUTHORITY_SCHEMES) & ~path.startswith("//")
    )
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    body = F.when(with_authority, F.concat(F.lit("//"), netloc, rooted)).otherwise(path)
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        body,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
        F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment)),
    )


def url_build(parts: Column) -> Column:
    """Inverse of :func:`url_parts`, with empty query and fragment left out."""
    return _assemble(*(parts[name] for name in ("scheme", "netloc", "path", "query", "fragment")))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` by name.

    Expressions are trees: naming a long one several times would repeat it in
    the plan and at run time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remove_dot_segments(path: Column | str) -> Column:
    """Resolve ``.`` and ``..``; popping at the root does nothing.

    Paths without a dot segment skip the fold.
    """

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.array_append(kept, segment))
        )

    def resolve(path: Column) -> Column:
        absolute = path.startswith("/")
        segments = F.split(F.regexp_replace(path, "^/", ""), "/")
        folded = F.aggregate(segments, F.array().cast("array<string>"), step)
        trailing = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        resolved = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.concat(folded, trailing), "/"))
        return F.when(path.rlike(DOT_SEGMENT), resolved).otherwise(path)

    return _bind(_column(path), resolve)


def url_join(base: Column | str, reference: Column | str) -> Column:
    """Resolve a reference; one that repeats the base scheme is still resolved as relative."""

    def resolve(v: Column) -> Column:
        base, reference, b, r = v["base"], v["reference"], v["b"], v["r"]
        after_scheme = F.when(r["scheme"] == "", reference).otherwise(
            F.substr(reference, F.length(r["scheme"]) + F.lit(2))
        )
        has_authority = after_scheme.startswith("//")
        folder = F.regexp_extract(b["path"], r"^([\s\S]*/)[^/]*\z", 1)
        merged = (
            F.when(has_authority | r["path"].startswith("/"), r["path"])
            .when((b["netloc"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"]))
            .otherwise(F.concat(folder, r["path"]))
        )
        keeps_path = ~has_authority & (r["path"] == "")
        target = F.struct(
            b["scheme"].alias("scheme"),
            F.when(has_authority, r["netloc"]).otherwise(b["netloc"]).alias("netloc"),
            F.when(keeps_path, b["path"]).otherwise(remove_dot_segments(merged)).alias("path"),
            F.when(keeps_path & (r["query"] == ""), b["query"]).otherwise(r["query"]).alias("query"),
            r["fragment"].alias("fragment"),
        )
        return (
            F.when(base == "", reference)
            .when(reference == "", base)
            .when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), reference)
            .otherwise(_bind(target, url_build))
        )

    base, reference = _column(base), _column(reference)
    bound = F.struct(
        base.alias("base"),
        reference.alias("reference"),
        url_parts(base).alias("b"),
        url_parts(reference).alias("r"),
    )
    return F.when(base.isNotNull() & reference.isNotNull(), _bind(bound, resolve))


def url_defrag(url: Column | str) -> Column:
    """struct<url, fragment>, cut at the first ``#``."""
    url = _column(url)
    return F.struct(
        F.substring_index(url, "#", 1).alias("url"),
        F.regexp_extract(url, r"#([\s\S]*)\z", 1).alias("fragment"),
    )


def canonical_url(url: Column | str, keep_query: bool = False) -> Column:
    """The page identity: no fragment, no query, single slashes, no trailing slash."""
    parts = url_parts(F.substring_index(_column(url), "#", 1))
    single = F.regexp_replace(parts["path"], "/+", "/")
    trimmed = F.when(single.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(single, r"/\z", ""))
    query = parts["query"] if keep_query else F.lit("")
    return _assemble(parts["scheme"], parts["netloc"], trimmed, query, F.lit(""))


def in_scope(url: Column | str, base: Column | str) -> Column:
    """Same host, http or https, and at or below the base path on a ``/`` boundary."""
    target, root = url_parts(url), url_parts(base)
    base_path = F.regexp_replace(root["path"], r"/+\z", "")
    return (
        target["scheme"].isin("http", "https")
        & (target["netloc"] == root["netloc"])
        & (
            (base_path == "")
            | (target["path"] == base_path)
            | F.startswith(target["path"], F.concat(base_path, F.lit("/")))
        )
    )


def candidate_urls(base: Column | str, file: str) -> Column:
    """Where a well-known file may live: below the base first, then at the host root."""
    base = _column(base)
    parts = url_parts(base)
    below = F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/" + file))
    root = F.concat(parts["scheme"], F.lit("://"), parts["netloc"], F.lit("/" + file))
    return F.array_distinct(F.array(below, root))
