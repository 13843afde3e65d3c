"""Main text of web pages by union-free wrappers of each host.

A wrapper describes the pages of a host as a tree of tags in which siblings may
be optional or repeated and texts are constant or slots: a union-free regular
expression over the token stream. It is inferred step by step: a page is a
wrapper whose texts are all constant; two wrappers are aligned from the root,
siblings in order by their labels. Where both have a label they are aligned in
turn; where only one has it, it becomes optional; equal neighbours become one
repeated group; different texts become a slot.

Alignment needs wrappers only, so it is folded like a sum: in each task over the
pages it reads, then by salted host, then by host. What is shuffled is one small
tree for each host and task; a host with a third of all pages is split.

The wrapper of a host tells where its main text stands: in the content elements
that its pages have (article, main), else everywhere but where the texts are
constant over clearly different pages. Two pages are clearly different if they
share less than half of their word triples; so what near copies share is text, not
template. A constant text carries the sketch of a page that has it until a clearly
different page agrees; a text that only one page has stays. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out by element and
by the words of class, id and role. A page without the host's content element is
read like a page of a host that has none.

A page costs time in proportion to its length: elements nested deeper than `DEPTH`
levels stand at that level (what tells main text from the rest is kept of them),
a tag that is not closed ends at the next one, and lists of siblings too long for
the table of the longest common subsequence are aligned by the nearest equal label.

Defined results: null html gives an empty text; a page without main text gives an
empty text; broken markup is read by the usual forgiving rules (void elements,
implied ends, missing ends); a null or odd url belongs to the host of its own
leading part; repeated rows are read alike, and a text is template only if at
least two clearly different pages agree on it; other columns are not read.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Hosts up to which their wrappers are broadcast; beyond, pages meet them by salted host.
BROADCAST_HOSTS = 50_000
SALTS = 16

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hgroup".split()
)
CLOSES_P = BLOCK - {"html", "body"} | {"hr"}
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th body html article section div main aside nav header footer blockquote form".split())
HEAD_PARTS = frozenset("base basefont bgsound link meta title style script noscript template head".split())
# Elements and names that are never main text.
OUTSIDE = frozenset("nav footer aside form button select option input label dialog menu head object canvas audio video".split()) | RAW
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination footer sidebar aside widget ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup login popup modal overlay related recommended share sharing social comment comments reply replies respond discussion "
    "disqus search toolbar skip toc".split()
)
HEADERS = frozenset(("header", "masthead", "topbar"))
CONTENT = frozenset(("article", "main"))
#: Levels of a page's tree.
DEPTH = 100
#: Pairs of siblings up to which the longest common subsequence is looked for.
TABLE_CELLS = 250_000
#: Hashes in a page's sketch; a page of no more word triples is compared exactly.
SKETCH = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|(?P<text>[^<]+|<)", re.S
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I | re.S)


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(labels from the root, text) of each text block of a page, in order.

    A label is a block element's name, with the words of its class, id and role.
    """
    # of each open element its tag, and the labels down to it
    path: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter[str] = Counter()
    held: list[str] = []

    def flush() -> tuple[tuple[str, ...], str] | None:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        return (path[-1][1] if path else (), text) if text else None

    def push(tag: str, words: set[str]) -> None:
        above, label = path[-1][1] if path else (), " ".join([tag, *sorted(words)])
        if len(path) < DEPTH:
            above = (*above, label)
        elif _tells(tag, words) and label not in above[DEPTH:]:
            above = (*above, label) if len(above) < 2 * DEPTH else (*above[:-1], label)
        path.append((tag, above))
        open_[tag] += 1

    def close(index: int) -> None:
        open_.subtract(tag for tag, _ in path[index:])
        del path[index:]

    def end_head() -> None:
        # nothing stays open in a head, so it is the last; only white space is held in it
        if path and path[-1][0] == "head":
            held.clear()
            close(len(path) - 1)

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        if token is None:
            end_head()
            held.append(page[at])
            at += 1
            continue
        at = token.end()
        if token["text"] is not None:
            if token["text"].strip(" \t\n\r\f"):
                end_head()
            held.append(token["text"])
            continue
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if token["end"]:
            if tag in BLOCK:
                if found := flush():
                    yield found
                for i in range(len(path) - 1, -1, -1) if open_[tag] else ():
                    if path[i][0] == tag:
                        close(i)
                        break
            elif tag in OUTSIDE:
                if found := flush():
                    yield found
                for i in range(len(path) - 1, -1, -1) if open_[tag] else ():
                    if path[i][0] == tag:
                        close(i)
                        break
            continue
        if tag not in HEAD_PARTS:
            end_head()
        elif tag == "head" and any(name != "html" for name, _ in path[:2]):
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            if not token["rest"].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr" and (found := flush()):
                yield found
            continue
        if tag not in BLOCK and tag not in OUTSIDE:
            names = _words(token["rest"]) if token["rest"] else ()
            if not NAMES.intersection(names):
                continue
        if found := flush():
            yield found
        if tag in CLOSES_P:
            for i in range(len(path) - 1, -1, -1) if open_["p"] else ():
                if path[i][0] == "p":
                    close(i)
                    break
                if path[i][0] in SCOPE:
                    break
        if tag in SAME_KIND:
            for i in range(len(path) - 1, -1, -1) if any(open_[x] for x in SAME_KIND[tag]) else ():
                if path[i][0] in SAME_KIND[tag]:
                    close(i)
                    break
                if path[i][0] in SCOPE - {"td", "th"}:
                    break
        push(tag, _words(token["rest"]))
        if tag not in BLOCK and tag not in OUTSIDE:
            # a named inline element: its text is apart, up to its end
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            held.append(re.sub(r"<[^>]*>", "", page[at : end.start() if end else size]))
            at = end.end() if end else size
            if found := flush():
                yield found
            close(len(path) - 1)
    if found := flush():
        yield found


def _tells(tag: str, words: set[str]) -> bool:
    """Whether an element says something about what is main text."""
    return tag in OUTSIDE or tag in HEADERS or tag in CONTENT or "main" in words or not words.isdisjoint(NAMES | HEADERS)


def _words(rest: str) -> set[str]:
    return {w for _, value in _NAMES.findall(rest) for w in re.split(r"[^a-z0-9]+", value.strip("\"'").lower()) if w}


# A wrapper node: {"l": label, "o": optional, "r": repeated, "c": [children]}; a slot: {"t": null}; a constant text:
# {"t": text, "s": the sketch of a page that has it, or null once clearly different pages agree}.


def _leaf(text: str | None, sketch: list[int] | None = None) -> dict:
    return {"t": None} if text is None else {"t": text, "s": sketch}


def sketch(found: list[tuple[tuple[str, ...], str]]) -> list[int]:
    """The least hashes of a page's word triples; none for a page with a content element, whose host needs no constant texts."""
    shown = [(labels, text) for labels, text in found if not _is_outside(labels)]
    if any(_in_content(labels) for labels, _ in shown):
        return []
    words = " ".join(text for _, text in shown).split()
    return nsmallest(SKETCH, {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(len(words) - 2, 1))})


def _clearly_different(a: list[int], b: list[int]) -> bool:
    """Whether pages of these sketches share less than half of their word triples."""
    least = nsmallest(SKETCH, {*a, *b})
    return 2 * len({*a}.intersection(b, least)) < len(least)


def page_wrapper(found: list[tuple[tuple[str, ...], str]]) -> dict:
    """The wrapper of one page: its blocks as a tree, equal neighbours folded into repeated groups."""
    root: dict = {"l": "", "o": False, "r": False, "c": []}
    own = sketch(found)
    stack = [root]
    before: tuple[str, ...] = ()
    for labels, text in found:
        shared = 0
        while shared < min(len(labels), len(before)) and labels[shared] == before[shared]:
            shared += 1
        if shared == len(labels) == len(before) and shared:
            shared -= 1  # the same labels again: another element of that kind
        del stack[shared + 1 :]
        for label in labels[shared:]:
            node = {"l": label, "o": False, "r": False, "c": []}
            stack[-1]["c"].append(node)
            stack.append(node)
        stack[-1]["c"].append(_leaf(text, own))
        before = labels
    _fold_repeats(root)
    return root


def _label(node: dict) -> str:
    return node.get("l", "#text")


def _fold_repeats(node: dict) -> None:
    folded: list[dict] = []
    for child in node["c"]:
        if "c" in child:
            _fold_repeats(child)
        if folded and _label(folded[-1]) == _label(child):
            folded[-1] = align(folded[-1], child)
            if "c" in child:
                folded[-1]["r"] = True
        else:
            folded.append(child)
    node["c"] = folded


def _pairs(rows: list[str], columns: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """The places of two lists of labels side by side, in order; equal labels together as far as they can be."""
    first = 0
    while first < min(len(rows), len(columns)) and rows[first] == columns[first]:
        yield first, first
        first += 1
    last = 0
    while last < min(len(rows), len(columns)) - first and rows[-1 - last] == columns[-1 - last]:
        last += 1
    i, j, m, n = first, first, len(rows) - last, len(columns) - last
    if (m - i) * (n - j) <= TABLE_CELLS:
        best = [[0] * (n - j + 1) for _ in range(m - i + 1)]
        for x in range(m - 1, i - 1, -1):
            here, below = best[x - first], best[x - first + 1]
            for y in range(n - 1, j - 1, -1):
                here[y - first] = below[y - first + 1] + 1 if rows[x] == columns[y] else max(below[y - first], here[y - first + 1])

        def left_first() -> bool:
            return best[i - first + 1][j - first] >= best[i - first][j - first + 1]
    else:
        where = [defaultdict(list), defaultdict(list)]
        for side, labels in zip(where, (rows, columns), strict=True):
            for at, label in enumerate(labels):
                side[label].append(at)

        def ahead(side: int, label: str, at: int, end: int) -> int:
            found = where[side][label]
            k = bisect_left(found, at)
            return found[k] - at if k < len(found) and found[k] < end else end

        def left_first() -> bool:
            # the left label is given up if the right one stands nearer on the left than it does on the right
            return ahead(0, columns[j], i, m) <= ahead(1, rows[i], j, n)
    while i < m or j < n:
        if i < m and j < n and rows[i] == columns[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == n or (i < m and left_first()):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    for k in range(last):
        yield m + k, n + k


def align(a: dict, b: dict) -> dict:
    """The wrapper of all that either describes; both have the same label."""
    if "c" not in a:
        if a["t"] is None or a["t"] != b["t"]:
            return _leaf(None)
        shared = a["s"] is None or b["s"] is None or _clearly_different(a["s"], b["s"])
        return _leaf(a["t"], None if shared else min(a["s"], b["s"]))
    left, right = a["c"], b["c"]
    rows, columns = [_label(x) for x in left], [_label(x) for x in right]
    children: list[dict] = []
    if rows == columns:
        children = [align(x, y) for x, y in zip(left, right, strict=True)]
    else:
        for i, j in _pairs(rows, columns):
            if i is not None and j is not None:
                children.append(align(left[i], right[j]))
            else:
                child = left[i] if i is not None else right[j]
                children.append(child | {"o": True} if "c" in child else _leaf(None))
        merged: list[dict] = []
        for child in children:
            if merged and _label(merged[-1]) == _label(child):
                merged[-1] = align(merged[-1], child)
                if "c" in child:
                    merged[-1]["r"] = True
            else:
                merged.append(child)
        children = merged
    return {"l": a["l"], "o": a["o"] or b["o"], "r": a["r"] or b["r"], "c": children}


def _is_outside(labels: tuple[str, ...]) -> bool:
    content = False
    for label in labels:
        tag, *names = label.split(" ")
        if tag in OUTSIDE or NAMES.intersection(names):
            return True
        if not content and (tag in HEADERS or HEADERS.intersection(names)):
            return True
        content |= tag in CONTENT or "main" in names
    return False


def _in_content(labels: tuple[str, ...]) -> bool:
    return any(label.split(" ")[0] in CONTENT or label == "div main" for label in labels)


def decide(wrapper: dict) -> dict:
    """What extraction needs of a wrapper: whether there is a content element, and the constant texts."""
    constant: list[str] = []
    content = False

    def walk(node: dict, labels: tuple[str, ...]) -> None:
        nonlocal content
        for child in node["c"]:
            if "c" in child:
                walk(child, (*labels, child["l"]))
            elif not _is_outside(labels):
                content |= _in_content(labels)
                if child["t"] is not None and child["s"] is None:
                    constant.append("\n".join(labels) + "\n" + child["t"])
    walk(wrapper, ())
    return {"content": content, "constant": [] if content else constant}


def main_text(page: str | None, decision: dict) -> str:
    found = [(labels, text) for labels, text in blocks(page or "") if not _is_outside(labels)]
    inside = [text for labels, text in found if _in_content(labels)] if decision["content"] else []
    if not inside:
        constant = set(decision["constant"])
        inside = [text for labels, text in found if "\n".join(labels) + "\n" + text not in constant]
    return "\n\n".join(inside)


def host(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; empty for a null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _summed(parts: Iterator[tuple[str, dict]]) -> dict[str, dict]:
    """The wrapper of each host."""
    total: dict[str, dict] = {}
    for name, wrapper in parts:
        total[name] = align(total[name], wrapper) if name in total else wrapper
    return total


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, decision): JSON of what each host's wrapper decides."""
    schema = "host string, wrapper string"

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = ((h, page_wrapper(list(blocks(p or "")))) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield _table(_summed(parts)).to_batches()[0]

    def of_parts(table: pa.Table) -> pa.Table:
        rows = table.select(["host", "wrapper"]).to_pylist()
        return _table(_summed((r["host"], json.loads(r["wrapper"])) for r in rows))

    def _table(total: dict[str, dict]) -> pa.Table:
        return pa.table({"host": pa.array(list(total), pa.string()), "wrapper": pa.array([json.dumps(v) for v in total.values()], pa.string())})

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [json.dumps(decide(json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string())], ["host", "decision"])

    parts = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(of_pages, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInArrow(of_parts, schema)
    return salted.groupBy("host").applyInArrow(of_parts, schema).mapInArrow(settled, "host string, decision string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    known = cut_lineage(wrappers(pages))
    given = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if known.count() <= BROADCAST_HOSTS:
        joined = given.join(F.broadcast(known), "host", "left")
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = given.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decisions: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, decision in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if decision not in decisions:
                    if len(decisions) > 10_000:
                        decisions.clear()
                    decisions[decision] = json.loads(decision)
                texts.append(main_text(page.as_py(), decisions[decision]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = given.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "decision").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
