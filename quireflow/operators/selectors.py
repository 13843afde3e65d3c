"""Selector strings over node tables.

The strings users know from style sheets, in the part that finding a content root or a
navigation needs: a tag or ``*``, ``#id``, ``.class``, ``[name]``, ``[name=value]`` with the
operators ``= ~= |= ^= $= *=`` and the flag ``i`` (or ``s``), several of these together, steps
separated by spaces (anywhere below), and alternatives separated by commas.

A step is a condition on a node and, from the second step on, on a running window: some
earlier match of the step before is still open here. So a selector of k steps is k
columns over the page in document order, whatever the nesting; nodes are never
paired and nothing is shuffled.

Tags and attribute names are compared in lower case, values as they are unless
flagged ``i`` (ASCII letters). ``~=``, ``^=``, ``$=`` and ``*=`` with an empty value match nothing, nor does
``~=`` with white space in it. Anything else raises ``SelectorError`` and names what is not understood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from . import tree as t

_NAME = r"-?[A-Za-z_\u0080-\U0010FFFF][\w\u0080-\U0010FFFF-]*"
_PIECE = re.compile(
    rf"""(?P<tag>\*|{_NAME})
    | \#(?P<id>[\w\u0080-\U0010FFFF-]+)
    | \.(?P<class>{_NAME})
    | \[\s*(?P<name>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>{_NAME}))(?:\s*(?P<flag>[iIsS]))?\s*)?\]""",
    re.VERBOSE,
)
_UNKNOWN = {
    ">": "the child combinator", "+": "the next-sibling combinator", "~": "the sibling combinator",
    ":": "a pseudo-class or pseudo-element", "[": "an attribute test", "#": "an id", ".": "a class", "\\": "an escape", "|": "a namespace",
}
_WHITE = " \t\n\r\f"


class SelectorError(ValueError):
    """A selector string outside the supported grammar."""


@dataclass(frozen=True)
class Test:
    """One condition on a node: kind is tag, id, class, or an attribute operator (empty for presence)."""

    kind: str
    name: str
    value: str = ""
    fold: bool = False

    def column(self) -> Column:
        if self.kind == "tag":
            return F.col("tag") == self.name
        have = t.attr(self.name)
        if self.kind == "":
            return t.has_attr(self.name)
        wanted = self.value
        if self.fold:
            have, wanted = ascii_lower(have), "".join(c.lower() if c.isascii() else c for c in wanted)
        if self.kind == "=":
            return have == wanted
        if self.kind == "|=":
            return (have == wanted) | have.startswith(f"{wanted}-")
        if not wanted or (self.kind == "~=" and set(wanted) & set(_WHITE)):
            return F.lit(False)
        if self.kind == "~=":
            return F.array_contains(F.split(have, f"[{_WHITE}]+"), wanted)
        return {"^=": have.startswith, "$=": have.endswith, "*=": have.contains}[self.kind](wanted)


#: Tests of one node, all of which must hold; empty for ``*``.
Step = tuple[Test, ...]


def _step(text: str, at: int) -> tuple[Step, int]:
    """The step that begins at a position, and where it ends."""
    tests: list[Test] = []
    start = at
    while found := _PIECE.match(text, at):
        part = found.groupdict()
        if part["tag"]:
            if at != start:
                raise SelectorError(f"{text!r}: a tag must come first in its step, at {at}")
            if part["tag"] != "*":
                tests.append(Test("tag", part["tag"].lower()))
        elif part["id"]:
            tests.append(Test("=", "id", part["id"]))
        elif part["class"]:
            tests.append(Test("~=", "class", part["class"]))
        else:
            value = next((part[k] for k in ("double", "single", "bare") if part[k] is not None), "")
            tests.append(Test(part["op"] or "", part["name"].lower(), value, (part["flag"] or "s").lower() == "i"))
        at = found.end()
    if at == start:
        what = _UNKNOWN.get(text[at : at + 1], "the end of the string" if at == len(text) else f"the character {text[at]!r}")
        raise SelectorError(f"{text!r}: {what} is not supported here, at {at}")
    return tuple(tests), at


def parse(text: str) -> list[list[Step]]:
    """Alternatives of a selector string, each a list of steps from the outermost in."""
    alternatives: list[list[Step]] = [[]]
    at = len(text) - len(text.lstrip(_WHITE))
    while True:
        step, at = _step(text, at)
        alternatives[-1].append(step)
        rest = text[at:].lstrip(_WHITE)
        spaced, at = len(rest) < len(text) - at, len(text) - len(rest)
        if not rest:
            return alternatives
        if rest[0] == ",":
            alternatives.append([])
            at = len(text) - len(rest[1:].lstrip(_WHITE))
        elif not spaced:
            _step(text, at)


def mark(nodes: DataFrame, selector: str, name: str) -> DataFrame:
    """Add whether each node matches a selector string, as column ``name``."""
    made: list[str] = []
    last: list[Column] = []
    for a, steps in enumerate(parse(selector)):
        for depth, step in enumerate(steps):
            matches = F.col("kind") == "element"
            for test in step:
                matches = matches & F.coalesce(test.column(), F.lit(False))
            if depth:
                matches = matches & t.inside(F.col(made[-1]))
            made.append(f"_{name}_{a}_{depth}")
            nodes = nodes.withColumn(made[-1], matches)
        last.append(F.col(made[-1]))
    any_of = last[0]
    for other in last[1:]:
        any_of = any_of | other
    return nodes.withColumn(name, any_of).drop(*made)


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that match a selector string."""
    return mark(nodes, selector, "_selected").filter("_selected").drop("_selected")


def marked(nodes: DataFrame, selectors: tuple[Column | str, ...]) -> tuple[DataFrame, list[Column], list[str]]:
    """Selector strings as columns of the nodes; predicates stay. Also the names of the columns added."""
    added: list[str] = []
    predicates: list[Column] = []
    for n, selector in enumerate(selectors):
        if isinstance(selector, str):
            added.append(f"_selector_{n}")
            nodes = mark(nodes, selector, added[-1])
            predicates.append(F.col(added[-1]))
        else:
            predicates.append(selector)
    return nodes, predicates, added
