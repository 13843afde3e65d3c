"""The registered queries, each with the SQL that checks it."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

FAMILIES = ("scalars", "trees", "rewrites", "coverage", "sites", "books")


def load() -> tuple[dict, dict]:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return QUERIES, ORACLES
