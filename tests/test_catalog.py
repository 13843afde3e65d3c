"""Every registered query against its SQL on the smallest test tables."""

import os
from pathlib import Path

import pytest

import compare
from quireflow.catalog import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_but_the_whole_build_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"q02_build_chapters"}


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, con, key):
    problem = compare.compare(spark, con, FOLDER, key, QUERIES[key], ORACLES.get(key))
    assert problem is None, problem
