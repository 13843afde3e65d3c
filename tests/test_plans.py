"""Positions against brute force, and what the plans of registered queries may cost."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quireflow.catalog import load
from quireflow.operators import windows

FOLDER = "/root/testdata/sf0.001"


def _rows():
    rng = random.Random(11)
    # one key has most rows; order values repeat and may be null
    return [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.choice([None, *range(40)]), f"u{n}", rng.randint(0, 9)) for n in range(900)]


def _ranked(rows):
    return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_of_any_order(spark, coalesce):
    rows = _rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        table = spark.createDataFrame(rows, "k string, o int, u string, size int").repartition(5)
        got = windows.ordinals(table, ["k"], "o", "u", name="n").collect()
        sums = windows.prefix_sums(table, ["k"], ["o", F.col("u")], F.col("size"), "before").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    numbers, before, expected, offsets = {}, {}, {}, {}
    for r in _ranked(rows):
        numbers[r[0]] = expected[r[2]] = numbers.get(r[0], 0) + 1
        offsets[r[2]] = before.get(r[0], 0)
        before[r[0]] = offsets[r[2]] + r[3]
    assert {r.u: r.n for r in got} == expected
    assert {r.u: r.before for r in sums} == offsets
    assert windows.ordinals(table.filter("false"), ["k"], "o").count() == 0


def test_a_long_key_lies_in_several_tasks(spark):
    table = spark.range(20_000).select(F.lit("one").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = windows.ordinals(table, ["k"], -F.col("id"))
        assert ranged.select(F.max("ordinal"), F.sum((F.col("ordinal") + F.col("id") != 20_000).cast("int"))).first()[:] == (20_000, 0)
        sizes = table.repartitionByRange("k", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 6000


def _plan(spark, key):
    return load()[0][key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("key", "most"), [("m03_chapters", 4), ("m05_toc", 4), ("m06_manifest", 6), ("m07_spine", 4), ("m09_book_summary", 4)])
def test_book_tables_scan_stored_tables_few_times(spark, key, most):
    assert 0 < len(re.findall(r"Scan (?:ExistingRDD|parquet)|FileScan", _plan(spark, key))) <= most


@pytest.mark.parametrize("key", ["j05_resolve_links", "d16_rewrite_links", "j07_prune_fragments"])
def test_link_plans_do_not_repeat_the_resolution(spark, key):
    assert len(_plan(spark, key)) < 200_000
