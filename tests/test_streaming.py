"""Earliest captures from a stream: shuffled arrival gives the rows of the batch form, and the state does not grow."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quireflow.functions.url import canonical_url
from quireflow.operators.discovery import incremental_capture
from quireflow.streaming.capture import capture_stream

SCHEMA = "url string, pos long, seen timestamp, note string"
DAY = datetime(2024, 1, 1, tzinfo=UTC)


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, folder, files=None):
    query = capture_stream(spark, f"{folder}/feed", _schema(spark), f"{folder}/pages", f"{folder}/state", "seen", "1 days", files)
    query.awaitTermination()
    return query


def _schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [
        (f"http://{rng.choice('ab')}.org/p{rng.randrange(12)}{rng.choice(['', '/', '?q=1', '#x'])}", n, DAY + timedelta(seconds=rng.randrange(70_000)), f"n{n}")
        for n in range(150)
    ]
    rows.append((None, 900, DAY, None))
    rng.shuffle(rows)
    for part in range(3):
        _arrive(spark, f"{tmp_path}/feed", rows[part::3])
    _run(spark, tmp_path, 1)
    end = [("http://end.invalid/", 0, DAY + timedelta(days=9), "end")]
    _arrive(spark, f"{tmp_path}/feed", [*end, ("http://a.org/none", 7, None, "no time")])
    query = _run(spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/pages").filter("url IS NOT NULL")
    feed = spark.createDataFrame(rows, SCHEMA).filter("url IS NOT NULL")
    crawl = feed.select(
        F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1).alias("site"), canonical_url("url").alias("url"), F.col("seen").alias("pos"), F.col("pos").alias("n"), "note"
    )
    nothing = crawl.select("site", "url").filter("false")
    first = incremental_capture(crawl, nothing, nothing.withColumn("landed", F.lit("")))
    ours = sorted(map(tuple, got.select("site", "url", "seen", "pos", "note").collect()))
    assert ours == sorted(map(tuple, first.select("site", "url", "pos", "n", "note").collect())) and len(ours) > 10
    # nine days on, all but the closing record are forgotten
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_an_address_is_given_once_until_it_is_forgotten(spark, tmp_path):
    page = "http://a.org/x"

    def at(days, note, url=page):
        return (url, 1, DAY + timedelta(days=days), note)

    steps = [
        [at(0.2, "second"), at(0.1, "first")],
        [at(0.9, "again"), at(1.5, "clock", "http://b.org/")],
        [at(2.0, "again, kept in mind"), at(4.4, "clock 2", "http://b.org/2")],
        [at(9.0, "new"), at(14.0, "clock 3", "http://b.org/3")],
        [at(30.0, "clock 4", "http://b.org/4")],
    ]
    for rows in steps:
        _arrive(spark, f"{tmp_path}/feed", rows)
        _run(spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/pages").filter(F.col("url") == page).orderBy("seen").collect()
    assert [r.note for r in got] == ["first", "new"]
