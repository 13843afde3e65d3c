"""Incremental capture over an unbounded feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.url import canonical_url

HORIZON = "7 days"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Earliest(StatefulProcessor):
    """Keeps the earliest record of a key and gives it out when no earlier one can come.

    The state is one record with two times. Its only timer first waits for the watermark to
    pass the record; after the record is out it waits until the watermark is a horizon
    past the key's last sighting, and then the state goes.
    """

    def __init__(self, horizon_ms: int) -> None:
        self._horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getValueState("earliest", "micros long, record string, last_ms long, given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._kept.get() if self._kept.exists() else None
        best, last, given = ((known[0], known[1]), known[2], known[3]) if known else (None, 0, False)
        for frame in rows:
            last = max(last, int(frame["micros"].max()) // 1000)
            if not given:
                first = frame.sort_values(["micros", "record"]).iloc[0]
                here = (int(first["micros"]), str(first["record"]))
                best = here if best is None else min(best, here)
        if known is None:
            self._handle.registerTimer(best[0] // 1000 + 1)
        self._kept.update((best[0], best[1], last, given))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        micros, record, last, given = self._kept.get()
        if not given:
            yield pd.DataFrame({"record": [record]})
        forget = last + self._horizon_ms
        if forget > timerValues.getCurrentWatermarkInMs():
            self._kept.update((micros, record, last, True))
            self._handle.registerTimer(forget)
        else:
            self._kept.clear()

    def close(self) -> None:
        pass


def first_captures(feed: DataFrame, event_time: str | None = None, horizon: str = HORIZON) -> DataFrame:
    """The first capture of each (site, canonical URL), whatever the order of arrival.

    With an event time, records may come up to ``horizon`` late. A URL's earliest record is
    given out once, when the watermark has passed it; of equal times the least
    record in JSON form. A URL that was not seen for a horizon before the watermark is forgotten,
    so the state holds the URLs of about two horizons; seen again later it is a new one.
    Records without an event time cannot be placed and are left out.

    Without an event time the first to arrive is kept, and the state grows with the
    number of distinct URLs.
    """
    keyed = feed.withColumn("url", canonical_url("url"))
    if not event_time:
        return keyed.dropDuplicates(["site", "url"])
    spark = feed.sparkSession
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    # the stateful step sees three plain columns, whatever the feed has
    record = F.to_json(F.struct(*keyed.columns), {"ignoreNullFields": "false"}).alias("record")
    timed = keyed.filter(F.col(event_time).isNotNull()).withWatermark(event_time, horizon)
    plain = timed.select(F.coalesce("site", F.lit("")).alias("site"), F.coalesce("url", F.lit("")).alias("url"), event_time, F.unix_micros(event_time).alias("micros"), record)
    horizon_ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {horizon}) AS ms").first()["ms"]
    given = plain.groupBy("site", "url").transformWithStateInPandas(
        statefulProcessor=_Earliest(horizon_ms), outputStructType="record string", outputMode="Append", timeMode="EventTime"
    )
    return given.select(F.from_json("record", keyed.schema).alias("r")).select("r.*")


def capture_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    event_time: str | None = None,
    horizon: str = HORIZON,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Read page captures as files arrive and append each page once to a Parquet table.

    Offsets, state and output live under shared folders, so a lost executor or a
    restarted driver goes on where the query stopped.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    feed = reader.parquet(source)
    if "site" not in feed.columns:
        feed = feed.withColumn("site", F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1))
    return (
        first_captures(feed, event_time, horizon)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
