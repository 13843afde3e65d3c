"""Registration of queries and of the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def add(build: QueryFunction) -> QueryFunction:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, where a scan comes in fewer pieces than there are cores.

    The test tables are one row group each, so their scan is one task; a large
    table has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


@dataclass(frozen=True)
class Source:
    """Columns derived from a test table, written in SQL that both engines read alike."""

    table: str
    columns: tuple[str, ...]

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, self.table).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.columns)} FROM {self.table})"


def scalar_query(key: str, source: Source, keep: tuple[str, ...], columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Register a projection: key columns plus pairs of (function giving the Spark column, SQL text)."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        computed = [column().alias(name) for name, (column, _) in columns.items()]
        return source.frame(spark, folder).select(*keep, *computed)

    build.__name__ = key
    projection = ", ".join([*keep, *(f"{sql} AS {name}" for name, (_, sql) in columns.items())])
    query(key, f"SELECT {projection} FROM {source.sql}")(build)


def lit(text: str) -> str:
    """A SQL string literal, control characters spelled with chr()."""
    parts: list[str] = []
    plain = ""
    for character in text:
        if ord(character) < 32:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(character)})")
        else:
            plain += character
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"

