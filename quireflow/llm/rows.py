"""Keys of rows, for operators that take a table apart and put it together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asciiwords import bounded


def keyed(docs: DataFrame, *carry: str) -> DataFrame:
    """(key, tag, text[, row]) of documents.

    Key and tag name a row by its id and text, the same in every run, so rows
    that share an id but not a text stay apart and rows without an id have keys
    too. `row` is a struct of the carried columns; inside it no name can clash.
    """
    columns = [
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"),
        F.hash("text").alias("tag"),
        F.col("text"),
    ]
    if carry:
        columns.append(F.struct(*carry).alias("row"))
    return docs.select(*columns)


def single(keyed_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each keyed text once, and (key, tag) of those that occur more often.

    Copies are counted by their keys alone. Only texts that have copies are shuffled,
    after a copy or two of each are left in a task.
    """
    repeated = cut_lineage(keyed_docs.groupBy("key", "tag").count().filter("count > 1").select("key", "tag"))
    many = repeated.count()
    if not many:
        return keyed_docs.select("key", "tag", "text"), repeated
    known = bounded(repeated, many)
    once = keyed_docs.join(known, ["key", "tag"], "left_anti").select("key", "tag", "text")
    copies = keyed_docs.join(known, ["key", "tag"], "left_semi").groupBy("key", "tag").agg(F.min("text").alias("text"))
    return once.unionByName(copies), repeated
