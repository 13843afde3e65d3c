"""Ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tree as t

FENCE = "```"


def first_wins(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Keep the first row of each key in source order.

    Written as a grouped minimum so that copies collapse before the shuffle: a
    key that holds a third of all rows sends one row per task.
    """
    rest = [name for name in df.columns if name not in keys]
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    row = F.struct(
        F.struct(*(column.alias(f"o{n}") for n, column in enumerate(ranked))).alias("_order"), *rest
    )
    return df.groupBy(*keys).agg(F.min_by(row, row["_order"]).alias("_row")).select(*keys, *(F.col(f"_row.{c}") for c in rest))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 10) -> DataFrame:
    """At most ``n`` rows per key, best first; Spark prunes each task to ``n`` per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def fence_state(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Add ``is_fence`` and ``in_code``: each fence line of a text toggles the state.

    A text is one captured string, so its lines are a bounded group.
    """
    from ..functions.text import strip_ws

    running = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("is_fence", strip_ws(line).startswith(FENCE))
    return marked.withColumn("in_code", F.sum(F.col("is_fence").cast("long")).over(running) % 2 == 1)


def token_depth(tokens: DataFrame) -> DataFrame:
    """Add ``depth``: openings minus closings so far."""
    running = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    return tokens.withColumn("depth", F.sum(step).over(running))


def first_row(nodes: DataFrame) -> DataFrame:
    """Tables with the ``open_seq`` of their first row."""
    found = nodes.withColumn("first_row", t.next_match(F.col("tag") == "tr"))
    return found.filter((F.col("tag") == "table") & (F.col("first_row") < F.col("close_seq")))


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column | str], size: Column, name: str) -> DataFrame:
    """Add the total ``size`` of the earlier rows of the same key, for keys of any length and any order.

    Rows are range-partitioned by key and order, so a key that is long lies in several
    partitions one after the other. Each partition sums its own rows, and only one total
    for each (key, partition) is summed per key. The split is stored, so that both
    uses see the same one and nothing above it is computed again.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.withColumns({"_size": size, **{f"_o{n}": column for n, column in enumerate(columns)}})
    by = [f"_o{n}" for n in range(len(columns))]
    ranged = cut_lineage(placed.repartitionByRange(*keys, *by).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_size").alias("_total"))
    earlier_parts = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(earlier_parts), F.lit(0))).drop("_total")
    earlier_rows = W.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("_within", F.coalesce(F.sum("_size").over(earlier_rows), F.lit(0)))
        .join(starts, [*keys, "_part"])
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_part", "_within", "_start", "_size", *by)
    )


def ordinals(df: DataFrame, keys: list[str], *order: Column | str, name: str = "ordinal") -> DataFrame:
    """1..n within each key in any order, without putting a whole key into one task; nulls come first."""
    return prefix_sums(df, keys, list(order), F.lit(1), name).withColumn(name, F.col(name) + 1)
