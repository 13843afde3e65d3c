"""Chat formatting from event logs. Built-in functions only.

A log row is an event of a conversation: `delta` adds text to a message, `edit`
replaces its text, `regenerate` empties it for the deltas that follow. Logs are
partitioned by conversation and ordered by sequence; messages are folded as:
what counts of a message is its last edit or regeneration and the deltas after
it. Messages stand in the order of their number and are rendered as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Control strings inside texts and roles are escaped: `\\` becomes `\\s`, then `<|`
becomes `<\\p`; in roles a line feed becomes `\\n`. Every backslash of an escaped
text begins one of these codes, so the three replacements can be undone in turn.

Defined results: null text is empty; null role is an empty role; a message with
no event but a regeneration is empty; events that share a sequence number are
taken in the order of kind and text; a null conversation id is a conversation of
its own; an empty log gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Code points of a text that one delta of a derived log carries.
DELTA = 512


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(text, "\\", "\\s"), "<|", "<\\p")


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\p", "|"), "\\n", "\n"), "\\s", "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of logs (conv_id, seq, kind, message, role, text)."""
    order = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text")
    resets = F.sum(F.when(F.col("kind").isin("edit", "regenerate"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = events.withColumn("text", F.when(F.col("kind") != "regenerate", F.col("text"))).withColumn("life", resets)
    lives = numbered.groupBy("conv_id", "message", "life").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))), lambda e: e["text"]
            ),
            "",
        ).alias("text"),
        F.max_by("role", F.struct("seq", "kind")).alias("role"),
    )
    return lives.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", "life"), F.lit("")).alias("role"), F.max_by("text", "life").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one text per conversation, and the spans of assistant text in it.

    A span is (start, length) in code points, 0 the first.
    """
    head = F.concat(F.lit(OPEN), _replace(escape(F.col("role")), "\n", "\\n"), F.lit("\n"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    pieces = pieces.withColumn("span", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))))
    rows = F.array_sort(F.collect_list(F.struct("message", "piece", "span")))
    return pieces.groupBy("conv_id").agg(rows.alias("m")).select(
        "conv_id",
        F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("m", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a rendered text holds."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 2 - len(CLOSE))).alias("text"),
        ),
    )


def log_of(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """An event log that streams each stored row as one message, in deltas.

    Rows are numbered by turn; rows that share a turn stand in the order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order))
    text = F.coalesce("text", F.lit(""))
    chunks = F.greatest(F.ceil(F.length(text) / delta), F.lit(1)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), chunks - 1))
    return rows.select("conv_id", "message", "role", "text", piece.alias("k")).select(
        "conv_id", (F.col("message") * F.lit(1 << 32) + F.col("k")).alias("seq"), F.lit("delta").alias("kind"), "message", "role",
        F.substring(text, F.col("k") * delta + 1, F.lit(delta)).alias("text"),
    )


def digest(rendered: DataFrame) -> DataFrame:
    """What reading the rendered texts back gives, as lengths and SHA-256 digests."""
    turns = rendered.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
