"""Token and node table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree as t
from ..sources import markup
from . import inputs as i
from .registry import query, table

POS = lambda name: (F.col(name) / markup.SEQ_GAP).cast("long")
TOKENS_SQL = f"""(SELECT page_id, i - 1 AS pos, tok AS token,
  CASE WHEN starts_with(tok, '<!--') THEN 'comment' WHEN regexp_matches(tok, {i.RAW}) THEN 'raw' WHEN regexp_matches(tok, '^<[!?]') THEN 'declaration'
    WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind,
  lower(regexp_extract(tok, {i.NAME}, 1)) AS tag
  FROM (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {i.TOKENS}, 0) AS t FROM pages)))"""


@query("s07_tokens", f"SELECT page_id, pos, token, kind, tag FROM {TOKENS_SQL}")
def s07_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return markup.tokens(table(spark, folder, "pages"))


@query("a12_tag_counts", f"SELECT tag, count(*) AS n FROM {TOKENS_SQL} WHERE kind IN ('open', 'raw') GROUP BY tag")
def a12_tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    opened = markup.tokens(table(spark, folder, "pages")).filter(F.col("kind").isin("open", "raw"))
    return opened.groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "s06_parse_html",
    f"""WITH {i.nodes_sql(i.RICH_SQL)} SELECT page_id, pos, parent, depth, closed_at, kind, tag,
    array_to_string(list_transform(attrs, lambda a: a.name || '=' || a.value), '|') AS attrs, coalesce(text, '-') AS text FROM nodes""",
)
def s06_parse_html(spark: SparkSession, folder: str) -> DataFrame:
    closed_at = F.when(
        F.col("close_seq") == F.col("open_seq"), POS("open_seq")
    ).otherwise(F.ceil(F.col("close_seq") / markup.SEQ_GAP))
    return i.rich_nodes(spark, folder).select(
        "page_id",
        POS("open_seq").alias("pos"),
        F.coalesce(POS("parent_id"), F.lit(-1)).alias("parent"),
        F.col("depth").cast("long").alias("depth"),
        closed_at.cast("long").alias("closed_at"),
        "kind",
        "tag",
        F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|").alias("attrs"),
        F.coalesce("text", F.lit("-")).alias("text"),
    )
