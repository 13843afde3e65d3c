"""Source lines and text coverage. All documents are the source text of one corpus-wide site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.ids import chapter_name
from ..functions.url import path
from ..operators import tree as t
from ..operators.windows import fence_state, top_n
from ..plans import coverage as c
from ..session import cut_lineage, scratch_folder
from ..sources.sinks import write_coverage
from . import inputs as i
from . import oracle as o
from .registry import query, spread, table

LINE_SHAPES = """CASE (doc_id + line_no) % 13 WHEN 0 THEN concat('- ', line) WHEN 1 THEN concat('> > ', line) WHEN 2 THEN concat('3) ', line)
 WHEN 3 THEN CASE WHEN line_no % 2 = 0 THEN '```' ELSE line END WHEN 4 THEN concat('# ', line)
 WHEN 5 THEN concat('[', line, '](https://x.example/a) <b class="q"></b>') WHEN 6 THEN concat('  ', line, '  ')
 WHEN 7 THEN concat('![', line, '](i.png)') WHEN 8 THEN replace(line, 'e', 'E') ELSE line END"""
LINES_SQL = f"""lines AS MATERIALIZED (SELECT doc_id, line_no, {LINE_SHAPES} AS line FROM
  (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"""
STATE_SQL = f"""states AS MATERIALIZED (SELECT *, starts_with(trim(line, {o.WS}), '```') AS is_fence,
  sum(CASE WHEN starts_with(trim(line, {o.WS}), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS in_code FROM lines)"""
ELIGIBLE_SQL = f"""eligible AS MATERIALIZED (SELECT doc_id, line_no, line FROM states WHERE NOT is_fence AND NOT in_code AND strlen(trim(line, {o.WS})) >= 40
  AND NOT regexp_matches(trim(line, {o.WS}), '^(#|\\||!\\[|<)'))"""
SOURCE_SQL = f"""source AS MATERIALIZED (SELECT * FROM (SELECT doc_id, line_no, {o.words(o.strip_markdown(o.strip_bullet(f'trim(line, {o.WS})')))} AS line FROM eligible) WHERE line <> '')"""
CHAPTERS_SQL = f"""chapters AS (SELECT {o.chapter_name(o.part('n.url', 'path'), 'n.url')} || n.pos AS file, {o.words("coalesce(string_agg(d.text, '' ORDER BY d.pos), '')")} AS text
  FROM nodes n LEFT JOIN nodes d ON {i.below('n', 'd')} AND d.kind = 'text' WHERE n.tag = 'article' GROUP BY n.page_id, n.url, n.pos),
  book AS MATERIALIZED (SELECT string_agg(text, ' ' ORDER BY file) AS text FROM chapters)"""
PREPARED = f"WITH {i.nodes_sql(i.PLAIN_SQL, 'url')}, {LINES_SQL}, {STATE_SQL}, {ELIGIBLE_SQL}, {SOURCE_SQL}, {CHAPTERS_SQL}, missing AS MATERIALIZED (SELECT s.* FROM source s, book WHERE NOT contains(book.text, s.line))"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    split = c.split_lines(spread(table(spark, folder, "documents"), "doc_id"), "doc_id")
    return split.selectExpr("doc_id", "line_no", f"{LINE_SHAPES} AS line")


def source(spark: SparkSession, folder: str) -> DataFrame:
    found = c.source_lines(lines(spark, folder), "doc_id").withColumn("site", F.lit("corpus"))
    return cut_lineage(found)


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """One chapter per article, named by page and position."""
    nodes = i.nodes(spark, folder, "url")
    named = t.subtree_text(nodes, F.col("tag") == "article").join(
        i.pages(spark, folder).select("page_id", "url"), "page_id"
    )
    position = (F.col("node_id") / (1 << 32)).cast("long").cast("string")
    return named.select(
        F.lit("corpus").alias("site"),
        F.concat(chapter_name(path("url"), "url"), position).alias("file"),
        x.normalize_words("text").alias("text"),
    )


@query(
    "s04_source_lines",
    "SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)",
)
def s04(spark: SparkSession, folder: str) -> DataFrame:
    return c.split_lines(table(spark, folder, "documents"), "doc_id")


@query("t10_strip_bullet", f"WITH {LINES_SQL} SELECT doc_id, line_no, {o.strip_bullet('line')} AS line FROM lines")
def t10(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).withColumn("line", x.strip_bullet("line"))


@query("w05_fence_state", f"WITH {LINES_SQL}, {STATE_SQL} SELECT doc_id, line_no, is_fence, in_code FROM states")
def w05(spark: SparkSession, folder: str) -> DataFrame:
    return fence_state(lines(spark, folder), ["doc_id"]).drop("line")


@query("f09_eligible_lines", f"WITH {LINES_SQL}, {STATE_SQL}, {ELIGIBLE_SQL} SELECT doc_id, line_no, line FROM eligible")
def f09(spark: SparkSession, folder: str) -> DataFrame:
    return c.eligible_lines(lines(spark, folder), "doc_id")


@query("j11_missing_lines", f"{PREPARED} SELECT doc_id, line_no, line FROM missing")
def j11(spark: SparkSession, folder: str) -> DataFrame:
    return c.missing_lines(source(spark, folder), chapters(spark, folder)).drop("site")


COVERAGE_SQL = "(SELECT (SELECT count(*) FROM source) AS checked, (SELECT count(*) FROM missing) AS missing)"


@query(
    "a04_coverage_ratio",
    f"{PREPARED} SELECT 'corpus' AS site, checked, missing, round(1.0 - missing / checked, 9) AS coverage FROM {COVERAGE_SQL}",
)
def a04(spark: SparkSession, folder: str) -> DataFrame:
    found = source(spark, folder)
    ratio = c.coverage_ratio(found, c.missing_lines(found, chapters(spark, folder)))
    return ratio.withColumn("coverage", F.round("coverage", 9))


@query(
    "v11_check_text_coverage",
    f"""{PREPARED} SELECT 'corpus' AS site, 'COVERAGE_TEXT_BELOW_THRESHOLD' AS code, 'error' AS severity, 'validate' AS stage,
    'Text coverage is ' || printf('%.1f', (1.0 - missing / checked) * 100) || '%; expected at least 90%.' AS message,
    CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS hint FROM {COVERAGE_SQL} WHERE 1.0 - missing / checked < 0.9""",
)
def v11(spark: SparkSession, folder: str) -> DataFrame:
    found = source(spark, folder)
    return c.check_text_coverage(c.coverage_ratio(found, c.missing_lines(found, chapters(spark, folder))))


@query(
    "k04_write_coverage",
    f"""{PREPARED} SELECT '{{"site":"corpus","checked":' || checked || ',"missing":' || missing || ',"coverage":' || round(1.0 - missing / checked, 9) || '}}' AS document FROM {COVERAGE_SQL}
    UNION ALL SELECT '{{"site":"corpus","line":' || to_json(line) || '}}' FROM missing""",
)
def k04(spark: SparkSession, folder: str) -> DataFrame:
    found = source(spark, folder)
    missing = cut_lineage(c.missing_lines(found, chapters(spark, folder)))
    ratio = c.coverage_ratio(found, missing).withColumn("coverage", F.round("coverage", 9))
    path = scratch_folder(spark, "coverage")
    write_coverage(ratio, missing, path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query(
    "o06_top_n",
    f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strlen(line) DESC, line_no) <= 10",
)
def o06(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(lines(spark, folder), ["doc_id"], [F.octet_length("line").desc(), F.col("line_no")], 10)


@query(
    "a07_tabular_shape",
    """WITH words AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents),
      rows AS (
        SELECT doc_id, len(string_split(unnest(string_split(text, chr(10))), ' ')) AS w FROM documents
        UNION ALL SELECT doc_id, least(2 + doc_id % 5, len(w) - s) FROM (SELECT doc_id, w, unnest(range(0, len(w), 2 + doc_id % 5)) AS s FROM words))
      SELECT doc_id, arg_min(w, -n * 1000000 + w) AS width FROM (SELECT doc_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM rows GROUP BY doc_id, w)
      GROUP BY doc_id HAVING max(n) / max(total) >= 0.75 AND max(total) >= 3 AND arg_min(w, -n * 1000000 + w) >= 3""",
)
def a07(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each text, whole, and below them the same text set as a table of two to six columns."""
    from ..plans.clean import tabular_width

    wide = (2 + F.col("doc_id") % 5).cast("int")
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    # bound once, so that the text is not split again for each row
    set_wide = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, wide), lambda s: F.slice(w, s + 1, wide))
    rows = F.get(F.transform(F.array(words), set_wide), F.lit(0))
    shaped = table(spark, folder, "documents").select("doc_id", tabular_width(F.concat(lines, rows)).cast("long").alias("width"))
    return shaped.filter("width IS NOT NULL")
