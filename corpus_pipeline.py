"""A training corpus from raw documents: five stages, each written as Parquet and read again.

quality rules -> near-dedup -> substring dedup -> benchmark decontamination -> byte-level BPE.
Stages take (spark, docs, sf_dir) and work on all that the stage before kept.

Defined results: rows with null or blank text fail the quality rules; of rows that
share both id and text one may go as an exact copy; a text all of whose words
repeat elsewhere stays as an empty text. Rows without an id are in no group of near
copies, so of them only exact copies go. Stages read and return the columns of
`documents`; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import bpe, decontaminate, neardup, quality, substrings
from quireflow.llm.vocab import rank_file
from quireflow.session import scratch_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the repetition rule keep."""
    return quality.judge(docs, COLUMNS).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group.

    Documents without words or without an id are in no group and stay.
    """
    kept = neardup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id")
    # repeated rows go before the union, where the join has put equal ids together
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    unnamed = docs.filter("doc_id is null").dropDuplicates(["text"])
    return named.unionByName(unnamed).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that repeat anywhere in what is left."""
    cut = substrings.remove_repeats(docs, COLUMNS)
    text = F.coalesce("kept_text", "row.text")
    chars = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text"))
    return cut.select("row.doc_id", text.alias("text"), "row.lang", "row.source", chars.cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digests of ids and decoded bytes."""
    import public_tokenizers

    pieces = rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs, pieces, public_tokenizers.PATTERN, ("doc_id", "lang", "source", "n_chars"), with_ids=True)
    return encoded.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Suffix fingerprints and byte merges have no SQL form; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
