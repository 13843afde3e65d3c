"""Book archives as entry tables, and back.

Archives are read one file per row and written as streams: rows arrive sorted
by (book, path, part) and each part is written as it comes, so a task never
holds a book in memory. A part is one document fragment.
"""

from __future__ import annotations

import io
import os
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTRY

register_pickle_by_value(sys.modules[__name__])

METHODS = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}
FIRST_ENTRY = "mimetype"
WRITTEN = "book string, path string, entries long, bytes long"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("book", pa.string()), ("ordinal", pa.int32()), ("name", pa.string()),
            ("method", pa.string()), ("size", pa.int64()), ("data", pa.binary()),
        ]
    )
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for ordinal, info in enumerate(archive.infolist()):
                    row = {
                        "book": path, "ordinal": ordinal, "name": info.filename,
                        "method": METHODS.get(info.compress_type, "other"),
                        "size": info.file_size, "data": archive.read(info),
                    }
                    yield pa.RecordBatch.from_pylist([row], schema=schema)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(book, ordinal, name, method, size, data) in archive order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInArrow(_unpack, ENTRY)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = archive = entry = name = None
        count = 0

        def finish() -> pa.RecordBatch:
            if entry is not None:
                entry.close()
            archive.close()
            target = f"{folder}/{book}.epub"
            os.replace(f"{target}.{os.getpid()}.tmp", target)
            row = {"book": book, "path": target, "entries": count, "bytes": os.path.getsize(target)}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for row in batch.to_pylist():
                if row["book"] != book:
                    if archive is not None:
                        yield finish()
                    book, entry, name, count = row["book"], None, None, 0
                    archive = zipfile.ZipFile(f"{folder}/{book}.epub.{os.getpid()}.tmp", "w")
                if row["path"] != name:
                    if entry is not None:
                        entry.close()
                    name = row["path"]
                    info = zipfile.ZipInfo(name)
                    info.compress_type = zipfile.ZIP_STORED if name == FIRST_ENTRY else zipfile.ZIP_DEFLATED
                    entry, count = archive.open(info, "w"), count + 1
                entry.write(row["data"])
        if archive is not None:
            yield finish()

    return write


def write_epub(files: DataFrame, folder: str) -> DataFrame:
    """Write one archive per book into a folder every executor reaches; gives one row per archive.

    ``files(book, path, part, data)``: ``mimetype`` goes first and stored, the
    rest in path order and deflated; a finished archive replaces an older one in
    one step, so a repeated task does no harm. One archive is one file and hence
    one task; books are spread over tasks.
    """
    os.makedirs(folder, exist_ok=True)
    ordered = (
        files.select("book", "path", "part", F.col("data").cast("binary").alias("data"))
        .repartition("book")
        .sortWithinPartitions("book", F.col("path") != FIRST_ENTRY, "path", "part")
    )
    return ordered.mapInArrow(_writer(folder), WRITTEN)
