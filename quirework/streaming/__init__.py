"""Streams: books that arrive in a folder are parsed in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.functions.text import decode_text, file_kind
from quirework.operators import epub, pdf
from quirework.operators.segment import parse_text

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, path, content, kind) of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).load(folder)
    return files.select(F.sha1("path").alias("book_id"), "path", "content", file_kind(F.col("path")).alias("kind"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes (book_id, chapter_no, title, content, kind) of new files to ``out``.

    Each batch has a folder of its own that a repeated batch overwrites, so a batch that fails midway counts once.
    """

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        text = files.where("kind = ''").select("book_id", decode_text(F.col("content")).alias("text"), F.array().cast("array<string>").alias("entries"))
        parts = [parse_text(text).withColumn("kind", F.lit("txt"))]
        for kind, parse in (("epub", epub.parse_epub), ("pdf", pdf.parse_pdf)):
            some = files.where(F.col("kind") == kind)
            if not some.isEmpty():
                parts.append(parse(some.select("book_id", "content"))["chapters"].withColumn("kind", F.lit(kind)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        files.unpersist()

    writer = arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
