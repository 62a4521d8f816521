"""Sources: text, archives and page-description files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import file_kind, is_pdf


def kind_of(path: Column, content: Column) -> Column:
    """epub, pdf or txt: by the name, or else, but for names of text files, by what the content begins with."""
    named = file_kind(path)
    text = F.lower(path).rlike("\\.(txt|text|md|html?)$")
    return F.when(named != "", named).when(text, "txt").when(is_pdf(content), "pdf").otherwise("epub")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(book_id, path, content, kind) of all files below a folder; book_id is the SHA-1 of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha1("path").alias("book_id"), "path", "content", kind_of(F.col("path"), F.col("content")).alias("kind"))


def read_text_books(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(book_id, text, entries) of whole text files, which are UTF-8; what isn't becomes a replacement character."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return read_files(spark, path, pattern).select("book_id", text.alias("text"), F.array().cast("array<string>").alias("entries"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, url) of the pages in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select("path", F.concat(F.lit("/html/"), F.element_at(F.split("path", "/"), -1)).alias("url"))
