"""What clients call: books by path or bytes to chapters, contents, summaries and single resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import chapter_link
from quirework.operators import epub, pdf
from quirework.operators.catalog import Catalog
from quirework.operators.rules import Rules, load_rules, save_rules
from quirework.operators.segment import parse_text
from quirework.operators.summary import directory, summarize
from quirework.sources import html_files, read_files, read_text_books
from quirework.sources.zipscan import read_resource

__all__ = ["Catalog", "Rules", "load_rules", "save_rules", "html_files", "read_resource", "parse_txt", "parse_epub_files", "parse_pdf_files", "toc", "content", "summaries", "directory"]


def parse_txt(spark: SparkSession, path: str, rules: Rules | None = None) -> DataFrame:
    return parse_text(read_text_books(spark, path), rules)


def parse_epub_files(spark: SparkSession, path: str, options: epub.Options | None = None) -> dict[str, DataFrame]:
    return epub.parse_epub(read_files(spark, path, "*.epub").select("book_id", "content"), options)


def parse_pdf_files(spark: SparkSession, path: str, options: pdf.Options | None = None) -> dict[str, DataFrame]:
    return pdf.parse_pdf(read_files(spark, path, "*.pdf").select("book_id", "content"), options)


def toc(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_index, title, link): what a reader lists; links are checked by ``content``."""
    index = F.col("chapter_no") - 1
    return chapters.select("book_id", index.alias("chapter_index"), "title", chapter_link(F.col("book_id"), index).alias("link"))


def content(chapters: DataFrame, link: str) -> DataFrame:
    """The chapter that a link means, with line feeds as breaks."""
    hit = chapters.where(chapter_link(F.col("book_id"), F.col("chapter_no") - 1) == link)
    return hit.select("book_id", "chapter_no", "title", F.replace("content", F.lit("\n"), F.lit("<br/>")).alias("content"))


def summaries(parsed: dict[str, DataFrame], kind: str) -> DataFrame:
    return summarize(parsed["books"], parsed["stats"], kind)
