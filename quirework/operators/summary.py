"""Book summaries, warnings and directory texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this many inlined bytes on, a warning is given.
LARGE = 12 << 20


def warnings(scanned: Column, images: Column, inlined: Column, image_bytes: Column, skipped: Column) -> Column:
    """Array of warnings; the wording is fixed."""
    scan = F.when(scanned, F.when(images > 0, "扫描版 PDF：没有文本层，正文以内嵌整页图片提供").otherwise("扫描版 PDF：没有文本层，未能提取正文"))
    n = skipped.cast("string")
    skip = F.when((skipped > 0) & (inlined == 0) & (images == 0), F.concat(F.lit("有 "), n, F.lit(" 张图片未内嵌（图片过大或超出内嵌总量上限）"))).when(skipped > 0, F.concat(F.lit("有 "), n, F.lit(" 张图片未内嵌（已改用按需加载或已跳过）")))
    mb = F.floor(image_bytes / (1 << 20) + 0.5).cast("string")
    large = F.when((inlined > 0) & (image_bytes > LARGE), F.concat(F.lit("已在正文内嵌约 "), mb, F.lit(" MB 图片，一次性返回全书的接口响应会比较大；按章阅读（/content）不受影响")))
    return F.filter(F.array(scan, skip, large), lambda x: x.isNotNull())


def summarize(books: DataFrame, stats: DataFrame, kind: str) -> DataFrame:
    """A row per book: what is known of it, its figures, and warnings; missing figures are 0."""
    have = set(stats.columns)
    count = lambda c: F.coalesce(F.col(c) if c in have else F.lit(0), F.lit(0)).cast("long")
    joined = books.drop("page_count").join(stats, "book_id", "left")
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "description", "language", "identifier", "publisher", "date") if c in books.columns]
    scanned = F.coalesce(F.col("scanned"), F.lit(False)) if "scanned" in have else F.lit(False)
    figures = [count(c).alias(c) for c in ("chapter_count", "page_count", "outline_count", "image_count", "inlined_images", "skipped_images")]
    return joined.select("book_id", *named, F.lit(kind).alias("format"), *figures, scanned.alias("scanned"), warnings(scanned, count("image_count"), count("inlined_images"), count("image_bytes"), count("skipped_images")).alias("warnings"))


def directory(chapters: DataFrame) -> DataFrame:
    """(book_id, directory_entries): the titles, one a line."""
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("title") != "", F.struct("chapter_no", "title")))), lambda x: x["title"])
    return chapters.groupBy("book_id").agg(F.array_join(titles, "\n").alias("directory_entries"))
