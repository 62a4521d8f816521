"""PDF books: pages, chapters by bookmarks, images, cover and statistics as DataFrames over scanned rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import segment
from quirework.operators.rules import Rules
from quirework.plans.staging import stage

SCHEMA = "book_id string, kind string, page int, pos int, level int, title string, text string, area long, blocks array<struct<kind:string,text:string>>, data binary"
_ARROW = pa.schema([("book_id", pa.string()), ("kind", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("level", pa.int32()), ("title", pa.string()), ("text", pa.string()), ("area", pa.int64()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))), ("data", pa.binary())])


@dataclass(frozen=True)
class Options:
    """How a file is to be read. by_page ignores bookmarks; images is inline, url or none."""

    max_pages: int = 0
    by_page: bool = False
    image_mode: str = "inline"
    image_base: str = ""
    max_inline_bytes: int = 0
    max_image_bytes: int = 8 << 20
    rules: Rules = field(default_factory=Rules)
    entries: tuple[str, ...] = ()


#: About how many bytes of rows an Arrow batch has.
_BATCH = 8 << 20


def scan_rows(files: DataFrame, o: Options, **limits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quirework.sources.pdfscan import scan

        for b in batches:
            for book, content in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for r in scan(content.as_py(), o.max_pages, o.image_mode == "inline", o.max_image_bytes, **limits):
                    rows.append({"book_id": book.as_py(), **r})
                    size += len(r.get("data") or b"") + sum(len(x["text"]) for x in r.get("blocks", ())) + 100
                    if size > _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select(F.col("book_id").cast("string"), "content").mapInArrow(run, SCHEMA)


def outline_spans(rows: DataFrame) -> DataFrame:
    """(book_id, chapter_no, title, first_page, end_page) of bookmarks whose page is known, in page order."""
    n = rows.where("kind = 'info'").select("book_id", F.col("pos").alias("n"))
    marks = rows.where("kind = 'outline' and page is not null").select("book_id", "pos", "title", "page").join(n, "book_id")
    w = Window.partitionBy("book_id").orderBy("page", "pos")
    return marks.select("book_id", F.row_number().over(w).alias("chapter_no"), "title", F.col("page").alias("first_page"), F.greatest(F.col("page") + 1, F.coalesce(F.lead("page").over(w), F.col("n"))).alias("end_page"))


def parse_pdf(files: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """books, pages, chapters, outlines, images, covers and stats of ``files(book_id, content)``; broken files have an error in books."""
    o = options or Options()
    rows = stage(scan_rows(files, o))
    lines = F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["text"])
    names = F.array_distinct(F.transform(F.filter("blocks", lambda b: b["kind"] == "image"), lambda b: b["text"]))
    pages = rows.where("kind = 'page'").select("book_id", "page", F.col("pos").alias("object_number"), "blocks", lines.alias("lines"), names.alias("image_names"), F.col("level").alias("unmapped"))
    cut = segment.paragraphs(pages.select(F.concat_ws("/", "book_id", "page").alias("doc_id"), F.posexplode("lines").alias("pos", "line")))
    par = cut.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", "paragraph"))), lambda x: x["paragraph"]).alias("paragraphs"))
    pages = pages.withColumn("doc_id", F.concat_ws("/", "book_id", "page")).join(par, "doc_id", "left").drop("doc_id")
    pages = stage(pages.withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>"))).withColumn("text", F.array_join("paragraphs", "\n")))
    images = rows.where("kind = 'image'").select("book_id", "page", "pos", F.col("title").alias("name"), "area", F.col("text").alias("media_type"), F.length("data").cast("long").alias("bytes"), "data")
    spans = stage(outline_spans(rows))
    marked = spans.select("book_id").distinct()
    if o.by_page:
        marked = marked.limit(0)
        spans = spans.limit(0)
    single = pages.join(marked, "book_id", "left_anti").select("book_id", (F.col("page") + 1).alias("chapter_no"), F.concat(F.lit("第 "), (F.col("page") + 1).cast("string"), F.lit(" 页")).alias("title"), F.col("page").alias("first_page"), (F.col("page") + 1).alias("end_page"))
    spans = spans.unionByName(single)
    # A range join as an equi-join on the pages of each span
    each = stage(spans.withColumn("page", F.explode(F.sequence("first_page", F.col("end_page") - 1))).join(pages, ["book_id", "page"]))
    shown = _shown(each, images, o)
    html = F.when(F.size("image_names") == 0, t.text_to_html(F.col("text"))).otherwise(F.col("mixed"))
    each = each.join(shown, ["book_id", "chapter_no", "page"], "left").withColumn("html", F.coalesce(html, t.text_to_html(F.col("text"))))
    ordered = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", c))), lambda x: x[c]), sep)
    chaps = each.groupBy("book_id", "chapter_no", "title", "first_page", "end_page").agg(ordered("html", "<br/>").alias("content"), ordered("text", "\n\n").alias("text"), F.sum(F.size("image_names")).alias("image_count"))
    chaps = stage(chaps.withColumn("chapter_no", F.col("chapter_no").cast("long")))
    body = t.strip(F.col("text"))
    bare = ((body == "") & (F.col("image_count") == 0)) | (body == t.strip(F.col("title")))
    # The text decides whether there is a body; contents are joined to what the merge makes of the chapters
    flat = chaps.select("book_id", "chapter_no", "title", F.when(body == "", "\u0001").otherwise(body).alias("content"), bare.alias("bare"))
    merged = stage(segment.merge_title_only(flat, segment.with_entries(files, o.entries), o.rules))
    chapters = merged_contents(merged, chaps)
    info = rows.where("kind in ('info', 'error')").select("book_id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("kind") == "info", F.col("text")).otherwise("").alias("author"), F.col("pos").alias("page_count"), F.when(F.col("kind") == "error", F.col("text")).alias("error"))
    stats = page_stats(pages).withColumn("image_mode", F.lit(o.image_mode))
    stats = stats.join(chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count")), "book_id", "left").join(rows.where("kind = 'outline'").groupBy("book_id").agg(F.count("*").alias("outline_count")), "book_id", "left").fillna(0, ["chapter_count", "outline_count"])
    return {"books": info, "pages": pages, "chapters": chapters, "outlines": rows.where("kind = 'outline'").select("book_id", "pos", "title", "page", "level"), "images": images, "covers": covers(images), "stats": stats}


def page_stats(pages: DataFrame) -> DataFrame:
    """A book's figures of its ``pages(book_id, page, text, image_names, unmapped)``; a book whose pages have no text is scanned."""
    stats = pages.groupBy("book_id").agg(F.count("*").alias("page_count"), F.sum(F.length("text")).alias("text_length"), F.count_if(F.col("text") != "").alias("text_page_count"), F.sum("unmapped").alias("unmapped_codes"), F.sum(F.size("image_names")).alias("image_count"))
    return stats.withColumn("scanned", (F.col("page_count") > 0) & (F.col("text_page_count") == 0))


def merged_contents(merged: DataFrame, chaps: DataFrame) -> DataFrame:
    """(book_id, chapter_no, title, content, first_page, end_page, image_count): what chapters are made of, one after the other."""
    each = merged.select("book_id", F.col("chapter_no").alias("no"), F.col("title").alias("heading"), F.posexplode("parts").alias("k", "chapter_no"))
    each = each.join(chaps, ["book_id", "chapter_no"])
    content = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), lambda x: x != ""), "<br/>")
    out = each.groupBy("book_id", "no", "heading").agg(content.alias("content"), F.min("first_page").alias("first_page"), F.max("end_page").alias("end_page"), F.sum("image_count").alias("image_count"))
    return out.withColumnsRenamed({"no": "chapter_no", "heading": "title"})


def _shown(each: DataFrame, images: DataFrame, o: Options) -> DataFrame:
    """(book_id, chapter_no, page, mixed): the page's text with its images in stream order, once for a chapter and page's name."""
    first = each.select("book_id", "chapter_no", "page", F.posexplode("blocks").alias("k", "b")).select("book_id", "chapter_no", "page", "k", F.col("b.kind").alias("kind"), F.col("b.text").alias("text"))
    first = first.join(images.select("book_id", "page", F.col("name").alias("text"), F.lit("image").alias("kind"), "media_type", "bytes", "data"), ["book_id", "page", "kind", "text"], "left")
    n = F.row_number().over(Window.partitionBy("book_id", "chapter_no", "page", "kind", "text").orderBy("k"))
    first = first.withColumn("n", n).where("kind = 'text' or n = 1").withColumn("fits", F.col("data").isNotNull() & F.lit(o.image_mode == "inline"))
    if o.max_inline_bytes > 0:
        order = first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("chapter_no", "page", "k", "bytes")))).alias("o"))
        took = segment.within_budget(F.transform("o", lambda x: x["bytes"]), F.lit(o.max_inline_bytes).cast("long"))
        took_rows = order.select("book_id", F.explode(F.arrays_zip(F.col("o"), took.alias("took"))).alias("x")).select("book_id", "x.o.chapter_no", "x.o.page", "x.o.k", "x.took")
        first = first.join(took_rows, ["book_id", "chapter_no", "page", "k"], "left").withColumn("fits", F.coalesce("took", F.lit(False))).drop("took")
    url = t.image_url(F.lit(o.image_base), page=F.col("page") + 1, name=F.col("text")) if o.image_base and o.image_mode != "none" else F.lit("")
    src = F.when(F.col("fits"), t.data_uri(F.col("media_type"), F.col("data"))).otherwise(url)
    piece = F.when(F.col("kind") == "text", t.escape_html(F.col("text"))).when(src != "", F.concat(F.lit("<br/>"), t.image_tag(src), F.lit("<br/>"))).otherwise("")
    return first.groupBy("book_id", "chapter_no", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("p")))), lambda x: x["p"]), "\n").alias("mixed"))


def covers(images: DataFrame) -> DataFrame:
    """(book_id, page, name, media_type, bytes, data): the largest image of the first page that has one that can be read."""
    largest = images.groupBy("book_id", "page").agg(F.min_by(F.struct("name", "media_type", "bytes", "data"), F.struct((-F.col("area")).alias("a"), "pos")).alias("x")).where("x.data is not null")
    best = largest.groupBy("book_id").agg(F.min_by(F.struct("page", "x"), "page").alias("b"))
    return best.select("book_id", "b.page", "b.x.name", "b.x.media_type", "b.x.bytes", "b.x.data")


def page_image(files: DataFrame, page: int, name: str | None = None) -> DataFrame:
    """(book_id, name, media_type, data) of one page's image, the first one by default, under wider limits."""
    rows = scan_rows(files, Options(max_image_bytes=32 << 20), only_page=page, max_pixels=64 << 20, max_inflated=192 << 20).where("kind = 'image'")
    rows = rows.where(F.col("title") == name) if name else rows.where("pos = 0")
    return rows.select("book_id", F.col("title").alias("name"), F.col("text").alias("media_type"), "data")
