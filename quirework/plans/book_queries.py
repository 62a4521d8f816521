"""Queries over whole book files, which are made of the conversations, one file for each, and parsed again.

A file's bytes are made by Python, but what is in it follows from the rows by plain rules, so SQL can tell what every
operator has to give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import epub, pdf, segment, summary
from quirework.plans.queries import query, table
from quirework.plans.staging import stage
from quirework.sources.zipscan import read_resource, resolve, zip_entries

#: What the made books have, by turn: every second one a heading and an entry of the contents, every third one an image,
#: every fifth one a note, every fourth one is not linear; the seventh has its heading only.
TURNS = """turns AS (SELECT conv_id::VARCHAR AS book_id, conv_id, turn::INT AS turn, role, text, 'text/' || turn::VARCHAR || '.xhtml' AS href FROM conversations),
books AS (SELECT book_id, conv_id, max(turn) + 1 AS n, arg_min(role, turn) AS first_role FROM turns GROUP BY ALL)"""
TAG = "'<img src=\"/img?href=OPS%2Fimg%2FCover.PNG\" alt=\"\" width=\"100%\" height=\"100%\" style=\"display:block\">'"


def epub_bytes(book: str, parts: list) -> bytes:
    import html
    import io
    import zipfile

    out, n = io.BytesIO(), len(parts)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OPS/book.opf"/></container>')
        items = "".join(f'<item id="c{i}" href="text/{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(n))
        refs = "".join(f'<itemref idref="c{i}"{" linear=\"no\"" if i % 4 == 3 else ""}/>' for i in range(n))
        meta = f'<dc:title>Book &amp; {book}</dc:title><dc:creator>{parts[0]["role"]}</dc:creator><dc:language>en</dc:language><meta name="cover" content="cov"/>'
        z.writestr("OPS/book.opf", f'<package xmlns:dc="d"><metadata>{meta}</metadata><manifest>{items}<item id="cov" href="img/Cover.PNG" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{refs}<itemref idref="none"/></spine></package>')
        points = "".join(f'<navPoint><navLabel><text>Entry {i}</text></navLabel><content src="text/{i}.xhtml#x"/></navPoint>' for i in range(0, n, 2))
        z.writestr("OPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        z.writestr("OPS/img/Cover.PNG", b"\x89PNG\r\n\x1a\n" + b"x" * (10 + int(book) % 7))
        for i, p in enumerate(parts):
            head = f"<h1>{p['role']} {i + 1}</h1>" if i % 4 in (0, 3) or i == 6 else ""
            body = "" if i == 6 else f"<p>{html.escape(p['text'], False)}</p>"
            image = ('<img src="../img/cover.png"/>', '<a href="#"><img data-src="../img/Cover.PNG" src=""/></a>')[i % 2] if i % 3 == 0 and i != 6 else ""
            note = f'<p>See<a href="#n{i}">[1]</a>.</p><aside id="n{i}" epub:type="footnote"><p>[1] Note of {i}.</p></aside>' if i % 5 == 1 else ""
            z.writestr(f"OPS/text/{i}.xhtml", f"<html><head><title>T</title></head><body>{head}{body}{image}{note}</body></html>")
    return out.getvalue()


def pdf_bytes(book: str, parts: list) -> bytes:
    n = len(parts)
    marks = range(0, n, 2)
    first = {"page": 4, "text": 4 + n, "image": 4 + 2 * n, "mark": 4 + 3 * n}
    coded = lambda s: b"<FEFF%s>" % s.encode("utf-16-be").hex().encode()
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % (first["page"] + i) for i in range(n)), b"<< /First %d 0 R >>" % first["mark"]]
    objects += [b"<< /Type /Page /Contents %d 0 R /Resources << /XObject << /Im%d %d 0 R >> >> >>" % (first["text"] + i, i, first["image"] + i) for i in range(n)]
    for i, p in enumerate(parts):
        lines = [p["role"], *p["text"].split("\n")] if i % 4 != 2 else []
        body = b"BT " + b" T* ".join(b"<%s> Tj" % x.encode("cp1252", "replace").hex().encode() for x in lines) + b" ET" + (b" /Im%d Do" % i) * (2 * (i % 3 == 0))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    objects += [b"<< /Subtype /Image /Width %d /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length %d >>\nstream\n%s\nendstream" % (1 + i, 2 + 2 * i, b"g" * (2 + 2 * i)) for i in range(n)]
    objects += [b"<< /Title %s /Dest [%d 0 R /Fit] %s >>" % (coded(f"Part {i}"), first["page"] + i, b"/Next %d 0 R" % (first["mark"] + k + 1) if k + 1 < len(marks) else b"") for k, i in enumerate(marks)]
    objects.append(b"<< /Title %s /Author (%s) >>" % (coded(f"Book {book}"), parts[0]["role"].encode()))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer\n<< /Root 1 0 R /Info %d 0 R >>" % len(objects)


def made(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(book_id, content): a file for each conversation."""
    import pandas as pd

    make = epub_bytes if kind == "epub" else pdf_bytes

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"book_id": b["book_id"], "content": [make(book, [{"role": x["role"], "text": x["text"]} for x in parts]) for book, parts in zip(b["book_id"], b["parts"], strict=True)]})

    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))
    return turns.mapInPandas(run, "book_id string, content binary")


def package(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = stage(zip_entries(made(spark, sf_dir, "epub")))
    return entries, stage(epub.packages(entries))


@query(f"WITH {TURNS} SELECT book_id, (turn + 4)::BIGINT AS pos, 'OPS/' || href AS name FROM turns UNION ALL SELECT book_id, p, x FROM books, (VALUES (0, 'META-INF/container.xml'), (1, 'OPS/book.opf'), (2, 'OPS/toc.ncx'), (3, 'OPS/img/Cover.PNG')) v(p, x)")
def zip_listing(spark, sf_dir):
    return zip_entries(made(spark, sf_dir, "epub"), "$^").select("book_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"WITH {TURNS} SELECT book_id, 'OPS/img/Cover.PNG' AS name, 18 + conv_id % 7 AS bytes, '89504E47' AS head FROM books")
def zip_resource(spark, sf_dir):
    return read_resource(made(spark, sf_dir, "epub"), "ops/IMG/cover.png").select("book_id", "name", F.length("data").cast("long").alias("bytes"), F.hex(F.substring("data", 1, 4)).alias("head"))


@query(f"WITH {TURNS} SELECT book_id, 'OPS/book.opf' AS opf_path, 'Book & ' || book_id AS title, first_role AS author, 'en' AS language FROM books")
def epub_metadata(spark, sf_dir):
    _, pkg = package(spark, sf_dir)
    return epub.metadata(pkg).join(pkg.select("book_id", "opf_path"), "book_id").select("book_id", "opf_path", "title", "author", "language")


@query(f"WITH {TURNS} SELECT book_id, 'c' || turn::VARCHAR AS id, 'OPS/' || href AS path, 'application/xhtml+xml' AS media_type FROM turns UNION ALL SELECT book_id, a, b, c FROM books, (VALUES ('cov', 'OPS/img/Cover.PNG', 'image/png'), ('ncx', 'OPS/toc.ncx', 'application/x-dtbncx+xml')) v(a, b, c)")
def epub_manifest(spark, sf_dir):
    _, pkg = package(spark, sf_dir)
    return epub.manifest(pkg).select("book_id", "id", "path", "media_type")


@query(f"WITH {TURNS} SELECT book_id, turn::BIGINT AS spine_pos, 'OPS/' || href AS path, turn % 4 <> 3 AS linear FROM turns")
def spine_manifest_join(spark, sf_dir):
    _, pkg = package(spark, sf_dir)
    return epub.spine(pkg, epub.manifest(pkg)).select("book_id", F.col("spine_pos").cast("long").alias("spine_pos"), "path", "linear")


@query(f"WITH {TURNS} SELECT book_id, (turn // 2)::BIGINT AS pos, 'Entry ' || turn::VARCHAR AS title, 'OPS/' || href AS key, 0::BIGINT AS level FROM turns WHERE turn % 2 = 0")
def epub_toc(spark, sf_dir):
    entries, pkg = package(spark, sf_dir)
    return epub.toc(entries, epub.manifest(pkg)).select("book_id", F.col("pos").cast("long").alias("pos"), "title", "key", F.col("level").cast("long").alias("level"))


@query(f"WITH {TURNS}, asked AS (SELECT book_id, unnest(['OPS/text/0.xhtml', 'ops/TEXT/0.XHTML', '//OPS/img%2FCover.PNG', 'ops/img%2Fcover.png', 'OPS/none']) AS path FROM books) SELECT book_id, path, CASE WHEN path LIKE '%0.%' THEN 'OPS/text/0.xhtml' WHEN path LIKE '%over%' THEN 'OPS/img/Cover.PNG' END AS entry FROM asked")
def resolve_ladder(spark, sf_dir):
    entries, pkg = package(spark, sf_dir)
    asked = F.array(*map(F.lit, ("OPS/text/0.xhtml", "ops/TEXT/0.XHTML", "//OPS/img%2FCover.PNG", "ops/img%2Fcover.png", "OPS/none")))
    return resolve(pkg.select("book_id", F.explode(asked).alias("path")), entries).select("book_id", "path", "entry")


@query(f"WITH {TURNS} SELECT book_id, 'OPS/img/Cover.PNG' AS href, 'image/png' AS media_type, 18 + conv_id % 7 AS bytes, 'manifest' AS source FROM books")
def epub_covers(spark, sf_dir):
    entries, pkg = package(spark, sf_dir)
    return epub.covers(entries, pkg, epub.manifest(pkg)).select("book_id", "href", "media_type", F.col("bytes").cast("long").alias("bytes"), "source")


HEADS = "CASE WHEN turn % 4 IN (0, 3) OR turn = 6 THEN role || ' ' || (turn + 1)::VARCHAR END"
TITLES = f"coalesce({HEADS}, CASE WHEN turn % 2 = 0 THEN 'Entry ' || turn::VARCHAR END, '第' || (turn + 1)::VARCHAR || '章')"


@query(f"WITH {TURNS} SELECT book_id, (turn + 1)::BIGINT AS chapter_no, {TITLES} AS title FROM turns")
def toc_title_fallback(spark, sf_dir):
    return epub.parse_epub(made(spark, sf_dir, "epub"), epub.Options(image_mode="none", collect_notes=False))["chapters"].select("book_id", "chapter_no", "title")


@query(f"""WITH {TURNS} SELECT book_id, (turn + 1)::BIGINT AS chapter_no, {TITLES} AS title,
coalesce('<h1>' || {HEADS} || '</h1>', '') || CASE WHEN turn = 6 THEN '' ELSE '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END
|| CASE WHEN turn % 3 = 0 AND turn <> 6 THEN '<br/>' || {TAG} || '<br/>' ELSE '' END
|| CASE WHEN turn % 5 = 1 THEN '<p>See<a href="#n' || turn::VARCHAR || '">[1]</a>.</p><br/>【注释】<br/>[1] Note of ' || turn::VARCHAR || '.<br/>' ELSE '' END AS content FROM turns""")
def epub_chapters(spark, sf_dir):
    """Whole chapters: lazy and plain images as addresses, notes at the end, a title-only chapter with its own content."""
    return epub.parse_epub(made(spark, sf_dir, "epub"), epub.Options(image_mode="url", image_base="/img"))["chapters"].select("book_id", "chapter_no", "title", "content")


@query(f"WITH {TURNS} SELECT book_id, 'OPS/' || href AS chapter, 1::BIGINT AS n, 'n' || turn::VARCHAR AS id, 'Note of ' || turn::VARCHAR || '.' AS text FROM turns WHERE turn % 5 = 1")
def notes_order(spark, sf_dir):
    entries = stage(zip_entries(made(spark, sf_dir, "epub"), "xhtml$"))
    docs = entries.where("name like '%.xhtml'").select("book_id", F.col("name").alias("entry"), t.extract_body(t.decode_text(F.col("data"))).alias("body"))
    return epub.notes(docs, entries).select("book_id", "chapter", F.col("n").cast("long").alias("n"), "id", "text")


@query(f"WITH {TURNS}, i AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS k FROM turns WHERE turn % 3 = 0 AND turn <> 6) SELECT book_id, (turn + 1)::BIGINT AS chapter_no, 'OPS/img/Cover.PNG' AS entry, 18 + conv_id % 7 AS n, CASE WHEN k * (18 + conv_id % 7) <= 40 THEN 'inline' ELSE 'skipped' END AS state FROM i")
def epub_images(spark, sf_dir):
    """Images in reading order, admitted to a budget of 40 bytes a book."""
    found = epub.parse_epub(made(spark, sf_dir, "epub"), epub.Options(max_inline_bytes=40))["images"]
    return found.select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), "entry", F.col("n").cast("long").alias("n"), "state")


@query(f"WITH {TURNS} SELECT book_id, n + 4 AS entries, n AS spine_count, n AS chapter_count, 1 AS image_count, count(*) FILTER (WHERE turn % 3 = 0 AND turn <> 6) AS inlined_images, (count(*) FILTER (WHERE turn % 3 = 0 AND turn <> 6) * (18 + conv_id % 7))::BIGINT AS image_bytes, 0 AS skipped_images FROM turns JOIN books USING (book_id, conv_id) GROUP BY book_id, conv_id, n")
def epub_stats(spark, sf_dir):
    s = epub.parse_epub(made(spark, sf_dir, "epub"))["stats"]
    return s.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("entries", "spine_count", "chapter_count", "image_count", "inlined_images", "image_bytes", "skipped_images")])


@query("SELECT conv_id::VARCHAR AS book_id, 'not a PDF file' AS pdf_error, true AS no_archive FROM conversations WHERE turn = 0")
def broken_files(spark, sf_dir):
    """Files that are neither: a row with an error from each reader."""
    files = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("book_id"), F.col("text").cast("binary").alias("content"))
    a = pdf.scan_rows(files, pdf.Options()).select("book_id", F.col("text").alias("pdf_error"))
    b = epub.packages(zip_entries(files)).select("book_id", F.contains("error", F.lit("not an archive")).alias("no_archive"))
    return a.join(b, "book_id")


@query(f"WITH {TURNS} SELECT book_id, 'Book ' || book_id AS title, first_role AS author, n::BIGINT AS page_count FROM books")
def pdf_info(spark, sf_dir):
    rows = pdf.scan_rows(made(spark, sf_dir, "pdf"), pdf.Options()).where("kind = 'info'")
    return rows.select("book_id", "title", F.col("text").alias("author"), F.col("pos").cast("long").alias("page_count"))


@query(f"""WITH {TURNS}, l AS (SELECT book_id, turn, list_filter(list_transform(list_concat([role], string_split(text, chr(10))), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM turns)
SELECT book_id, turn::BIGINT AS page, CASE WHEN turn % 4 = 2 THEN '' ELSE array_to_string(l, chr(10)) END AS text, CASE WHEN turn % 3 = 0 THEN 'Im' || turn::VARCHAR ELSE '' END AS images FROM l""")
def pdf_pages(spark, sf_dir):
    p = pdf.parse_pdf(made(spark, sf_dir, "pdf"))["pages"]
    return p.select("book_id", F.col("page").cast("long").alias("page"), F.array_join("lines", "\n").alias("text"), F.array_join("image_names", ",").alias("images"))


@query(f"WITH {TURNS} SELECT book_id, (turn // 2)::BIGINT AS pos, 'Part ' || turn::VARCHAR AS title, turn::BIGINT AS page, 0::BIGINT AS level FROM turns WHERE turn % 2 = 0")
def pdf_outlines(spark, sf_dir):
    rows = pdf.scan_rows(made(spark, sf_dir, "pdf"), pdf.Options()).where("kind = 'outline'")
    return rows.select("book_id", F.col("pos").cast("long").alias("pos"), "title", F.col("page").cast("long").alias("page"), F.col("level").cast("long").alias("level"))


@query(f"WITH {TURNS} SELECT book_id, turn // 2 + 1 AS chapter_no, 'Part ' || turn::VARCHAR AS title, turn::BIGINT AS first_page, least(turn + 2, n)::BIGINT AS end_page FROM turns JOIN books USING (book_id) WHERE turn % 2 = 0")
def outline_spans(spark, sf_dir):
    s = pdf.outline_spans(stage(pdf.scan_rows(made(spark, sf_dir, "pdf"), pdf.Options())))
    return s.select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), "title", F.col("first_page").cast("long").alias("first_page"), F.col("end_page").cast("long").alias("end_page"))


@query(f"WITH {TURNS} SELECT book_id, turn // 2 + 1 AS chapter_no, 'Part ' || turn::VARCHAR AS title, turn::BIGINT AS first_page, least(turn + 2, n)::BIGINT AS end_page, (turn % 3 = 0)::INT + (turn + 1 < n AND (turn + 1) % 3 = 0)::INT AS image_count FROM turns JOIN books USING (book_id) WHERE turn % 2 = 0")
def pdf_chapters(spark, sf_dir):
    """Chapters by bookmarks, of two pages each, with their images."""
    c = pdf.parse_pdf(made(spark, sf_dir, "pdf"))["chapters"]
    return c.select("book_id", "chapter_no", "title", *[F.col(x).cast("long").alias(x) for x in ("first_page", "end_page", "image_count")])


@query(f"WITH {TURNS} SELECT book_id, (turn + 1)::BIGINT AS chapter_no, '第 ' || (turn + 1)::VARCHAR || ' 页' AS title FROM turns WHERE turn < 3")
def pdf_by_page(spark, sf_dir):
    """A chapter for each of the first three pages, whatever the bookmarks."""
    return pdf.parse_pdf(made(spark, sf_dir, "pdf"), pdf.Options(by_page=True, max_pages=3, image_mode="none"))["chapters"].select("book_id", "chapter_no", "title")


@query(f"WITH {TURNS} SELECT book_id, turn::BIGINT AS page, 'Im' || turn::VARCHAR AS name, 2 * (1 + turn) AS area, 'image/png' AS media_type FROM turns WHERE turn % 3 = 0")
def pdf_images(spark, sf_dir):
    i = pdf.parse_pdf(made(spark, sf_dir, "pdf"))["images"]
    return i.select("book_id", F.col("page").cast("long").alias("page"), "name", F.col("area").cast("long").alias("area"), "media_type")


@query(f"WITH {TURNS} SELECT book_id, 'Im3' AS name, 'image/png' AS media_type FROM turns WHERE turn = 3")
def pdf_page_image(spark, sf_dir):
    return pdf.page_image(made(spark, sf_dir, "pdf"), 3).select("book_id", "name", "media_type")


@query(f"WITH {TURNS} SELECT book_id, 0::BIGINT AS page, 'Im0' AS name FROM books")
def cover_argmax(spark, sf_dir):
    """The largest image of the first page that has one."""
    return pdf.covers(pdf.parse_pdf(made(spark, sf_dir, "pdf"))["images"]).select("book_id", F.col("page").cast("long").alias("page"), "name")


@query(f"WITH {TURNS} SELECT book_id, n::BIGINT AS page_count, count(*) FILTER (WHERE turn % 4 <> 2) AS text_page_count, count(*) FILTER (WHERE turn % 3 = 0) AS image_count, count(*) FILTER (WHERE turn % 2 = 0) AS outline_count, count(*) FILTER (WHERE turn % 2 = 0) AS chapter_count, false AS scanned FROM turns JOIN books USING (book_id) GROUP BY book_id, n")
def book_stats(spark, sf_dir):
    s = pdf.parse_pdf(made(spark, sf_dir, "pdf"))["stats"]
    return s.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("page_count", "text_page_count", "image_count", "outline_count", "chapter_count")], "scanned")


@query(f"WITH {TURNS} SELECT book_id, n >= 3 AS scanned FROM books WHERE n >= 3")
def scanned_flag(spark, sf_dir):
    """Books that are cut to their third page, which has no text: they count as scanned."""
    files = made(spark, sf_dir, "pdf")
    pages = stage(pdf.scan_rows(files, pdf.Options(max_pages=3), only_page=2)).where("kind = 'page'")
    s = pdf.page_stats(pages.select("book_id", "page", F.lit("").alias("text"), F.array().cast("array<string>").alias("image_names"), F.col("level").alias("unmapped")))
    return s.select("book_id", "scanned")


@query(f"WITH {TURNS} SELECT book_id, 'Book ' || book_id AS title, first_role AS author, 'pdf' AS format, n::BIGINT AS page_count, 0 AS n_warnings FROM books")
def book_summary(spark, sf_dir):
    out = pdf.parse_pdf(made(spark, sf_dir, "pdf"))
    s = summary.summarize(out["books"], out["stats"], "pdf")
    return s.select("book_id", "title", "author", "format", "page_count", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"WITH {TURNS} SELECT book_id, (turn // 2)::BIGINT AS chapter_index, 'Part ' || turn::VARCHAR AS title, md5(book_id || '-' || (turn // 2)::VARCHAR) AS link FROM turns WHERE turn % 2 = 0")
def reader_toc(spark, sf_dir):
    from quirework import api

    return api.toc(pdf.parse_pdf(made(spark, sf_dir, "pdf"), pdf.Options(image_mode="none"))["chapters"])


@query("WITH c AS (SELECT conv_id AS book_id, turn, '第' || (turn + 1)::VARCHAR || '章' AS title FROM conversations) SELECT book_id, string_agg(title, chr(10) ORDER BY turn) AS directory_entries FROM c GROUP BY book_id")
def directory_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("chapter_no"), F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("章")).alias("title"))
    return summary.directory(c)


@query("WITH c AS (SELECT conv_id AS book_id, turn, turn % 3 = 1 AS bare, 'Part' || (turn + 1)::VARCHAR AS title, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS more FROM conversations), p AS (SELECT *, coalesce(lag(bare) OVER (PARTITION BY book_id ORDER BY turn), false) AS after FROM c) SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY turn) AS chapter_no, CASE WHEN after THEN 'Part' || turn::VARCHAR || title ELSE title END AS title, CASE WHEN after THEN 2 ELSE 1 END::BIGINT AS n_parts FROM p WHERE NOT (bare AND more)")
def merged_entries(spark, sf_dir):
    """Bare headings are drawn into the next chapter, as the expected headings have both as one."""
    name = lambda i: F.concat(F.lit("Part "), i.cast("string"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("chapter_no"), name(F.col("turn") + 1).alias("title"), (F.col("turn") % 3 == 1).alias("bare"), "text")
    c = c.withColumn("content", F.when(F.col("bare"), F.col("title")).otherwise(F.col("text")))
    books = c.groupBy("book_id").agg(F.transform(F.sequence(F.lit(1), F.max("chapter_no").cast("int") + 1), lambda i: F.concat(name(i), F.lit(" "), name(i + 1))).alias("entries"))
    merged = segment.merge_title_only(c, books)
    return merged.select(F.col("book_id").cast("long").alias("book_id"), "chapter_no", t.no_space(F.col("title")).alias("title"), F.size("parts").cast("long").alias("n_parts"))
