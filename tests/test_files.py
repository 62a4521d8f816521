import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quirework.operators import catalog, epub, pdf
from quirework.sources import zipscan
from quirework.sources.pdfscan import Reader, ascii85, inflate, scan, to_unicode, unpredict

PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 40


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def sample(**more):
    opf = """<package xmlns:dc="x"><metadata><dc:title>Sample &amp; Co</dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language><meta name="cover" content="cov"/></metadata>
<manifest><item id="c1" href="text/1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/2.xhtml" media-type="application/xhtml+xml"/><item id="cov" href="img/Cover.PNG" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
<spine toc="ncx"><itemref idref="c1"/><itemref idref="c2" linear="no"/><itemref idref="none"/></spine></package>"""
    ncx = """<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="text/1.xhtml"/></navPoint><navPoint><navLabel><text>Second</text></navLabel><content src="text/2.xhtml#a"/></navPoint></navMap></ncx>"""
    one = """<html><head><title>t</title><style>p{}</style></head><body><h1>Chapter <i>One</i></h1><p onclick="x()">Hello<a href="#n1">[1]</a> <img data-src="../img/cover.png" src="data:image/gif;base64,R0"/></p><script>bad()</script><aside id="n1" epub:type="footnote"><p>[1] A note.</p></aside></body></html>"""
    two = """<html><body><p>No heading here.</p></body></html>"""
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>', "OEBPS/book.opf": opf, "OEBPS/toc.ncx": ncx, "OEBPS/text/1.xhtml": one, "OEBPS/text/2.xhtml": two, "OEBPS/img/Cover.PNG": PNG}
    return archive(parts | more)


def files(spark, *contents):
    return spark.createDataFrame([(f"b{i}", c) for i, c in enumerate(contents)], "book_id string, content binary")


def test_epub(spark):
    out = epub.parse_epub(files(spark, sample(), bytearray(b"no archive"), archive({"a.txt": "x"})))
    info = {r.book_id: r for r in out["books"].collect()}
    assert (info["b0"].title, info["b0"].author, info["b0"].error) == ("Sample & Co", "Ann", None)
    assert "archive" in info["b1"].error and info["b2"].error == "no package document"
    chapters = out["chapters"].orderBy("chapter_no").collect()
    assert [c.title for c in chapters] == ["Chapter One", "Second"]
    first = chapters[0].content
    assert "data:image/png;base64," in first and "script" not in first and "onclick" not in first and first.endswith("<br/>【注释】<br/>[1] A note.<br/>") and first.startswith("<style>\np{}\n</style>\n<h1>")
    assert [(r.title, r.level) for r in out["toc"].orderBy("pos").collect()] == [("First", 0), ("Second", 0)]
    cover = out["covers"].first()
    assert (cover.href, cover.media_type, bytes(cover.data)) == ("OEBPS/img/Cover.PNG", "image/png", PNG)
    stats = out["stats"].where("book_id = 'b0'").first()
    assert (stats.entries, stats.spine_count, stats.chapter_count, stats.inlined_images, stats.image_bytes) == (7, 2, 2, 1, len(PNG))


def test_epub_images_off_keep_the_structure(spark):
    f = files(spark, sample())
    runs = [epub.parse_epub(f, epub.Options(**o)) for o in ({"max_inline_bytes": 1}, {"image_mode": "none", "max_chapters": 2}, {"image_mode": "url", "image_base": "/img"})]
    assert len({tuple(r.title for r in x["chapters"].orderBy("chapter_no").collect()) for x in runs}) == 1
    assert "/img?href=OEBPS%2Fimg%2FCover.PNG" in runs[2]["chapters"].orderBy("chapter_no").first().content
    assert [(x["stats"].first().inlined_images, x["stats"].first().skipped_images) for x in runs] == [(0, 1), (0, 0), (0, 0)]


def test_epub_notes():
    """Nested blocks, outermost only, markup kept, order by marker, notes in other documents."""
    from quirework.operators import notes

    body = '<p>A<a href="#n2">[1]</a> B<a href="#n1">[2]</a> C<a href="n.xhtml#far">3</a></p><div class="footnote" id="n1"><div><p>First <b>bold</b></p></div><p>two</p></div><aside epub:type="footnote" id="n2">[2] Second<section class="note">in</section></aside><p class="footnote-ref">stays</p><p class="notes-like">stays too</p>'
    cleaned, own, refs = notes.split(body)
    assert [x[0] for x in own] == ["n1", "n2"] and refs == [("n.xhtml", "far", body.index('<a href="n.xhtml'))]
    assert cleaned.endswith('</p><p class="footnote-ref">stays</p><p class="notes-like">stays too</p>')
    found = [*own, ("far", notes.element('<ul><li id="x">no</li><li id="far">1. Far <i>away</i><ul><li>deep</li></ul></li></ul>', "far"), refs[0][2])]
    assert notes.ordered(cleaned, found) == [("n2", "Second<section class=\"note\">in</section>"), ("n1", "<div>First <b>bold</b><br/></div>two"), ("far", "Far <i>away</i><ul><li>deep</li></ul>")]
    assert notes.split("<div class='note'>open only") == ("<div class='note'>open only", [], [])


def test_epub_sheets_and_far_notes(spark):
    """Linked sheets before style elements, addresses in them and in style attributes, fonts as addresses, notes elsewhere."""
    one = "<html><head><link rel='stylesheet' href='../css/a.css'/><style>i{background:url(\"../img/cover.png\")}</style></head><body><p style='background: url(../img/cover.png)'>Text<a href='2.xhtml#fn'>[1]</a></p></body></html>"
    two = "<html><body><p>No heading here.</p><p id='fn'>1. A <b>far</b> note.</p></body></html>"
    more = {"OEBPS/text/1.xhtml": one, "OEBPS/text/2.xhtml": two, "OEBPS/css/a.css": "@font-face{src:url(f.ttf)} b{background:url('../img/Cover.PNG')} u{x:url(http://h/x.png)}", "OEBPS/css/f.ttf": b"font"}
    f = files(spark, sample(**more))
    out = epub.parse_epub(f, epub.Options(image_mode="url", image_base="/r"))
    first = out["chapters"].orderBy("chapter_no").first().content
    cover = 'url("/r?href=OEBPS%2Fimg%2FCover.PNG")'
    assert first.startswith('<style>\n@font-face{src:url("/r?href=OEBPS%2Fcss%2Ff.ttf")} b{background:' + cover + "} u{x:url(http://h/x.png)}\ni{background:" + cover + "}\n</style>\n")
    assert f"<p style='background: {cover}'>" in first and first.endswith("<br/>【注释】<br/>[1] A <b>far</b> note.<br/>")
    stats = out["stats"].first()
    assert (stats.asset_count, stats.image_count) == (1, 1)
    inlined = epub.parse_epub(f, epub.Options(inline_fonts=True))
    assert "data:font/ttf;base64,Zm9udA==" in inlined["chapters"].orderBy("chapter_no").first().content and inlined["stats"].first().asset_bytes == 4
    with pytest.raises(ValueError):
        epub.Options(image_mode="x")


def test_entry_lookup(spark):
    f = files(spark, archive({"A/B c.txt": "1", "a/b c.TXT": "2"}))
    entries = zipscan.zip_entries(f)
    refs = spark.createDataFrame([("b0", p) for p in ("A/B c.txt", "a/B C.txt", "/a/b%20c.TXT", "zzz")], "book_id string, path string")
    assert {r.path: r.entry for r in zipscan.resolve(refs, entries).collect()} == {"A/B c.txt": "A/B c.txt", "a/B C.txt": "A/B c.txt", "/a/b%20c.TXT": "a/b c.TXT", "zzz": None}
    assert zipscan.read_resource(f, "a/../x").count() == 0 and zipscan.read_resource(f, " ").count() == 0
    assert bytes(zipscan.read_resource(f, "A/B c.txt").first().data) == b"1"


def test_broken_directory():
    """Of an archive whose directory breaks off, the entries up to there are read."""
    whole = bytes(archive({"a.txt": "one", "b.txt": "two", "c.txt": "three"}))
    third = whole.rfind(b"PK\x01\x02")
    rows = list(zipscan.scan_archive(whole[:third] + b"XX" + whole[third + 2 :]))
    assert [(r[1], r[5]) for r in rows] == [("a.txt", b"one"), ("b.txt", b"two")]
    assert [r[1] for r in zipscan.scan_archive(whole)] == ["a.txt", "b.txt", "c.txt"]
    assert next(zipscan.scan_archive(whole[:third]))[6].startswith("not an archive")


def build_pdf(objects, trailer=b"<< /Root 1 0 R >>"):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return bytearray(b"%PDF-1.4\n" + body + b"trailer\n" + trailer)


def stream(data, extra=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), extra, data)


def three_pages():
    text = lambda s: stream(zlib.compress(b"BT /F1 12 Tf 72 700 Td (%s) Tj ET" % s), b"/Filter /FlateDecode")
    page = lambda c, extra=b"": b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (c, extra)
    return [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 9 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> >> >>",
        page(6), page(7), page(8),
        text(b"Front page text here."), text(b"Hello \\(one\\) world."), text(b"Last page words."),
        b"<< /First 10 0 R >>", b"<< /Title (Part A) /Dest [4 0 R /Fit] /Next 11 0 R >>", b"<< /Title <FEFF00C4> /A << /D [5 0 R /Fit] >> >>", b"<< /Title (My Book) /Author (Ann) >>",
    ]


def test_pdf(spark):
    out = pdf.parse_pdf(files(spark, build_pdf(three_pages(), b"<< /Root 1 0 R /Info 12 0 R >>"), bytearray(b"nothing")))
    info = {r.book_id: r for r in out["books"].collect()}
    assert (info["b0"].title, info["b0"].author, info["b0"].page_count) == ("My Book", "Ann", 3)
    assert info["b1"].error == "not a PDF file"
    got = [(r.title, r.content) for r in out["chapters"].orderBy("chapter_no").collect()]
    assert got == [("Part A", "Hello (one) world."), ("Ä", "Last page words.")]
    stats = out["stats"].first()
    assert (stats.page_count, stats.chapter_count, stats.outline_count, stats.scanned) == (3, 2, 2, False)
    single = pdf.parse_pdf(files(spark, build_pdf(three_pages())), pdf.Options(by_page=True))["chapters"].orderBy("chapter_no").collect()
    assert [r.title for r in single] == ["第 1 页", "第 2 页", "第 3 页"]
    assert pdf.parse_pdf(files(spark, build_pdf(three_pages())), pdf.Options(max_pages=1))["pages"].count() == 1


def test_pdf_images(spark):
    pixels = bytes(range(12))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>",
        b"<< /Type /Page /Contents 4 0 R /Resources << /XObject << /Im0 5 0 R /Im1 6 0 R >> >> >>",
        stream(b"BT (Above.) Tj ET /Im0 Do /Im0 Do /Im1 Do BT (Below.) Tj ET"),
        stream(zlib.compress(pixels), b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode"),
        stream(b"\xff\xd8\xff", b"/Subtype /Image /Width 10000 /Height 10000 /Filter /DCTDecode"),
    ]
    out = pdf.parse_pdf(files(spark, build_pdf(objects)))
    content = out["chapters"].first().content
    assert content.index("Above.") < content.index("data:image/png") < content.index("Below.") and content.count("data:image/png") == 1
    assert {r.name: r.media_type for r in out["images"].collect()} == {"Im0": "image/png", "Im1": None}
    assert pdf.covers(out["images"]).count() == 0  # the largest can't be read
    none = pdf.parse_pdf(files(spark, build_pdf(objects)), pdf.Options(image_mode="none"))["chapters"].first()
    assert "<img" not in none.content
    assert bytes(pdf.page_image(files(spark, build_pdf(objects)), 0).first().data)[:4] == b"\x89PNG"


GRAY = stream(bytes(4), b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8")


def test_pdf_images_of_forms(spark):
    """Images that a form draws are its own, also if the page has another one of the name."""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Contents 4 0 R /Resources << /XObject << /Im0 6 0 R /F 5 0 R /G 8 0 R >> >> >>",
        stream(b"/Im0 Do /F Do /G Do BT (Text.) Tj ET"),
        stream(b"/Im0 Do", b"/Subtype /Form /Resources << /XObject << /Im0 7 0 R >> >>"), GRAY, GRAY.replace(b"Width 2", b"Width 1"),
        stream(b"/Deep Do", b"/Subtype /Form /Resources << /XObject << /Deep 7 0 R >> >>"),
    ]
    out = pdf.parse_pdf(files(spark, build_pdf(objects), build_pdf([o.replace(b"/Im0 6 0 R", b"/None 6 0 R") for o in objects])))
    assert [(r.book_id, r.name, r.area) for r in out["images"].orderBy("book_id", "pos").collect()] == [("b0", "Im0", 4), ("b0", "Im0#2", 2), ("b0", "Deep", 2), ("b1", "Im0", 2), ("b1", "Deep", 2)]
    assert [r.content.count("<img") for r in out["chapters"].orderBy("book_id").collect()] == [3, 2]
    from quirework.sources.pdfscan import Document

    assert Document(bytes(build_pdf(objects))).pages()[0].box == [0.0, 0.0, 612.0, 792.0]


def test_pdf_deep_trees():
    n = 1500
    marks = [b"<< /Title (T%d) /Dest [4 0 R /Fit] %s >>" % (i, b"/First %d 0 R" % (6 + i) if i < n - 1 else b"") for i in range(n)]
    rows = list(scan(bytes(build_pdf([b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", b"<< /Kids [4 0 R] >>", b"<< /First 5 0 R >>", b"<< /Type /Page >>", *marks]))))
    assert [(r["title"], r["level"]) for r in rows if r["kind"] == "outline"] == [(f"T{i}", i) for i in range(n)]
    kids = [b"<< /Kids [%d 0 R] >>" % (3 + i) for i in range(n)]
    assert [r["kind"] for r in scan(bytes(build_pdf([b"<< /Type /Catalog /Pages 2 0 R >>", *kids, b"<< /Type /Page >>"])))] == ["info", "page"]
    order = [b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", b"<< /Kids [] >>", b"<< /First 4 0 R >>", b"<< /Title (a) /First 5 0 R /Next 6 0 R >>", b"<< /Title (b) >>", b"<< /Title (c) >>"]
    assert [r["title"] for r in scan(bytes(build_pdf(order))) if r["kind"] == "outline"] == ["a", "b", "c"]


def test_pdf_broken_files():
    """Cut and changed files give rows, and one of kind error at most."""
    r = random.Random(7)
    whole = bytes(build_pdf([*three_pages(), GRAY], b"<< /Root 1 0 R /Info 12 0 R >>"))
    for i in range(400):
        data = bytearray(whole[: r.randrange(8, len(whole))] if i % 2 else whole)
        for _ in range(r.randrange(0, 6)):
            data[r.randrange(8, len(data))] = r.choice(b"<>[]()/0 R\xff")
        rows = list(scan(bytes(data)))
        assert rows and sum(x["kind"] == "error" for x in rows) <= 1


def titled(pages, marks, extra=b""):
    """A file with a page for each (content, image?) and a bookmark for each (title, page)."""
    n, m = len(pages), len(marks)
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", b"<< /Kids [%s] /Resources << /XObject << /Im0 %d 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (4 + i) for i in range(n)), 4 + 2 * n + m), b"<< /First %d 0 R >>" % (4 + 2 * n)]
    objects += [b"<< /Type /Page /Contents %d 0 R >>" % (4 + n + i) for i in range(n)]
    objects += [stream(b"BT <%s> Tj ET %s" % (text.encode("cp1252").hex().encode(), b"/Im0 Do" if image else b"")) for text, image in pages]
    objects += [b"<< /Title <FEFF%s> /Dest [%d 0 R /Fit] %s >>" % (t.encode("utf-16-be").hex().encode(), 4 + p, b"/Next %d 0 R" % (5 + 2 * n + i) if i < m - 1 else b"") for i, (t, p) in enumerate(marks)]
    return build_pdf([*objects, GRAY])


def test_pdf_merge_keeps_contents(spark):
    """A page that has its title only is drawn into the next chapter with its content; one that isn't keeps it."""
    both = [("\u7b2c\u4e00\u7ae0", 0), ("\u756a\u5916 \u540d", 1)]
    pages = [("", False), ("Body of it.", True)]
    got = pdf.parse_pdf(files(spark, titled(pages, both)), pdf.Options())["chapters"].collect()
    assert [(r.title, r.image_count, r.first_page, r.end_page) for r in got] == [("\u7b2c\u4e00\u7ae0 \u756a\u5916 \u540d", 1, 0, 2)] and "Body of it." in got[0].content
    # Its text is its title, and it has an image: both are kept by the merge
    named = titled([("One", True), ("Body.", True)], [("One", 0), ("Two", 1)])
    merged = pdf.parse_pdf(files(spark, named), pdf.Options(entries=("One Two",)))["chapters"].collect()
    assert [(r.title, r.image_count, r.content.count("<img"), "One" in r.content) for r in merged] == [("One Two", 2, 2, True)]
    with_column = files(spark, named).withColumn("entries", F.array(F.lit("One Two")))
    assert pdf.parse_pdf(with_column)["chapters"].count() == 1
    alone = pdf.parse_pdf(files(spark, named))["chapters"].orderBy("chapter_no").collect()
    assert [(r.title, r.image_count, r.content.count("<img")) for r in alone] == [("One", 1, 1), ("Two", 1, 1)] and "One" in alone[0].content


def test_epub_merge_keeps_contents(spark):
    one = "<html><body><h1 class='big'>Alpha</h1></body></html>"
    two = "<html><body><h2>Beta</h2><p>Words.</p></body></html>"
    book = sample(**{"OEBPS/text/1.xhtml": one, "OEBPS/text/2.xhtml": two})
    alone = epub.parse_epub(files(spark, book))["chapters"].orderBy("chapter_no").collect()
    assert [c.title for c in alone] == ["Alpha", "Beta"] and "<h1 class='big'>Alpha</h1>" in alone[0].content
    merged = epub.parse_epub(files(spark, book), epub.Options(entries=("Alpha Beta",)))["chapters"].collect()
    assert [c.title for c in merged] == ["Alpha Beta"] and "Words." in merged[0].content and "big" not in merged[0].content


def test_pdf_parts():
    assert Reader(b"<< /A#20b [1 -2.5 (a\\(b\\051) <48656C6C> 3 0 R true] /N null >>").value()["A b"][:4] == [1, -2.5, b"a(b)", b"Hell"]
    assert to_unicode(b"1 beginbfchar <0001> <4E2D> <02> <> endbfchar 1 beginbfrange <10> <12> <0041> <20> <21> [<0061> <0062>] endbfrange") == {1: "中", 2: "", 16: "A", 17: "B", 18: "C", 32: "a", 33: "b"}
    assert ascii85(b"<~87cURDZ~>") == b"Hello" and inflate(zlib.compress(b"x")[2:-4]) == b"x"
    assert unpredict(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 15, "Columns": 2}) == bytes([1, 2, 2, 3])
    packed = b"5 0 6 3 [7] (x)"
    rows = list(scan(bytes(build_pdf([b"<< /Type /Catalog /Pages 3 0 R >>", stream(packed, b"/Type /ObjStm /N 2 /First 8"), b"<< /Kids [4 0 R] >>", b"<< /Type /Page >>"]))))
    assert [r["kind"] for r in rows] == ["info", "page"]
    assert next(scan(None))["kind"] == "error"


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "books"))
    assert c.books().count() == 0
    c.insert(spark.createDataFrame([("A", "/a.epub"), ("B", "/b.txt")], "title string, stored_path string"))
    c.insert(spark.createDataFrame([("C", "/c.pdf")], "title string, stored_path string"))
    assert [(r.id, r.title, r.author) for r in c.books().orderBy("id").collect()] == [(1, "A", ""), (2, "B", ""), (3, "C", "")]
    c.update(spark.createDataFrame([(1, "A2", " "), (2, None, " /x ")], "id long, title string, cover_img string"))
    assert [(r.title, r.cover_img) for r in c.books().orderBy("id").collect()] == [("A2", ""), ("B", "/x"), ("C", "")]
    c.delete(spark.createDataFrame([(2,)], "id long"))
    assert [r.id for r in c.list().collect()] == [3, 1] and c.get(2).count() == 0
    api = {r.id: r for r in catalog.as_api(c.books(), "http://h").collect()}
    assert api[1].storedPath == "/a.epub"
    assert catalog.migrate(spark.createDataFrame([(1, "x")], "id int, title string")).columns == catalog.SCHEMA.names
    parsed = spark.createDataFrame([(3, "P", "Q", None)], "id long, title string, author string, description string")
    assert catalog.enrich(c.books(), parsed).where("id = 3").first().author == "Q"
    assert c.books().select(catalog.default_cover(F.col("id"), F.col("cover_img"), F.col("stored_path")).alias("x")).where("x like '%id=3'").count() == 1


@pytest.fixture
def many(spark):
    """Rows whose ranges are merged otherwise once a wide column is read, and their number."""
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    n, key = 20_000, F.pmod(F.col("id") * 7919, F.lit(20_000))
    yield spark.range(0, n, 1, 3).select(key.alias("id"), F.sha2(key.cast("string"), 512).alias("title"), F.format_string("/c/%09d", key).alias("stored_path"), (key % 40).cast("string").alias("created_at")), n
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_catalog_insert_numbers_many(spark, many):
    rows, n = many
    books = catalog.migrate(spark.createDataFrame([(7, "A")], "id long, title string"))
    got = catalog.insert_books(books, rows.drop("id").withColumn("created_at", F.lit("2030"))).select("id", "title", "stored_path").collect()
    assert len(got) == n + 1 and {r.stored_path: r.id for r in got if r.stored_path} == {f"/c/{k:09d}": k + 8 for k in range(n)}


def test_catalog_list_numbers_many(many):
    rows, n = many
    got = {r.id: r.place for r in catalog.listed(catalog.migrate(rows)).select("id", "title", "place").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (str(i % 40), i), reverse=True), 1)}


def test_catalog_list_equals_its_sql(spark, many):
    """On 150,000 orders: test_registered_queries_equal_their_sql has 1,500, which one range holds."""
    import os

    import duckdb

    from quirework.plans.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = con.execute(f"SELECT id, title, created_at, place FROM ({ORACLES['catalog_list']})").fetchall()
    got = QUERIES["catalog_list"](spark, sf).select("id", "title", "created_at", "place").collect()
    assert sorted(map(tuple, got)) == sorted(want)
