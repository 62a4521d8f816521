"""EPUB books: package, spine, contents, images, notes and statistics as DataFrames over archive entries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import segment
from quirework.operators.notes import TITLE, chapter_notes
from quirework.operators.rules import Rules
from quirework.plans.staging import stage
from quirework.sources.zipscan import resolve, zip_entries

MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """How a book is to be read. image_mode: inline, url or none; a budget of 0 has no bound."""

    image_mode: str = "inline"
    image_base: str = ""
    max_image_bytes: int = 8 * MIB
    max_inline_bytes: int = 0
    max_chapters: int = 0
    collect_notes: bool = True
    inline_styles: bool = True
    inline_fonts: bool = False
    notes_title: str = ""
    image_chapter: int = 0
    image_href: str = ""
    rules: Rules = field(default_factory=Rules)
    entries: tuple[str, ...] = ()

    def __post_init__(self):
        if self.image_mode not in ("inline", "url", "none"):
            raise ValueError("image_mode is inline, url or none")
        if self.image_base and not re.fullmatch(r"[\w./:-]{1,200}(\?.*)?", self.image_base):
            raise ValueError("image_base has other characters than an address path")


def _items(doc: Column, tag: str) -> Column:
    """All start tags of a name, with or without a namespace."""
    return F.regexp_extract_all(doc, F.lit(f"(?is)<(?:[a-z0-9]+:)?{tag}\\b[^>]*>"), F.lit(0))


def _element(doc: Column, tag: str) -> Column:
    return t.clean_title(F.regexp_extract(doc, f"(?is)<(?:[a-z0-9]+:)?{tag}\\b[^>]*>(.*?)</(?:[a-z0-9]+:)?{tag}>", 1))


def packages(entries: DataFrame) -> DataFrame:
    """(book_id, opf_path, base, opf, error): the package document that the container names, or the first one there is."""
    docs = entries.where("name is not null")
    container = docs.where(F.lower("name") == "meta-inf/container.xml").select("book_id", t.attribute(F.regexp_extract(t.decode_text(F.col("data")), "(?is)<(?:[a-z0-9]+:)?rootfile\\b[^>]*>", 0), "full-path").alias("named"))
    opf = docs.where(F.lower("name").endswith(".opf")).join(container, "book_id", "left")
    best = opf.groupBy("book_id").agg(F.min_by(F.struct("name", "data"), F.struct((~(F.lower("name") == F.lower("named"))).alias("other"), "pos")).alias("x"))
    errors = entries.groupBy("book_id").agg(F.max(F.when(F.col("name").isNull(), F.col("error"))).alias("broken"))
    out = errors.join(best, "book_id", "left")
    return out.select("book_id", F.col("x.name").alias("opf_path"), t.path_dir(F.col("x.name")).alias("base"), t.decode_text(F.col("x.data")).alias("opf"), F.coalesce("broken", F.when(F.col("x").isNull(), "no package document")).alias("error"))


def metadata(pkg: DataFrame) -> DataFrame:
    names = {"title": "title", "author": "creator", "description": "description", "language": "language", "identifier": "identifier", "publisher": "publisher", "date": "date"}
    metas = F.transform(_items(F.col("opf"), "meta"), t.attributes)
    return pkg.select("book_id", *[_element(F.col("opf"), tag).alias(n) for n, tag in names.items()], metas.alias("metas"), "error")


def manifest(pkg: DataFrame) -> DataFrame:
    """(book_id, pos, id, href, path, media_type, properties); of repeated ids the last counts."""
    rows = pkg.select("book_id", "base", F.posexplode(_items(F.col("opf"), "item")).alias("pos", "tag")).withColumn("a", t.attributes(F.col("tag")))
    get = lambda n: F.try_element_at("a", F.lit(n))
    rows = rows.select("book_id", "pos", get("id").alias("id"), get("href").alias("href"), t.join_path(F.col("base"), get("href")).alias("path"), F.coalesce(get("media-type"), F.lit("")).alias("media_type"), F.coalesce(get("properties"), F.lit("")).alias("properties")).where("id is not null and href is not null")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("book_id", "id").orderBy(F.desc("pos")))).where("k = 1").drop("k")


def spine(pkg: DataFrame, items: DataFrame) -> DataFrame:
    """The manifest's items in reading order, with linear."""
    refs = pkg.select("book_id", F.posexplode(_items(F.col("opf"), "itemref")).alias("spine_pos", "tag")).withColumn("a", t.attributes(F.col("tag")))
    refs = refs.select("book_id", "spine_pos", F.try_element_at("a", F.lit("idref")).alias("id"), F.coalesce(F.try_element_at("a", F.lit("linear")) != "no", F.lit(True)).alias("linear"))
    return refs.join(items, ["book_id", "id"])


def guide(pkg: DataFrame) -> DataFrame:
    rows = pkg.select("book_id", F.posexplode(_items(F.col("opf"), "reference")).alias("pos", "tag")).withColumn("a", t.attributes(F.col("tag")))
    get = lambda n: F.try_element_at("a", F.lit(n))
    return rows.select("book_id", "pos", F.lower(get("type")).alias("type"), get("href").alias("href"), get("title").alias("title"))


def toc(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(book_id, pos, title, href, key, level): of the NCX, or else of the navigation document."""
    named = resolve(items.where("lower(media_type) like '%ncx%' or lower(href) like '%.ncx' or properties like '%nav%'"), entries)
    docs = named.join(entries.select("book_id", F.col("name").alias("entry"), "data"), ["book_id", "entry"]).withColumn("doc", t.decode_text(F.col("data")))
    is_nav = F.col("properties").contains("nav")
    points = F.regexp_extract_all("doc", F.lit("(?is)<(?:[a-z0-9]+:)?navPoint\\b.*?<(?:[a-z0-9]+:)?content\\b[^>]*>"), F.lit(0))
    ncx = docs.where(~is_nav).select("book_id", F.lit(0).alias("rank"), t.path_dir(F.col("entry")).alias("dir"), F.posexplode(points).alias("pos", "x"))
    ncx = ncx.select("book_id", "rank", "dir", "pos", F.lit(0).alias("level"), t.attribute(F.regexp_extract("x", "(?is)<(?:[a-z0-9]+:)?content\\b[^>]*>", 0), "src").alias("href"), t.clean_title(F.regexp_extract("x", "(?is)<(?:[a-z0-9]+:)?text\\b[^>]*>(.*?)</", 1)).alias("title"))
    block = F.coalesce(*[F.nullif(F.regexp_extract("doc", p, 0), F.lit("")) for p in ("(?is)<nav\\b[^>]*epub:type=[\"'][^\"']*toc[^>]*>.*?</nav>", "(?is)<nav\\b[^>]*>.*?</nav>")], F.col("doc"))
    nav = docs.where(is_nav).select("book_id", F.lit(1).alias("rank"), t.path_dir(F.col("entry")).alias("dir"), F.explode(segment.nav_levels(block)).alias("a"))
    nav = nav.select("book_id", "rank", "dir", F.col("a.pos").alias("pos"), F.col("a.level").alias("level"), t.attribute(F.col("a.tag"), "href").alias("href"), t.clean_title(F.col("a.tag")).alias("title"))
    both = ncx.unionByName(nav).where("href <> ''")
    best = both.groupBy("book_id").agg(F.min("rank").alias("rank"))
    out = both.join(best, ["book_id", "rank"])
    return out.select("book_id", "pos", F.when(F.col("title") == "", F.col("href")).otherwise(F.col("title")).alias("title"), "href", t.href_key(t.join_path(F.col("dir"), F.col("href"))).alias("key"), "level")


def notes(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, chapter, n, id, text) of the notes of ``docs(book_id, entry, body)``, numbered by the place of their markers."""
    found = chapter_notes(docs, entries, stage).select("book_id", F.col("entry").alias("chapter"), F.posexplode("notes").alias("n", "x"))
    return found.select("book_id", "chapter", (F.col("n") + 1).alias("n"), F.col("x.id").alias("id"), F.col("x.content").alias("text"))


_URL = "(?i)url\\(\\s*(?:\"[^\"')]+\"|'[^\"')]+'|[^\"')]+)\\s*\\)"


def _addresses(css: Column) -> Column:
    """Array of the url(...) of a style sheet that name something in the archive."""
    return F.filter(F.regexp_extract_all(css, F.lit(_URL), F.lit(0)), lambda u: ~u.rlike("(?i)^url\\(\\s*[\"']?\\s*(?:data:|https?:|#|blob:)"))


def style_sheets(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, chapter_no, at, dir, css): the linked sheets and then the style elements of each chapter's head, in order."""
    head = docs.select("book_id", "chapter_no", "entry", F.regexp_extract("html", "(?is)<head\\b[^>]*>(.*?)</head>", 1).alias("head"))
    links = head.select("book_id", "chapter_no", "entry", F.posexplode(F.regexp_extract_all("head", F.lit("(?is)<link\\b[^>]*>"), F.lit(0))).alias("at", "tag")).withColumn("a", t.attributes(F.col("tag")))
    links = links.where(F.lower(F.try_element_at("a", F.lit("rel"))).contains("stylesheet") & (F.try_element_at("a", F.lit("href")) != ""))
    links = links.select("book_id", "chapter_no", "at", t.href_key(t.join_path(t.path_dir(F.col("entry")), F.try_element_at("a", F.lit("href")))).alias("path"))
    hit = resolve(stage(links), entries).where("entry is not null").join(entries.select("book_id", F.col("name").alias("entry"), "data"), ["book_id", "entry"])
    linked = hit.select("book_id", "chapter_no", F.lit(0).alias("kind"), "at", t.path_dir(F.col("entry")).alias("dir"), t.decode_text(F.col("data")).alias("css"))
    own = head.select("book_id", "chapter_no", F.lit(1).alias("kind"), F.posexplode(F.regexp_extract_all("head", F.lit("(?is)<style\\b[^>]*>(.*?)</style>"), F.lit(1))).alias("at", "css"), t.path_dir(F.col("entry")).alias("dir"))
    own = own.select("book_id", "chapter_no", "kind", "at", "dir", "css")
    no = F.row_number().over(Window.partitionBy("book_id", "chapter_no").orderBy("kind", "at"))
    return linked.unionByName(own).withColumn("at", no).drop("kind")


def _tags(chaps: DataFrame, sheets: DataFrame) -> DataFrame:
    """(book_id, chapter_no, k, tag, path, css): what names a resource, in the order in which budgets are spent.

    Addresses in a chapter's sheets come first, then its images, then the addresses in its style attributes.
    """
    kind = lambda no, at: F.concat_ws(".", F.lit(no), F.lpad(F.col(at).cast("string"), 6, "0"), F.lpad(F.col("i").cast("string"), 6, "0"))
    trimmed = F.regexp_replace(F.regexp_replace("tag", "(?i)^url\\(\\s*[\"']?\\s*", ""), "\\s*[\"']?\\s*\\)$", "")
    in_css = sheets.select("book_id", "chapter_no", "at", "dir", F.posexplode(_addresses(F.col("css"))).alias("i", "tag"))
    in_css = in_css.select("book_id", "chapter_no", kind("0", "at").alias("k"), "tag", "dir", trimmed.alias("href"), F.lit(True).alias("css"))
    images = chaps.select("book_id", "chapter_no", F.lit(0).alias("at"), t.path_dir(F.col("entry")).alias("dir"), F.posexplode(F.regexp_extract_all("body", F.lit("(?is)<(?:img|image)\\b[^>]*>"), F.lit(0))).alias("i", "tag"))
    images = images.select("book_id", "chapter_no", kind("1", "at").alias("k"), "tag", "dir", t.let(t.attributes(F.col("tag")), t.pick_image).alias("href"), F.lit(False).alias("css"))
    styles = F.flatten(F.transform(F.regexp_extract_all("body", F.lit("(?is)\\sstyle\\s*=\\s*(\"[^\"]*\"|'[^']*')"), F.lit(1)), _addresses))
    in_style = chaps.select("book_id", "chapter_no", F.lit(0).alias("at"), t.path_dir(F.col("entry")).alias("dir"), F.posexplode(styles).alias("i", "tag"))
    in_style = in_style.select("book_id", "chapter_no", kind("2", "at").alias("k"), "tag", "dir", trimmed.alias("href"), F.lit(True).alias("css"))
    every = images.unionByName(in_css).unionByName(in_style)
    return every.withColumn("path", t.href_key(t.join_path(F.col("dir"), F.col("href")))).drop("dir")


def _images(tags: DataFrame, entries: DataFrame, o: Options) -> DataFrame:
    """(book_id, chapter_no, k, tag, css, entry, n, image, state, new): each named resource and what stands for it.

    Sizes are admitted in reading order; what is too large or over the budget is an address, or nothing, and uses
    nothing up. Fonts and other assets are addresses unless inline_fonts is set.
    """
    hit = resolve(stage(tags), entries).join(entries.select("book_id", F.col("name").alias("entry"), F.col("usize").alias("n"), "data"), ["book_id", "entry"], "left").where("entry is not null")
    hit = hit.withColumn("image", t.is_image_type(t.media_type(F.col("entry"))))
    url = t.image_url(F.lit(o.image_base), href=F.col("entry")) if o.image_base else F.lit("")
    small = (F.col("n") <= o.max_image_bytes) if o.max_image_bytes > 0 else F.lit(True)
    asked = (F.col("chapter_no") == o.image_chapter) if o.image_chapter else F.lit(True)
    if o.image_href:
        asked = asked & (F.col("chapter_href") == o.image_href)
    asked = asked & (F.col("image") | F.lit(o.inline_fonts))
    hit = hit.withColumn("fits", small & F.lit(o.image_mode == "inline") & asked)
    if o.max_inline_bytes > 0:
        order = hit.groupBy("book_id").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("chapter_no", "k", "n")))).alias("o"))
        took = segment.within_budget(F.transform("o", lambda x: x["n"]), F.lit(o.max_inline_bytes).cast("long"))
        each = order.select("book_id", F.explode(F.arrays_zip(F.col("o"), took.alias("took"))).alias("x")).select("book_id", "x.o.chapter_no", "x.o.k", "x.took")
        hit = hit.join(each, ["book_id", "chapter_no", "k"], "left").withColumn("fits", F.coalesce("took", F.lit(False))).drop("took")
    source = F.when(F.col("fits"), t.data_uri(t.media_type(F.col("entry")), F.col("data"))).otherwise(url if o.image_mode != "none" else F.lit(""))
    state = F.when(F.col("fits"), "inline").when(F.lit(o.image_mode == "inline") & asked, "skipped").when(source != "", "url").otherwise("none")
    new = F.when(F.col("css"), F.when(source != "", F.concat(F.lit('url("'), source, F.lit('")'))).otherwise(F.col("tag"))).otherwise(F.when(source != "", t.image_tag(source)).otherwise(t.strip_lazy(F.col("tag"))))
    return hit.select("book_id", "chapter_no", "k", "tag", "css", "entry", "n", "image", state.alias("state"), new.alias("new"))


def parse_epub(files: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """books, chapters, toc, images, covers and stats of ``files(book_id, content)``; broken files have an error in books."""
    o = options or Options()
    entries = stage(zip_entries(files))
    pkg = stage(packages(entries))
    items = stage(manifest(pkg))
    contents = stage(toc(entries, items))
    order = resolve(stage(spine(pkg, items)), entries).where("entry is not null")
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("spine_pos"))
    order = order.withColumn("chapter_no", no)
    if o.max_chapters > 0:
        order = order.where(F.col("chapter_no") <= o.max_chapters)
    docs = order.join(entries.select("book_id", F.col("name").alias("entry"), "data"), ["book_id", "entry"]).withColumn("html", t.decode_text(F.col("data"))).withColumn("body", t.extract_body(F.col("html"))).drop("data")
    named = contents.groupBy("book_id", F.col("key").alias("entry")).agg(F.min_by("title", "pos").alias("toc_title"))
    docs = docs.join(named, ["book_id", "entry"], "left")
    heading = F.nullif(t.heading_title(F.col("body")), F.lit(""))
    docs = stage(docs).withColumn("title", F.coalesce(heading, F.nullif("toc_title", F.lit("")), F.concat(F.lit("第"), F.col("chapter_no").cast("string"), F.lit("章"))))
    docs = stage(docs.withColumn("has_images", F.col("body").rlike("(?i)<(?:img|image)\\b")))
    sheets = stage(style_sheets(docs, entries)) if o.inline_styles else style_sheets(docs.limit(0), entries)
    # Notes are drawn to the end before anything else, so that their images are treated alike
    if o.collect_notes:
        listed = F.array_join(F.transform("notes", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["content"])), "<br/>")
        ends = F.when(F.size("notes") > 0, F.concat(F.lit(f"<br/>{o.notes_title or TITLE}<br/>"), listed, F.lit("<br/>"))).otherwise("")
        drawn = chapter_notes(docs, entries, stage).select("book_id", "entry", F.concat("kept", ends).alias("drawn"))
        docs = stage(docs.join(drawn, ["book_id", "entry"]))
    else:
        docs = docs.withColumn("drawn", F.col("body"))
    named_tags = _tags(docs.withColumn("body", F.col("drawn")), sheets).join(docs.select("book_id", "chapter_no", F.col("entry").alias("chapter_href")), ["book_id", "chapter_no"])
    images = stage(_images(named_tags, entries, o))
    once = images.dropDuplicates(["book_id", "chapter_no", "tag"])
    pairs = lambda css: F.map_from_entries(F.collect_list(F.when(F.col("css") == css, F.struct("tag", "new"))))
    swaps = once.groupBy("book_id", "chapter_no").agg(pairs(False).alias("swap"), pairs(True).alias("urls"))
    docs = docs.join(swaps, ["book_id", "chapter_no"], "left")
    swap_urls = lambda text: F.aggregate(F.coalesce(F.map_entries("urls"), F.array().cast("array<struct<key:string,value:string>>")), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))
    shown = sheets.join(swaps, ["book_id", "chapter_no"], "left").withColumn("css", swap_urls(F.col("css")))
    css = shown.groupBy("book_id", "chapter_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "css"))), lambda x: x["css"]), "\n").alias("css"))
    docs = docs.join(css, ["book_id", "chapter_no"], "left")
    tokens = F.regexp_extract_all("clean", F.lit("(?s)<[^>]*>|[^<]+|<"), F.lit(0))
    docs = stage(docs.withColumn("clean", F.regexp_replace("drawn", "(?is)</?svg\\b[^>]*>", "")))
    one = lambda x: F.when(x.rlike("(?is)^<[^>]*\\sstyle\\s*=[^>]*url\\("), swap_urls(x)).otherwise(F.coalesce(F.try_element_at("swap", x), x))
    swapped = F.when(F.col("swap").isNull(), F.col("clean")).otherwise(F.array_join(F.transform(tokens, one), ""))
    docs = stage(docs.withColumn("swapped", swapped))
    styles = F.when(F.coalesce("css", F.lit("")) != "", F.concat(F.lit("<style>\n"), "css", F.lit("\n</style>\n"))).otherwise("")
    docs = docs.withColumn("content", t.sanitize_html(F.concat(styles, t.blockify(t.unwrap_images(F.col("swapped"))))))
    text = t.html_to_text(F.col("body"))
    # A chapter without a body is one whose text is its title; images count as a body
    bare = ~F.col("has_images") & ((t.no_space(text) == "") | (t.no_space(text) == t.no_space(F.col("title"))))
    rows = stage(docs.select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), "title", "content", bare.alias("bare"), F.col("entry").alias("href")))
    flat = rows.select("book_id", "chapter_no", "title", F.when(F.col("bare"), F.col("title")).otherwise("\u0001").alias("content"), "bare")
    merged = stage(segment.merge_title_only(flat, segment.with_entries(files, o.entries), o.rules))
    # A merged chapter's content is that of the one with a body; a heading that stays alone keeps its own
    last = merged.select("book_id", F.col("chapter_no").alias("no"), F.col("title").alias("heading"), "parts", F.element_at("parts", -1).alias("chapter_no"))
    chapters = last.join(rows.select("book_id", "chapter_no", "content", "href"), ["book_id", "chapter_no"]).select("book_id", F.col("no").alias("chapter_no"), F.col("heading").alias("title"), "content", "href")
    books = metadata(pkg)
    picture, inline = F.col("image"), F.col("state") == "inline"
    counted = images.groupBy("book_id").agg(F.count_distinct(F.when(picture, F.col("entry"))).alias("image_count"), F.count_if(picture & inline).alias("inlined_images"), F.sum(F.when(inline, F.col("n"))).alias("image_bytes"), F.count_if(F.col("state") == "skipped").alias("skipped_images"), F.count_if(~picture & F.col("state").isin("inline", "url")).alias("asset_count"), F.sum(F.when(~picture & inline, F.col("n"))).alias("asset_bytes"))
    stats = entries.groupBy("book_id").agg(F.count("name").alias("entries")).join(order.groupBy("book_id").agg(F.count("*").alias("spine_count")), "book_id", "left").join(chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count")), "book_id", "left").join(counted, "book_id", "left").fillna(0)
    return {"books": books, "chapters": chapters, "toc": contents, "images": images.where("image").drop("new", "css", "image"), "stats": stats.withColumn("image_mode", F.lit(o.image_mode)), "covers": covers(entries, pkg, items)}


def covers(entries: DataFrame, pkg: DataFrame, items: DataFrame) -> DataFrame:
    """(book_id, href, media_type, bytes, source, data): the meta's item, else the cover-image item, else the guide page's first image."""
    metas = pkg.select("book_id", F.explode(F.transform(_items(F.col("opf"), "meta"), t.attributes)).alias("a")).where(F.try_element_at("a", F.lit("name")) == "cover").select("book_id", F.try_element_at("a", F.lit("content")).alias("id"))
    by_meta = metas.join(items, ["book_id", "id"]).select("book_id", "path", F.lit(0).alias("rank"), F.lit("manifest").alias("source"))
    by_item = items.where("properties like '%cover-image%'").select("book_id", "path", F.lit(1).alias("rank"), F.lit("manifest").alias("source"))
    page = guide(pkg).where("type = 'cover'").join(pkg.select("book_id", "base"), "book_id").select("book_id", t.href_key(t.join_path(F.col("base"), F.col("href"))).alias("path"))
    pages = resolve(stage(page), entries).join(entries.select("book_id", F.col("name").alias("entry"), "data"), ["book_id", "entry"])
    tag = F.regexp_extract(t.decode_text(F.col("data")), "(?is)<(?:img|image)\\b[^>]*>", 0)
    by_page = pages.where(tag != "").select("book_id", t.href_key(t.join_path(t.path_dir(F.col("entry")), t.pick_image(t.attributes(tag)))).alias("path"), F.lit(2).alias("rank"), F.lit("page-image").alias("source"))
    hit = resolve(stage(by_meta.unionByName(by_item).unionByName(by_page)), entries).where("entry is not null")
    best = hit.groupBy("book_id").agg(F.min_by(F.struct("entry", "source"), "rank").alias("x")).select("book_id", F.col("x.entry").alias("name"), F.col("x.source").alias("source"))
    return best.join(entries.select("book_id", "name", "usize", "data"), ["book_id", "name"]).select("book_id", F.col("name").alias("href"), t.media_type(F.col("name")).alias("media_type"), F.col("usize").alias("bytes"), "source", "data")
