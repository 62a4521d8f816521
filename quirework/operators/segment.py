"""Lines to chapters and paragraphs: heading predicates, segments, merges.

A text's lines become rows; neighbours are read with lag and lead, running counts number the segments, and each
segment is gathered in order again. Only the merge of headings without a body is a fold, over the few headings of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import WS, collapse, no_space, strip, title_text
from quirework.operators.rules import Rules

#: Line endings that close a sentence, and marks that begin list items.
CLOSERS = ("。", "！", "？", "；", "：", "”", '"', "…", "」", "』", "】")
ITEM_MARKS = ("【", *map(chr, range(0x2460, 0x2474)))
BREAK = "<br/>\n"


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_sequence(line: Column) -> Column:
    """Page numbers and the like."""
    return line.startswith("-") & line.endswith("-") & (F.length(line) < 5)


def is_ignored(line: Column, rules: Rules) -> Column:
    return _any([line.rlike(p) for p in rules.ignorePatterns])


def has_marker(line: Column, rules: Rules) -> Column:
    """Begins with prefix, number and keyword."""
    prefix = rules.chapterPrefix or "第"
    m = Rules(chapterPrefix=prefix).marker(rules.chapterKeywords)
    return line.rlike("^" + m) if m else F.lit(False)


def is_title(line: Column, rules: Rules) -> Column:
    """Whether a line is a heading under the rules."""
    prefix, words = rules.chapterPrefix, [w for w in rules.chapterKeywords if w]
    strict, ends = rules.marker(rules.chapterKeywords), rules.marker(rules.chapterSuffixes)
    starts = F.lit(False)
    if prefix:
        starts = line.startswith(prefix)
        if rules.strictNumberMode and strict:
            starts = starts & line.rlike("^" + strict)
    starts = (starts & _any([F.contains(line, F.lit(w)) for w in words])) | _any([line.startswith(w) for w in rules.titleStarts if w])
    ending = _any([line.endswith(w) for w in rules.chapterSuffixes if w]) & (line.rlike(ends) if ends else F.lit(False))
    holds = _any([F.contains(line, F.lit(w)) for w in (*rules.chapterSuffixes, *rules.titleContains) if w])
    short = F.instr(line, "卷").between(1, 5) | (F.contains(line, F.lit("序")) & (F.length(line) < 15))
    valid = (F.length(line) >= rules.minTitleLength) & (F.length(line) < rules.maxTitleLength)
    content = ((line == "序") | starts | ending) & (starts | holds | short)
    return F.when(~content & line.startswith("序章"), valid | (line == "序")).otherwise(content & (valid | (line == "序")))


#: What decides that the line before a subtitle is a heading: nothing but a length.
_BARE = Rules(chapterPrefix="", chapterSuffixes=(), chapterKeywords=("章", "回", "节"), titleStarts=(), titleContains=("创作手记", "后记", "楔子"), minTitleLength=1)


def closes(line: Column, next_raw: Column) -> Column:
    """Whether a line keeps its line break: it ends a sentence, or the next line is blank."""
    wrapped = _any([line.startswith(a) & line.endswith(b) for a, b in (("…", "…"), ("“", "”"), ('"', '"'))])
    return _any([line.endswith(c) for c in CLOSERS]) | wrapped | F.coalesce(strip(next_raw) == "", F.lit(False))


def maybe_title(line: Column, raw: dict[int, Column], rules: Rules) -> Column:
    """Subtitles right after a bare heading, and short lines that stand alone. raw: the raw lines at -2 .. 2."""
    ends = _any([raw[-1].endswith(w) | (line.endswith(w) & ~closes(line, raw[1])) for w in rules.chapterSuffixes if w])
    after = F.coalesce(is_title(raw[-1], _BARE) & ends, F.lit(False)) & ~closes(line, raw[1])
    blank = lambda i: F.coalesce(strip(raw[i]) == "", F.lit(False))
    return after | (blank(-1) & blank(-2) & blank(1) & blank(2) & (F.length(line) < 30) & ~_any([line.startswith(m) for m in ITEM_MARKS]))


def fits_entry(line: Column, entries: Column) -> Column:
    """Whether an expected heading equals the line, or the shorter of the two is a large enough part of the other."""
    a = no_space(line)

    def fits(e: Column) -> Column:
        b = no_space(e)
        short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
        part = F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
        return (a != "") & (b != "") & ((a == b) | (part & (short >= F.greatest(F.lit(4), F.ceil(long * 0.5)))))

    return F.coalesce(F.exists(entries, fits), F.lit(False))


def directory_entries(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), strip), lambda x: x != "")


def flagged_lines(books: DataFrame, rules: Rules) -> DataFrame:
    """(book_id, pos, line, title, body) of the lines of ``books(book_id, text, entries)`` that aren't dropped."""
    raw = books.select("book_id", "entries", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "raw"))
    w = Window.partitionBy("book_id").orderBy("pos")
    near = {i: (F.lag("raw", -i) if i < 0 else F.lead("raw", i)).over(w) for i in (-2, -1, 1, 2)}
    raw = raw.select("*", *[c.alias(f"r{i + 2}") for i, c in near.items()]).withColumn("line", strip(F.col("raw")))
    raw = raw.where((F.col("line") != "") & ~is_sequence(F.col("line")) & ~is_ignored(F.col("line"), rules))
    line, r = F.col("line"), {i: F.col(f"r{i + 2}") for i in (-2, -1, 1, 2)}
    body = F.when(maybe_title(line, r, rules) | closes(line, r[1]), F.concat(line, F.lit(BREAK))).otherwise(line)
    return raw.select("book_id", "pos", "line", (is_title(line, rules) | fits_entry(line, F.col("entries"))).alias("title"), body.alias("body"))


def chapters(books: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(book_id, chapter_no, title, content) before headings are merged; a heading at the very end without a body is lost.

    A heading that another one follows has itself as content. What comes before the first heading is a chapter that
    its first line names if it is short, or its number.
    """
    rules = rules or Rules()
    lines = flagged_lines(books, rules)
    w = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seg = lines.withColumn("seg", F.sum(F.col("title").cast("int")).over(w))
    found = seg.groupBy("book_id", "seg").agg(
        F.max(F.when(F.col("title"), F.col("line"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("title"), F.struct("pos", "body")))), lambda x: x["body"]), "").alias("text"),
    )
    last = F.max("seg").over(Window.partitionBy("book_id"))
    found = found.withColumn("last", last).where(~((F.col("seg") == F.col("last")) & (strip(F.col("text")) == "")))
    found = found.where(F.col("heading").isNotNull() | (strip(F.col("text")) != ""))
    content = F.when(strip(F.col("text")) == "", F.col("heading")).otherwise(strip(F.col("text")))
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("seg"))
    found = found.select("book_id", no.alias("chapter_no"), "heading", content.alias("content"))
    return found.select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), chapter_title(F.col("heading"), F.col("content"), F.col("chapter_no")).alias("title"), "content")


def chapter_title(heading: Column, content: Column, number: Column) -> Column:
    """The heading, or else the first piece of the content if it is short, or else the chapter's number."""
    first = F.substring_index(content, BREAK, 1)
    auto = F.when(F.length(first) < 30, first).otherwise(F.concat(F.lit("第"), number.cast("string"), F.lit("章[自动]")))
    return title_text(F.coalesce(F.when(heading != "", heading), auto))


def merged_title(a: Column, b: Column, rules: Rules, entries: Column) -> Column:
    """One heading of two, or '' if they don't make one."""
    both = [F.concat_ws(" ", a, b), F.concat(a, b)]
    equal = [F.when(F.exists(entries, _same(x)), x) for x in both]
    fits = [F.when(is_title(x, rules), x) for x in both]
    found = F.coalesce(*equal, *fits, F.lit(""))
    return F.when((a == "") | (b == "") | has_marker(b, rules) | both[0].rlike("[。！？；，、]"), "").otherwise(found)


def _same(x: Column):
    return lambda e: no_space(e) == no_space(x)


def merge_title_only(chaps: DataFrame, books: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Chapters with headings that have no body drawn into the next one that has, from right to left while one fits.

    ``parts`` are the numbers of the chapters that each is made of; its content is the last one's. A column ``bare`` of
    ``chaps`` says which ones have no body; without it these are those whose content is empty or the title.
    """
    rules = rules or Rules()
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    rows = chaps.join(books.select("book_id", "entries"), "book_id")
    if "bare" not in chaps.columns:
        rows = rows.withColumn("bare", (strip(F.col("content")) == "") | (F.col("content") == F.col("title")))
    # A run is the headings without a body and the chapter with one that follows them
    rows = rows.withColumn("run", F.coalesce(F.sum((~F.col("bare")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = rows.groupBy("book_id", "run").agg(F.array_sort(F.collect_list(F.struct("chapter_no", "title", "content", "bare"))).alias("c"), F.first("entries").alias("entries"))
    kind = "array<struct<title:string,content:string,parts:array<bigint>>>"
    none = F.lit(None).cast("string")
    zero = F.struct(none.alias("title"), none.alias("content"), F.array().cast("array<bigint>").alias("parts"), F.lit(True).alias("open"), F.array().cast(kind).alias("done"))

    def item(acc: Column) -> Column:
        return F.struct(acc["title"].alias("title"), acc["content"].alias("content"), acc["parts"].alias("parts"))

    def step(acc: Column, c: Column) -> Column:
        """acc: the chapter that still takes headings, and what is done, last first."""
        one = F.array(c["chapter_no"].cast("long"))
        new = F.struct(c["title"].alias("title"), c["content"].alias("content"), one.alias("parts"), (~c["bare"]).alias("open"), acc["done"].alias("done"))
        m = merged_title(c["title"], acc["title"], rules, F.col("entries"))
        pushed = F.struct(c["title"].alias("title"), c["content"].alias("content"), one.alias("parts"), F.lit(False).alias("open"), F.concat(acc["done"], F.array(item(acc))).alias("done"))
        joined = F.struct(m.alias("title"), acc["content"].alias("content"), F.concat(one, acc["parts"]).alias("parts"), (m != acc["content"]).alias("open"), acc["done"].alias("done"))
        return F.when(acc["title"].isNull(), new).when(acc["open"] & c["bare"] & (m != ""), joined).otherwise(pushed)

    folded = F.aggregate(F.reverse("c"), zero, step, lambda a: F.reverse(F.concat(a["done"], F.array(item(a)))))
    out = runs.select("book_id", "run", F.posexplode(folded).alias("at", "x"))
    no = F.row_number().over(Window.partitionBy("book_id").orderBy("run", "at"))
    return out.select("book_id", no.cast("long").alias("chapter_no"), F.col("x.title").alias("title"), F.col("x.content").alias("content"), F.col("x.parts").alias("parts"))


def parse_text(books: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(book_id, chapter_no, title, content) of ``books(book_id, text, entries array<string>)``."""
    return merge_title_only(chapters(books, rules), books, rules).drop("parts")


def with_entries(files: DataFrame, entries: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, entries): the headings that are expected of each book, by its own column ``entries`` or else for all alike."""
    given = F.array(*map(F.lit, entries)).cast("array<string>")
    return files.select(F.col("book_id").cast("string").alias("book_id"), (F.coalesce("entries", given) if "entries" in files.columns else given).alias("entries"))


#: What ends a paragraph.
PARAGRAPH_END = "。！？；：…—”\"'）】》」』〕）]．.!?;"
#: A character that isn't white space.
NOT_BLANK = WS.replace("[", "[^", 1)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, paragraph) of ``lines(doc_id, pos, line)``.

    A line goes on with what came before unless that ends a sentence or has fewer than eight characters so far.
    """
    # The filter asks the line, so that it doesn't work out t a second time
    clean = lines.where(F.col("line").rlike(NOT_BLANK)).withColumn("t", collapse(F.col("line")))
    signal = F.when(F.contains(F.lit(PARAGRAPH_END), F.right("t", F.lit(1))), True).when(F.length("t") >= 8, False)
    w = Window.partitionBy("doc_id").orderBy("pos")
    flagged = clean.withColumn("signal", signal)
    start = F.coalesce(F.last("signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = flagged.withColumn("start", start).withColumn("n", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = numbered.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("c"))
    return gathered.select("doc_id", F.col("n").cast("long").alias("paragraph_no"), F.array_join(F.transform("c", lambda x: x["t"]), "").alias("paragraph"))


def within_budget(sizes: Column, budget: Column) -> Column:
    """Array of booleans: which sizes, in order, are taken; what doesn't fit is passed over and uses nothing up."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("took"))

    def step(acc: Column, n: Column) -> Column:
        ok = acc["used"] + n <= budget
        return F.struct((acc["used"] + F.when(ok, n).otherwise(0)).cast("long").alias("used"), F.array_append(acc["took"], ok).alias("took"))

    return F.aggregate(sizes, zero, step, lambda a: a["took"])


def nav_levels(html: Column) -> Column:
    """Array of (pos, level, href, title) of the anchors of a navigation; the level counts open ordered lists, from 0."""
    tokens = F.regexp_extract_all(html, F.lit("(?is)<ol\\b[^>]*>|</ol>|<a\\b[^>]*>.*?</a>"), F.lit(0))
    kind = "array<struct<pos:int,level:int,tag:string>>"
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast(kind).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens, ends = t.rlike("(?i)^<ol\\b"), t.rlike("(?i)^</ol>")
        depth = F.when(opens, acc["depth"] + 1).when(ends, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        item = F.struct(F.size(acc["out"]).alias("pos"), F.greatest(acc["depth"] - 1, F.lit(0)).alias("level"), t.alias("tag"))
        return F.struct(depth.alias("depth"), F.when(opens | ends, acc["out"]).otherwise(F.array_append(acc["out"], item)).alias("out"))

    return F.aggregate(tokens, zero, step, lambda a: a["out"])

