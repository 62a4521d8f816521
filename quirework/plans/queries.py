"""Registered queries over the driver's tables, each with the SQL to hold it against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import catalog, segment
from quirework.operators.rules import Rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def query(sql: str | None = None):
    """Registers a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{WS}", WS)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Books made of conversations: a heading for each turn, every third body left out, the next heading without a number.
def conversation_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    heading = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("番外 "), "role")).otherwise(F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("章")))
    part = F.concat(heading, F.lit("\n"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "\n")
    return c.groupBy(F.col("conv_id").alias("book_id")).agg(joined.alias("text")).withColumn("entries", F.array().cast("array<string>"))


BOOKS = """turns AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '番外 ' || role ELSE '第' || (turn + 1)::VARCHAR || '章' END || chr(10) || CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS t FROM conversations),
books AS (SELECT conv_id AS book_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id),
raw AS (SELECT book_id, (unnest(generate_series(1, len(l))) - 1)::BIGINT AS pos, unnest(l) AS raw FROM (SELECT book_id, string_split(text, chr(10)) AS l FROM books)),
near AS (SELECT *, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS line, lead(raw) OVER (PARTITION BY book_id ORDER BY pos) AS next FROM raw),
flagged AS (SELECT book_id, pos, line, length(line) BETWEEN 2 AND 19 AND (regexp_matches(line, '^第[0-9]+章') OR starts_with(line, '番外')) AS title,
  line || CASE WHEN regexp_matches(line, '[。！？；：”"…」』】]$') OR (next IS NOT NULL AND regexp_full_match(next, '{WS}*')) THEN '<br/>' || chr(10) ELSE '' END AS body FROM near WHERE line <> '')"""
CHAPTERS = BOOKS + """,
seg AS (SELECT *, sum(title::INT) OVER (PARTITION BY book_id ORDER BY pos) AS seg FROM flagged),
found AS (SELECT book_id, seg, max(CASE WHEN title THEN line END) AS title, coalesce(string_agg(CASE WHEN NOT title THEN body END, '' ORDER BY pos), '') AS text, max(max(seg)) OVER (PARTITION BY book_id) AS last FROM seg GROUP BY book_id, seg),
chapters AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seg) AS chapter_no, title, CASE WHEN trim(text) = '' THEN title ELSE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') END AS content FROM found WHERE NOT (seg = last AND trim(text) = ''))"""


@query(f"WITH {BOOKS} SELECT book_id, pos, line, title, body FROM flagged")
def txt_lines_flagged(spark, sf_dir):
    return segment.flagged_lines(conversation_books(spark, sf_dir), Rules()).select("book_id", F.col("pos").cast("long").alias("pos"), "line", "title", "body")


@query(f"WITH {CHAPTERS} SELECT book_id, chapter_no, title, content FROM chapters")
def txt_chapters(spark, sf_dir):
    return segment.chapters(conversation_books(spark, sf_dir))


@query(f"""WITH {CHAPTERS}, pairs AS (SELECT *, lag(title) OVER w AS t0, lag(content) OVER w AS c0, lead(title) OVER w AS t2, lead(content) OVER w AS c2 FROM chapters WINDOW w AS (PARTITION BY book_id ORDER BY chapter_no)),
kept AS (SELECT *, CASE WHEN t0 = c0 AND content <> title AND starts_with(title, '番外') THEN t0 || ' ' || title ELSE title END AS merged FROM pairs WHERE NOT (title = content AND t2 IS NOT NULL AND starts_with(t2, '番外') AND c2 <> t2))
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no) AS chapter_no, merged AS title, content FROM kept""")
def txt_chapters_merged(spark, sf_dir):
    return segment.parse_text(conversation_books(spark, sf_dir))


@query(f"WITH {CHAPTERS} SELECT book_id, chapter_no - 1 AS chapter_index, md5(book_id::VARCHAR || '-' || (chapter_no - 1)::VARCHAR) AS link FROM chapters")
def chapter_ids(spark, sf_dir):
    c = segment.chapters(conversation_books(spark, sf_dir)).withColumn("chapter_index", F.col("chapter_no") - 1)
    return c.select("book_id", "chapter_index", t.chapter_link(F.col("book_id"), F.col("chapter_index")).alias("link"))


LINES = "lines AS (SELECT doc_id, (unnest(generate_series(1, len(l))) - 1)::BIGINT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def document_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {LINES} SELECT doc_id, pos, line FROM lines WHERE NOT regexp_matches(line, 'licensed under|^.{{0,15}}$')")
def txt_ignore_patterns(spark, sf_dir):
    return document_lines(spark, sf_dir).where(~segment.is_ignored(F.col("line"), Rules(ignorePatterns=("licensed under", "^.{0,15}\\z"))))


@query("""SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN length(string_split(text, '.')[1]) < 30 THEN string_split(text, '.')[1] ELSE '第1章[自动]' END, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS title FROM documents""")
def auto_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("content", F.replace("text", F.lit("."), F.lit(segment.BREAK)))
    return d.select("doc_id", segment.chapter_title(F.lit(None).cast("string"), F.col("content"), F.lit(1)).alias("title"))


@query(f"""WITH {LINES}, clean AS (SELECT doc_id, pos, trim(regexp_replace(line, '{{WS}}+', ' ', 'g')) AS t FROM lines), sig AS (SELECT *, CASE WHEN regexp_matches(t, '[。！？；：…—”"''）】》」』〕）\\]\\)．.!?;]$') THEN true WHEN length(t) >= 8 THEN false END AS s FROM clean WHERE t <> ''),
st AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS start FROM sig), n AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM st)
SELECT doc_id, n::BIGINT AS paragraph_no, string_agg(t, '' ORDER BY pos) AS paragraph FROM n GROUP BY doc_id, n""")
def paragraphs(spark, sf_dir):
    return segment.paragraphs(document_lines(spark, sf_dir))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '<br/>' || chr(10)) AS html FROM documents""")
def text_to_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.text_to_html(F.col("text")).alias("html"))


UNESCAPE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def unescaped(x: str) -> str:
    return UNESCAPE.replace("{x}", x)


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {unescaped('html')} AS text FROM pages")
def unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.unescape(F.col("html")).alias("text"))


@query(f"SELECT page_id, trim(regexp_replace({unescaped(chr(114) + 'egexp_replace(regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1), ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{{WS}}+', ' ', 'g')) AS title FROM pages")
def clean_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.clean_title(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<iframe[^>]*>.*?</iframe>', '', 'g'), '(?i)\\son[a-z]+\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', '', 'g'), '(?i)javascript:', '', 'g') AS html FROM pages")
def sanitize_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.sanitize_html(F.col("html")).alias("html"))


_TEXT = unescaped("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)<br *[/]?>', chr(10), 'g'), '(?i)</(p|div|h[1-6]|li|tr|section|article|blockquote|figcaption)>', chr(10), 'g'), '<[^>]*>', '', 'g')")


@query(f"""SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace({_TEXT}, chr(160), ' '), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^{{WS}}+|{{WS}}+$', '', 'g')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{{WS}}+|{{WS}}+$', '', 'g') AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE regexp_replace(html, '(?is)^.*?<html[^>]*>', '') END AS body FROM pages) SELECT page_id, length(body)::BIGINT AS n, trim(regexp_replace({unescaped("regexp_replace(CASE WHEN regexp_matches(body, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') THEN regexp_extract(body, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) ELSE regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1) END, '<[^>]*>', '', 'g')")}, '{{WS}}+', ' ', 'g')) AS heading FROM b""")
def html_body_heading(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("body", t.extract_body(F.col("html")))
    return p.select("page_id", F.length("body").cast("long").alias("n"), t.heading_title(F.col("body")).alias("heading"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_attrs(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a\\b[^>]*>"), F.lit(0))).alias("tag"))
    return tags.select("page_id", F.try_element_at(t.attributes(F.col("tag")), F.lit("href")).alias("href")).where("href is not null")


@query("SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^(\\./)+', '') AS key FROM pages")
def href_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.href_key(F.col("url")).alias("key"))


@query("""WITH RECURSIVE o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id FROM documents),
r AS (SELECT source, k, doc_id, n_chars <= 20000 AS took, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM o WHERE k = 1 UNION ALL SELECT o.source, o.k, o.doc_id, r.used + o.n_chars <= 20000, r.used + CASE WHEN r.used + o.n_chars <= 20000 THEN o.n_chars ELSE 0 END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1) SELECT source, doc_id, took FROM r""")
def inline_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("d"))
    took = segment.within_budget(F.transform("d", lambda x: x["n_chars"]), F.lit(20000))
    return d.select("source", F.explode(F.arrays_zip(F.col("d.doc_id").alias("doc_id"), took.alias("took"))).alias("x")).select("source", "x.doc_id", "x.took")


def order_catalog(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return catalog.migrate(o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Book "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("author"), F.lit("").alias("description"), F.lit("").alias("cover_img"), F.lit("").alias("source_path"), F.concat(F.lit("/b/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", ".epub").otherwise(".txt")).alias("stored_path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")))


CATALOG = "cat AS (SELECT o_orderkey AS id, 'Book ' || o_orderkey::VARCHAR AS title, o_orderpriority AS author, '' AS description, '' AS cover_img, '/b/' || o_orderkey::VARCHAR || CASE WHEN o_orderstatus = 'F' THEN '.epub' ELSE '.txt' END AS stored_path, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders)"


@query(f"WITH {CATALOG} SELECT id, title, author, stored_path FROM cat WHERE id = 33")
def catalog_get(spark, sf_dir):
    return catalog.get_book(order_catalog(spark, sf_dir), 33).select("id", "title", "author", "stored_path")


@query(f"WITH {CATALOG}, new AS (SELECT c_name AS title, '' AS author, '/c/' || lpad(c_custkey::VARCHAR, 9, '0') AS stored_path, '2030' AS created_at FROM customer) SELECT id, title, author, created_at FROM cat UNION ALL SELECT (SELECT max(id) FROM cat) + row_number() OVER (ORDER BY created_at, stored_path), title, author, created_at FROM new")
def catalog_insert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.concat(F.lit("/c/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("stored_path"), F.lit("2030").alias("created_at"))
    return catalog.insert_books(order_catalog(spark, sf_dir), c).select("id", "title", "author", "created_at")


@query(f"WITH {CATALOG}, ch AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'New ' || id::VARCHAR END AS title, CASE WHEN id % 3 = 0 THEN ' /x.png ' ELSE ' ' END AS cover_img FROM cat WHERE id % 5 = 0) SELECT cat.id, coalesce(ch.title, cat.title) AS title, author, CASE WHEN ch.cover_img IS NULL THEN cat.cover_img ELSE trim(ch.cover_img) END AS cover_img FROM cat LEFT JOIN ch USING (id)")
def catalog_update(spark, sf_dir):
    b = order_catalog(spark, sf_dir)
    ch = b.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("id").cast("string"))).alias("title"), F.when(F.col("id") % 3 == 0, " /x.png ").otherwise(" ").alias("cover_img"))
    return catalog.update_books(b, ch).select("id", "title", "author", "cover_img")


@query(f"WITH {CATALOG} SELECT id, title FROM cat WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def catalog_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return catalog.delete_books(order_catalog(spark, sf_dir), gone).select("id", "title")


@query(f"WITH {CATALOG} SELECT id, CASE WHEN stored_path LIKE '%.epub' THEN '/book-cover?id=' || id::VARCHAR ELSE '' END AS cover_img FROM cat")
def catalog_default_cover(spark, sf_dir):
    b = order_catalog(spark, sf_dir)
    return b.select("id", catalog.default_cover(F.col("id"), F.col("cover_img"), F.col("stored_path")).alias("cover_img"))


@query("SELECT doc_id, floor(n_chars / 1024 + 0.5)::BIGINT::VARCHAR || ' KB' AS size FROM documents")
def size_kb(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.size_kb(F.col("n_chars")).alias("size"))


@query("SELECT url, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN '/cover-proxy?url=' || url_encode(url) ELSE url END AS cover FROM pages")
def cover_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", t.cover_url(F.col("url")).alias("cover"))


@query("""WITH s AS (SELECT source, count(*) FILTER (WHERE n_chars > 15000) AS skipped, count(*) FILTER (WHERE lang = 'en') AS images, sum(n_chars) * 100 AS bytes FROM documents GROUP BY source)
SELECT source, CASE WHEN skipped > 0 THEN '有 ' || skipped::VARCHAR || ' 张图片未内嵌（已改用按需加载或已跳过）' ELSE '' END || '|' || CASE WHEN bytes > 12 * 1024 * 1024 THEN '已在正文内嵌约 ' || floor(bytes / 1048576.0 + 0.5)::BIGINT::VARCHAR || ' MB 图片，一次性返回全书的接口响应会比较大；按章阅读（/content）不受影响' ELSE '' END AS warnings FROM s WHERE images > 0""")
def summary_warnings(spark, sf_dir):
    from quirework.operators.summary import warnings

    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 15000).alias("skipped"), F.count_if(F.col("lang") == "en").alias("images"), (F.sum("n_chars") * 100).alias("bytes")).where("images > 0")
    s = s.withColumn("w", warnings(F.lit(False), F.col("images"), F.col("images"), F.col("bytes"), F.col("skipped")))
    first = lambda start: F.coalesce(F.get(F.filter("w", lambda x: x.startswith(start)), F.lit(0)), F.lit(""))
    return s.select("source", F.concat_ws("|", first("有"), first("已在")).alias("warnings"))


@query(f"WITH {CATALOG} SELECT id, title, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM cat")
def catalog_list(spark, sf_dir):
    return catalog.listed(order_catalog(spark, sf_dir)).select("id", "title", "created_at", "place")


@query("SELECT sha1(text) AS name, count(*) AS n, min(doc_id) AS first_id, max(strlen(text)) AS bytes FROM documents GROUP BY sha1(text)")
def asset_sha1_dedupe(spark, sf_dir):
    return catalog.by_content(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data")))


@query("WITH o AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents), n AS (SELECT book_id, count(*) AS n FROM o GROUP BY book_id), m AS (SELECT book_id, page, lead(page) OVER (PARTITION BY book_id ORDER BY page) AS nxt FROM o WHERE page % 7 = 3) SELECT m.book_id, m.page::BIGINT AS first_page, greatest(m.page + 1, coalesce(nxt, n.n))::BIGINT AS end_page, sum(d.n_chars)::BIGINT AS n_chars FROM m JOIN n USING (book_id) JOIN o ON o.book_id = m.book_id AND o.page >= m.page AND o.page < greatest(m.page + 1, coalesce(nxt, n.n)) JOIN documents d ON d.doc_id = o.doc_id GROUP BY ALL")
def outline_chapters(spark, sf_dir):
    """Page spans between bookmarks, as an equi-join on exploded pages instead of a range join."""
    from quirework.operators.pdf import outline_spans

    w = Window.partitionBy("book_id").orderBy("doc_id")
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id", "n_chars").withColumn("page", F.row_number().over(w) - 1)
    marks = pages.where("page % 7 = 3").select("book_id", F.lit("outline").alias("kind"), F.col("page").alias("pos"), F.col("page"), F.lit("x").alias("title"))
    info = pages.groupBy("book_id").agg(F.count("*").cast("int").alias("pos")).select("book_id", F.lit("info").alias("kind"), "pos", F.lit(None).cast("int").alias("page"), F.lit("").alias("title"))
    each = outline_spans(marks.union(info)).withColumn("page", F.explode(F.sequence("first_page", F.col("end_page") - 1)))
    out = each.join(pages, ["book_id", "page"]).groupBy("book_id", "first_page", "end_page").agg(F.sum("n_chars").alias("n_chars"))
    return out.select("book_id", F.col("first_page").cast("long").alias("first_page"), F.col("end_page").cast("long").alias("end_page"), "n_chars")


@query(f"""WITH {LINES}, entries AS (SELECT doc_id, string_split(text, '. ')[1] AS entry FROM documents), bare AS (SELECT doc_id, pos, regexp_replace(line, '{{WS}}+', '', 'g') AS a, regexp_replace(entry, '{{WS}}+', '', 'g') AS b FROM lines JOIN entries USING (doc_id))
SELECT doc_id, pos, a <> '' AND b <> '' AND (a = b OR (CASE WHEN length(a) <= length(b) THEN contains(b, a) ELSE contains(a, b) END AND least(length(a), length(b)) >= greatest(4, ceil(greatest(length(a), length(b)) * 0.5)))) AS fits FROM bare""")
def txt_directory_match(spark, sf_dir):
    """Every line against the expected heading of its document, its first sentence."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ". ", 1).alias("entry"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), segment.fits_entry(F.col("line"), F.array("entry")).alias("fits"))


VERSE = ("序", "独立短句", "第一回", "", "", "一行独立的话", "", "", "①列表", "", "", "“她说完了。”", "没有标点", "第二章 开始")
_NEAR = ", ".join(f"{f}(raw, {k}) OVER w AS {n}" for f, k, n in (("lag", 1, "p1"), ("lag", 2, "p2"), ("lead", 1, "n1"), ("lead", 2, "n2")))


@query(f"""WITH l AS (SELECT doc_id, list_concat([{", ".join(f"'{v}'" for v in VERSE)}], string_split(text, chr(10))) AS l FROM documents), r AS (SELECT doc_id, (unnest(generate_series(1, len(l))) - 1)::BIGINT AS pos, unnest(l) AS raw FROM l), n AS (SELECT doc_id, pos, raw, {_NEAR} FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, regexp_matches(raw, '[。！？；：”"…」』】]$') OR coalesce(regexp_full_match(n1, '{{WS}}*'), false) AS closes FROM n)
SELECT doc_id, pos, (coalesce((p1 = '序' OR (starts_with(p1, '序章') AND length(p1) < 20)) AND (regexp_matches(p1, '[章回节]$') OR (regexp_matches(raw, '[章回节]$') AND NOT closes)), false) AND NOT closes) OR coalesce(p1 = '' AND p2 = '' AND n1 = '' AND n2 = '' AND length(raw) < 30 AND NOT regexp_matches(raw, '^[【①-⑳]'), false) AS maybe FROM b WHERE raw <> ''""")
def txt_maybe_title(spark, sf_dir):
    """Verses before every document's lines."""
    text = F.concat(F.lit("\n".join(VERSE) + "\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = rows.select("*", *[F.lag("raw", -i).over(w).alias(f"r{i + 2}") for i in (-2, -1, 1, 2)]).where("raw <> ''")
    return near.select("doc_id", F.col("pos").cast("long").alias("pos"), segment.maybe_title(F.col("raw"), {i: F.col(f"r{i + 2}") for i in (-2, -1, 1, 2)}, Rules()).alias("maybe"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, href) of the addresses in navigations."""
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


LINKS = """links AS (SELECT page_id, (unnest(generate_series(1, len(l))) - 1)::BIGINT AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS l FROM pages))"""


@query(f"""WITH {LINKS}, up AS (SELECT page_id, pos, href, page_id % 4 AS ups FROM links), parts AS (SELECT *, list_filter(string_split(href, '/'), lambda x: x NOT IN ('', '.', '..')) AS l FROM up)
SELECT page_id, pos, array_to_string(list_concat((['a', 'b'])[1:greatest(2 - ups, 0)], list_concat(['c'], l)), '/') AS path FROM parts""")
def href_resolve(spark, sf_dir):
    """Links below 'a/b' after up to three steps up, two of which there is room for."""
    href = F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 4).cast("int")), F.lit("./c//"), F.regexp_replace("href", "(^|/)\\.\\.(?=/|$)", "$1"))
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), t.join_path(F.lit("a/b"), href).alias("path"))


KINDS = t.IMAGE_TYPES | t.ASSET_TYPES | {"xyz": "application/octet-stream", "": "application/octet-stream"}


@query(f"WITH k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{e}{chr(39)}, {chr(39)}{m}{chr(39)})' for i, (e, m) in enumerate(KINDS.items()))}) v(i, ext, kind)) SELECT doc_id, kind, starts_with(kind, 'image/') AS image FROM documents JOIN k ON doc_id % {len(KINDS)} = i")
def media_type(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e.upper()) for e in KINDS]), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", t.media_type(F.concat(F.lit("x/y."), ext, F.lit("?v=1#a.png"))).alias("kind"))
    return d.withColumn("image", t.is_image_type(F.col("kind")))


@query("SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents")
def data_uri(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.data_uri(F.lit("text/plain"), F.col("text").cast("binary")).alias("uri"))


_ASKED = "'/i' || CASE WHEN page_id % 2 = 0 THEN '?x=1&' ELSE '?' END || 'href=' || url_encode(url) || '&page=' || page_id::VARCHAR"


@query(f"SELECT page_id, {_ASKED} AS address, '' AS unsafe FROM pages")
def image_url(spark, sf_dir):
    base = F.when(F.col("page_id") % 2 == 0, "/i?x=1").otherwise("/i")
    args = {"href": F.col("url"), "page": F.col("page_id")}
    return table(spark, sf_dir, "pages").select("page_id", t.image_url(base, **args).alias("address"), t.image_url(F.lit("a b<"), **args).alias("unsafe"))


_PICK = ['<img src="{}" alt="x"/>', '<img src="data:image/gif;base64,R0" data-src="{}">', '<img data-original="{}">', '<img src="" xlink:href="{}"/>', "<img src='{}' srcset='a 2x'>"]


def picked_tags(spark, sf_dir):
    tag = F.lit("")
    for i, x in enumerate(_PICK):
        tag = F.when(F.col("pos") % len(_PICK) == i, F.replace(F.lit(x), F.lit("{}"), F.col("href"))).otherwise(tag)
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href", tag.alias("tag"))


@query(f"WITH {LINKS} SELECT page_id, pos, href FROM links")
def image_pick(spark, sf_dir):
    return picked_tags(spark, sf_dir).select("page_id", "pos", t.pick_image(t.attributes(F.col("tag"))).alias("href"))


@query(f"""WITH {LINKS} SELECT page_id, pos, CASE pos % 5 WHEN 0 THEN '<img src="' || href || '" alt="x"/>' WHEN 1 THEN '<img src="data:image/gif;base64,R0">' WHEN 2 THEN '<img>' WHEN 3 THEN '<img src="" xlink:href="' || href || '"/>' ELSE '<img src=' || chr(39) || href || chr(39) || '>' END AS tag FROM links""")
def strip_lazy(spark, sf_dir):
    return picked_tags(spark, sf_dir).select("page_id", "pos", t.strip_lazy(F.col("tag")).alias("tag"))


_BLOCK = """'<img src="' || href || '" alt="" width="100%" height="100%" style="display:block">'"""


@query(f"WITH {LINKS} SELECT page_id, pos, {_BLOCK} AS tag FROM links")
def image_tag(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), t.image_tag(F.col("href")).alias("tag"))


@query(f"""WITH {LINKS} SELECT page_id, pos, '<p>x</p><img src="' || href || '"/> y' AS html FROM links""")
def unwrap(spark, sf_dir):
    wrapped = F.concat(F.lit('<p>x</p><a href="#"><sup> <img src="'), F.col("href"), F.lit('"/>&nbsp;</sup></a> y'))
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), t.unwrap_images(wrapped).alias("html"))


@query(f"""WITH {LINKS} SELECT page_id, pos, '<p>x</p><br/>' || {_BLOCK} || '<br/> ' || replace({_BLOCK}, 'src="', 'src="b') || '<br/>y' AS html FROM links""")
def blockify(spark, sf_dir):
    html = F.concat(F.lit('<p>x</p><a href="#"><img src="'), F.col("href"), F.lit('" class="c"/></a> <img src="b'), F.col("href"), F.lit('"><br/>y'))
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), t.blockify(t.unwrap_images(html)).alias("html"))


@query(f"WITH {LINKS} SELECT page_id, pos, pos % 2 AS level, '/' || href AS href, trim({unescaped('href')}) AS title FROM links")
def nav_toc(spark, sf_dir):
    """The pages' navigations as nested lists: every second link is a level down."""
    item = F.transform(F.regexp_extract_all("html", F.lit('<a href="/[^"]*">.*?</a>'), F.lit(0)), lambda a, i: F.when(i % 2 == 1, F.concat(F.lit("<ol><li>"), a, F.lit("</li></ol></li>"))).otherwise(F.concat(F.lit("<li>"), a)))
    nav = F.concat(F.lit("<nav><ol>"), F.array_join(item, ""), F.lit("</ol></nav>"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(segment.nav_levels(nav)).alias("a"))
    return rows.select("page_id", F.col("a.pos").cast("long").alias("pos"), F.col("a.level").cast("long").alias("level"), t.attribute(F.col("a.tag"), "href").alias("href"), t.clean_title(F.col("a.tag")).alias("title"))


@query("SELECT page_id, replace(html, '<', chr(92) || 'u003c') AS json FROM pages")
def json_for_script(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.json_for_script(F.col("html")).alias("json"))


_MAGIC = (("FFD8FFE0", "image/jpeg"), ("474946383961", "image/gif"), ("89504E470D0A", "image/png"), ("524946460000000057454250", "image/webp"), ("524946460000000057415645", None), ("", None))


@query("SELECT doc_id, (" + "[" + ", ".join(f"'{m}'" if m else "NULL" for _, m in _MAGIC) + "])[doc_id % 6 + 1] AS kind FROM documents")
def sniff_image(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(h) for h, _ in _MAGIC]), (F.col("doc_id") % 6 + 1).cast("int"))
    data = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", t.sniff_image(data).alias("kind"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'charset=iso-8859-1 ' || regexp_replace(text, '[^\x00-\xff]', '', 'g') ELSE text END AS text FROM documents")
def decode_text(spark, sf_dir):
    """UTF-8 with and without a byte-order mark, and a named charset."""
    plain = F.concat(F.lit("charset=iso-8859-1 "), F.regexp_replace("text", r"[^\x00-\xff]", ""))
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))).when(F.col("doc_id") % 3 == 1, F.encode(plain, "ISO-8859-1")).otherwise(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", t.decode_text(data).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'epub' WHEN page_id % 5 < 4 THEN 'pdf' ELSE 'txt' END AS kind FROM pages")
def format_dispatch(spark, sf_dir):
    """Kinds by name, and by content where the name says nothing."""
    from quirework.sources import kind_of

    ext = F.element_at(F.array(*map(F.lit, (".EPUB?x", "", ".pdf", "", ".txt"))), (F.col("page_id") % 5 + 1).cast("int"))
    content = F.when(F.col("page_id") % 5 == 3, F.concat(F.lit("  %PDF-1.4"), "html")).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", kind_of(F.concat(F.lit("/x/b"), ext), content).alias("kind"))


@query(r"SELECT doc_id, CASE WHEN trim(lang) = '' THEN 'book' ELSE lang || '__' || source END AS name, length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10ffff}]')) AS units FROM documents")
def file_names(spark, sf_dir):
    """Names that are safe for files, and lengths in UTF-16 units."""
    return table(spark, sf_dir, "documents").select("doc_id", t.safe_file_name(F.concat("lang", F.lit(":?"), "source", F.lit(" ."))).alias("name"), t.js_length(F.col("text")).cast("long").alias("units"))


@query(f"WITH {CATALOG}, p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'T' END AS title, 'A' AS author FROM orders) SELECT cat.id, cat.title, CASE WHEN cat.author = '' THEN 'A' ELSE cat.author END AS author, CASE WHEN cat.id % 2 = 0 THEN 'D' ELSE '' END AS description FROM cat")
def catalog_enrich(spark, sf_dir):
    """What a file says of itself where the catalog has nothing."""
    b = order_catalog(spark, sf_dir)
    parsed = b.select("id", F.lit("T").alias("title"), F.lit("A").alias("author"), F.when(F.col("id") % 2 == 0, "D").otherwise("").alias("description"))
    return catalog.enrich(b, parsed).select("id", "title", "author", "description")


from quirework.plans import book_queries  # noqa: E402, F401  registers its queries here
