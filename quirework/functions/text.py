"""Scalar text, markup and path functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: with full-width, no-break and zero-width spaces.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Attributes that lazy loaders put an image's address in.
LAZY = ("data-src", "data-original", "data-lazy-src", "data-echo", "data-url")
#: Media types by extension.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "avif": "image/avif", "apng": "image/apng", "tif": "image/tiff", "tiff": "image/tiff"}
ASSET_TYPES = {"woff2": "font/woff2", "woff": "font/woff", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject", "css": "text/css", "mp3": "audio/mpeg", "m4a": "audio/mp4", "mp4": "video/mp4", "webm": "video/webm"}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+\\z", "")


def collapse(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    # A single plain space is left alone, as most are
    return strip(F.regexp_replace(x, f"{WS}{{2,}}|(?! ){WS}", " "))


def no_space(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+", "")


def title_text(x: Column) -> Column:
    """Collapsed; one pair of book-title marks around the whole of more than two characters goes."""
    c = collapse(x)
    return F.when((F.length(c) > 2) & c.startswith("《") & c.endswith("》"), strip(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def js_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def _code_point(n: Column) -> Column:
    ok = (n >= 1) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("")


def unescape(x: Column) -> Column:
    """Named and numeric references, one level; the ampersand last. Invalid code points go."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(name), F.lit(char))
    tokens = F.regexp_extract_all(x, F.lit("(?s)&#[xX][0-9a-fA-F]{1,8};|&#[0-9]{1,10};|[^&]+|&"), F.lit(0))

    def token(t: Column) -> Column:
        hexed = F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10).cast("long")
        dec = F.try_to_number(F.regexp_extract(t, "^&#([0-9]+);", 1), F.lit("9999999999")).cast("long")
        return F.when(t.rlike("^&#[xX][0-9a-fA-F]+;"), _code_point(hexed)).when(t.rlike("^&#[0-9]+;"), _code_point(dec)).otherwise(t)

    x = F.when(F.contains(x, F.lit("&#")), F.array_join(F.transform(tokens, token), "")).otherwise(x)
    return F.replace(F.replace(x, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>", "")


def clean_title(x: Column) -> Column:
    return collapse(unescape(strip_tags(x)))


def html_to_text(x: Column) -> Column:
    x = F.regexp_replace(x, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = F.regexp_replace(x, "(?i)<br *[/]?>", "\n")
    x = F.regexp_replace(x, "(?i)</(p|div|h[1-6]|li|tr|section|article|blockquote|figcaption)>", "\n")
    x = F.replace(unescape(strip_tags(x)), F.lit("\u00a0"), F.lit(" "))
    x = F.regexp_replace(x, "[ \\t]+", " ")
    x = F.array_join(F.transform(F.split(x, "\n", -1), strip), "\n")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def sanitize_html(x: Column) -> Column:
    x = F.regexp_replace(x, "(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, "(?is)<iframe[^>]*>.*?</iframe>", "")
    x = F.regexp_replace(x, "(?i)\\son[a-z]+\\s*=\\s*(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(x, "(?i)javascript:", "")


def extract_body(x: Column) -> Column:
    inner = F.regexp_extract(x, "(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(x.rlike("(?is)<body[^>]*>.*</body>"), inner).otherwise(F.regexp_replace(x, "(?is)^.*?<html[^>]*>", ""))


def heading_title(x: Column) -> Column:
    """The first heading with its tags cleaned, else the title element, else ''."""
    h = F.regexp_extract(x, "(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    return F.when(x.rlike("(?is)<h[1-6][^>]*>.*?</h[1-6]>"), clean_title(h)).otherwise(clean_title(F.regexp_extract(x, "(?is)<title[^>]*>(.*?)</title>", 1)))


def attributes(tag: Column) -> Column:
    """Map of a tag's quoted attributes, names in lower case; of repeated names the last counts."""
    pat = "([a-zA-Z_:][-a-zA-Z0-9_:.]*)\\s*=\\s*(\"[^\"]*\"|'[^']*')"
    names = F.transform(F.regexp_extract_all(tag, F.lit(pat), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(tag, F.lit(pat), F.lit(2)), lambda v: unescape(F.substring(v, F.lit(2), F.length(v) - 2)))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(last)


def attribute(tag: Column, name: str) -> Column:
    """One quoted attribute that white space precedes, unescaped; '' if it is missing."""
    raw = F.regexp_extract(tag, f"(?i)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(raw == "", "").otherwise(unescape(F.substring(raw, F.lit(2), F.length(raw) - 2)))


def decode_text(data: Column) -> Column:
    """Bytes to text by the charset that the first 2,048 bytes name; UTF-8 otherwise; no byte-order mark."""
    head = F.decode(F.substring(data, 1, 2048), "ISO-8859-1")
    name = F.upper(F.regexp_extract(head, "(?i)(?:encoding|charset)\\s*=\\s*[\"']?([-a-zA-Z0-9_]+)", 1))
    known = F.when(name.isin("GBK", "GB2312", "GB18030"), F.decode(data, "GBK")).when(name.isin("ISO-8859-1", "LATIN1"), F.decode(data, "ISO-8859-1")).when(name.isin("UTF-16"), F.decode(data, "UTF-16"))
    return F.regexp_replace(F.coalesce(known, F.make_valid_utf8(data.cast("string"))), "^\\ufeff", "")


def path_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*\\z", "")).otherwise("")


def join_path(base: Column, href: Column) -> Column:
    """Resolves a relative path: '.' and '..' segments go, an absolute one starts anew."""
    whole = F.when(href.startswith("/"), href).otherwise(F.concat_ws("/", base, href))
    back = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", back(acc)).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(whole, "/", -1), F.array().cast("array<string>"), step), "/")


def href_key(href: Column) -> Column:
    x = F.replace(F.substring_index(F.substring_index(href, "#", 1), "?", 1), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(x, "^(\\./)+", "")


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(href_key(path), "\\.([A-Za-z0-9]+)\\z", 1))
    table = F.create_map(*[F.lit(x) for kv in (IMAGE_TYPES | ASSET_TYPES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def is_image_type(kind: Column) -> Column:
    return F.lower(kind).startswith("image/")


def data_uri(kind: Column, data: Column) -> Column:
    """A data address; base64 in one line."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(data), "\\s+", ""))


def is_placeholder(src: Column) -> Column:
    """Blank, or an inline image of 512 characters or fewer."""
    s = strip(F.coalesce(src, F.lit("")))
    at = F.instr(s, ",")
    return (s == "") | (s.rlike("(?i)^data:") & ((at == 0) | (F.length(s) - at <= 512)))


def pick_image(attrs: Column) -> Column:
    """The address an image is to be loaded from, of a map of attributes."""
    get = lambda n: F.try_element_at(attrs, F.lit(n))

    def local(v: Column) -> Column:
        s = strip(F.coalesce(v, F.lit("")))
        return F.when((s != "") & ~s.rlike("(?i)^(data:|https?:|blob:|//)"), s)

    lazy = F.when(is_placeholder(get("src")), F.coalesce(*[local(get(n)) for n in LAZY]))
    raw = [F.when(get(n) != "", get(n)) for n in ("src", "xlink:href", "href")]
    return F.coalesce(local(get("src")), lazy, *raw, F.lit(""))


def strip_lazy(tag: Column) -> Column:
    return F.regexp_replace(tag, "(?i)\\s(?:" + "|".join((*LAZY, "srcset")) + ")\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]+)", "")


def encode_component(x: Column) -> Column:
    y = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        y = F.replace(y, F.lit(code), F.lit(char))
    return y


def image_url(base: Column, **params: Column) -> Column:
    """An address with parameters; '' if the base isn't of safe characters."""
    query = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), encode_component(v.cast("string"))) for k, v in params.items()])
    joined = F.concat(base, F.when(F.instr(base, "?") > 0, "&").otherwise("?"), query)
    return F.when(F.regexp_replace(base, "\\?.*", "").rlike("^[\\w./:-]{1,200}\\z"), joined).otherwise("")


def image_tag(src: Column) -> Column:
    return F.concat(F.lit('<img src="'), F.replace(F.coalesce(src, F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit('" alt="" width="100%" height="100%" style="display:block">'))


def block_style(style: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";", -1), strip), lambda p: (p != "") & ~p.rlike("(?i)^display\\s*:"))
    return F.array_join(F.concat(F.array(F.lit("display:block")), parts), "; ")


def block_image(attrs: Column) -> Column:
    """An image tag of the given attribute text as a block."""
    a = strip(F.coalesce(attrs, F.lit("")))
    src = attribute(F.concat(F.lit(" "), a), "src")
    style = F.regexp_extract(a, "(?i)(\\sstyle\\s*=\\s*(\"[^\"]*\"|'[^']*'))", 1)
    quoted = F.regexp_extract(style, "(\"[^\"]*\"|'[^']*')", 1)
    styled = F.concat(F.lit("<img "), F.replace(a, style, F.concat(F.lit(' style="'), block_style(F.substring(quoted, F.lit(2), F.length(quoted) - 2)), F.lit('"'))), F.lit(" />"))
    plain = F.when(a == "", '<img style="display:block" />').otherwise(F.concat(F.lit("<img "), a, F.lit(' style="display:block" />')))
    return F.when(src != "", image_tag(src)).when(style != "", styled).otherwise(plain)


def blockify(html: Column) -> Column:
    """Images as blocks with one line break on each side, none doubled between neighbours."""
    image = "(?:<br\\s*/?>\\s*)?<img\\b[^>]*>(?:\\s*<br\\s*/?>)?"
    tokens = F.regexp_extract_all(html, F.lit(f"(?is){image}|(?:(?!{image}).)+"), F.lit(0))
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("ended"))

    def step(acc: Column, t: Column) -> Column:
        is_image = t.rlike("(?is)^(?:<br\\s*/?>\\s*)?<img\\b")
        tag = block_image(F.regexp_extract(t, "(?is)<img\\b([^>]*?)/?>", 1))
        lead = F.when(acc["ended"], "").otherwise("<br/>")
        out = F.when(is_image, F.concat(acc["out"], lead, tag, F.lit("<br/>"))).otherwise(F.concat(acc["out"], t))
        return F.struct(out.alias("out"), (is_image | (acc["ended"] & (strip(t) == ""))).alias("ended"))

    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def unwrap_images(html: Column) -> Column:
    """sup, sub and a elements around nothing but an image go; up to four layers."""
    for _ in range(4):
        html = F.regexp_replace(html, "(?is)<(?:sup|sub|a)\\b[^>]*>(?:\\s|&nbsp;|\\u00a0)*(<img\\b[^>]*>)(?:\\s|&nbsp;|\\u00a0)*</(?:sup|sub|a)>", "$1")
    return html


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def text_to_html(x: Column) -> Column:
    lines = F.filter(F.transform(F.split(x, "\n", -1), strip), lambda s: s != "")
    return F.array_join(F.transform(lines, escape_html), "<br/>\n")


def json_for_script(x: Column) -> Column:
    for char, code in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        x = F.replace(x, F.lit(char), F.lit(code))
    return x


def sniff_image(data: Column) -> Column:
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("47494638"), "image/gif").when(h.startswith("89504E47"), "image/png").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")


def cover_url(src: Column, base: str = "") -> Column:
    proxied = F.concat(F.lit(f"{base}/cover-proxy?url="), encode_component(src))
    return F.when(src.rlike("(?i)^https?://"), proxied).when(src.startswith("/") & F.lit(bool(base)), F.concat(F.lit(base), src)).otherwise(src)


def chapter_link(book_id: Column, index: Column) -> Column:
    return F.md5(F.concat_ws("-", book_id.cast("string"), index.cast("string")))


def size_kb(n: Column) -> Column:
    return F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))


def file_kind(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, "[?#].*", ""))
    return F.when(p.endswith(".epub"), "epub").when(p.endswith(".pdf"), "pdf").otherwise("")


def is_pdf(data: Column) -> Column:
    return F.instr(F.decode(F.substring(data, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def safe_file_name(name: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(name, "[\\\\/:*?\"<>|\\x00-\\x1f]", "_"), "[. ]+\\z", "")
    return F.when(strip(x) == "", "book").otherwise(x)
